"""One stateful processor for a series: smoothing, CUSUM, episodes and the refractory period, started from kept states.

A run over the past in batch leaves one row of state a series
(`last_states`). A stream takes them as its initial state and goes on, so no
warm-up window is run again. Rows behind a series' own watermark, and second
rows of one time, come out as rows of kind "late" instead of being lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plantwatch.functions.columns import HOUR, MINUTE
from plantwatch.operators import episodes, state
from plantwatch.streaming.alerting import _decayed

KEYS = ("asset", "tag")
#: State stores of this processor must keep lists.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Rules:
    """half_life, gap, hold and delay are microseconds. A row is up from `threshold` of the mean or `limit` of the CUSUM on; up rows with gaps up to `gap` are an episode; one that starts within `hold` of the last kept one's end isn't kept. Rows wait until the series is `delay` past them, or, with no rows coming, for `idle_ms` of the clock."""

    half_life: int = 6 * HOUR
    threshold: float = 60.0
    drift: float = 0.5
    limit: float = 5.0
    gap: int = 6 * HOUR
    hold: int = 24 * HOUR
    delay: int = 10 * MINUTE
    idle_ms: int = 3_600_000


#: The state of a series: sums of the mean and the time of its last row, CUSUM, the open episode (points 0: none), the end of the last kept one, and the newest time seen.
STATE = "num double, den double, last long, cusum double, start long, end long, points long, until long, top long"
_NAMES = [part.split()[0] for part in STATE.split(", ")]
_KINDS = {"t": "int64", "value": "float64", "z": "float64"}
_FIRST = (0.0, 0.0, -1, 0.0, -1, -1, 0, -1, -1)
OUTPUT = "asset long, tag string, kind string, t long, value double, ewma double, cusum double, up boolean, start long, end long, points long, kept boolean"


def fold(rules: Rules, s: dict, t: np.ndarray, value: np.ndarray, z: np.ndarray) -> tuple[pd.DataFrame, list[tuple[int, int, int, bool]]]:
    """Readings and closed episodes of rows in time order; `s` goes on to the state after them. A null value weighs nothing, a null z adds nothing."""
    known = ~np.isnan(value)
    nums = _decayed(t, np.where(known, value, 0.0), rules.half_life, s["num"], s["last"])
    dens = _decayed(t, known.astype(float), rules.half_life, s["den"], s["last"])
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(dens > 0, nums / dens, np.nan)
    total = s["cusum"] + np.cumsum(np.where(np.isnan(z), 0.0, z - rules.drift))
    cusum = total - np.minimum(np.minimum.accumulate(total), 0.0)
    up = (np.nan_to_num(mean, nan=-np.inf) >= rules.threshold) | (cusum >= rules.limit)
    closed = []
    at = t[up]
    cuts = np.flatnonzero(np.diff(at) > rules.gap) + 1
    for part in np.split(at, cuts) if len(at) else []:
        if s["points"] and part[0] - s["end"] <= rules.gap:
            s["end"], s["points"] = int(part[-1]), s["points"] + len(part)
            continue
        close(rules, s, closed)
        s["start"], s["end"], s["points"] = int(part[0]), int(part[-1]), len(part)
    s["num"], s["den"], s["last"], s["cusum"] = float(nums[-1]), float(dens[-1]), int(t[-1]), float(cusum[-1])
    return pd.DataFrame({"t": t, "value": value, "ewma": mean, "cusum": cusum, "up": up}), closed


def close(rules: Rules, s: dict, closed: list) -> None:
    """Ends the open episode, if there is one, and judges it by the refractory period."""
    if not s["points"]:
        return
    kept = s["until"] < 0 or s["start"] > s["until"] + rules.hold
    closed.append((s["start"], s["end"], s["points"], kept))
    if kept:
        s["until"] = s["end"]
    s["points"] = 0


class Monitor(StatefulProcessor):
    """Folds a series' rows in time order once they are `delay` behind its newest one; see Rules."""

    def __init__(self, rules: Rules, timers: bool = False) -> None:
        self.rules, self.timers = rules, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", STATE)
        self.waiting = handle.getListState("waiting", "t long, value double, z double")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803, ANN001
        row = initialState.iloc[0]
        self.kept.update(tuple(float(row[n]) if n in ("num", "den", "cusum") else int(row[n]) for n in _NAMES))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        s = dict(zip(_NAMES, self.kept.get() if self.kept.exists() else _FIRST, strict=True))
        before = self._waiting()
        new = pd.concat([x[["t", "value", "z"]].astype(_KINDS) for x in rows], ignore_index=True)
        late = (new["t"] <= s["last"]) | (new["t"] <= s["top"] - self.rules.delay) | new["t"].isin(before["t"]) | new["t"].duplicated()
        rest = pd.concat([x for x in (before, new[~late]) if len(x)] or [before], ignore_index=True).sort_values("t", kind="stable")
        s["top"] = max(s["top"], int(rest["t"].max()) if len(rest) else -1)
        ready = rest["t"] <= s["top"] - self.rules.delay
        yield from self._go_on(key, s, rest[ready], rest[~ready], new[late], s["top"] - self.rules.delay)
        if self.timers:
            for expiry in list(self.handle.listTimers()):
                self.handle.deleteTimer(expiry)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.rules.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        """No rows for a while: what waits is folded, and the open episode ends."""
        s = dict(zip(_NAMES, self.kept.get() if self.kept.exists() else _FIRST, strict=True))
        rest = self._waiting().sort_values("t", kind="stable")
        yield from self._go_on(key, s, rest, rest.iloc[:0], rest.iloc[:0], None)

    def _waiting(self) -> pd.DataFrame:
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        return pd.DataFrame(held, columns=list(_KINDS)).astype(_KINDS)

    def _go_on(self, key: tuple, s: dict, ready: pd.DataFrame, rest: pd.DataFrame, late: pd.DataFrame, now: int | None) -> Iterator[pd.DataFrame]:
        parts, closed = [], []
        if len(ready):
            found, closed = fold(self.rules, s, *(ready[c].to_numpy(kind) for c, kind in (("t", np.int64), ("value", float), ("z", float))))
            parts.append(found.assign(kind="reading"))
        if s["points"] and (now is None or now > s["end"] + self.rules.gap):
            close(self.rules, s, closed)
        if closed:
            parts.append(pd.DataFrame(closed, columns=["start", "end", "points", "kept"]).assign(kind="episode"))
        if len(late):
            parts.append(late[["t", "value"]].assign(kind="late"))
        self.kept.update(tuple(s[n] for n in _NAMES))
        self.waiting.put([tuple(x) for x in rest.itertuples(index=False)]) if len(rest) else self.waiting.clear()
        names = [part.split()[0] for part in OUTPUT.split(", ")]
        for part in parts:
            out = part.assign(asset=key[0], tag=key[1]).reindex(columns=names)
            for c in ("t", "start", "end", "points"):
                out[c] = out[c].astype("Int64")
            for c in ("up", "kept"):
                out[c] = out[c].astype("boolean")
            yield out

    def close(self) -> None:
        pass


def monitored(stream: DataFrame, rules: Rules, states: DataFrame | None = None, timers: bool = False) -> DataFrame:
    """OUTPUT rows of a stream (asset, tag, t, value, z), going on from `states` (see last_states); kind is "reading", "episode" or "late".

    Readings come out once they are `delay` behind the newest row of their
    series, episodes once nothing can join them. A row that is then behind, or
    whose time has been seen, is late and changes nothing. Readings and episodes
    are those of `monitored_batch` over the rows before and the rows that aren't
    late. A series' state is its row of numbers and what arrives in `delay`.

    With `timers` a series without rows for `idle_ms` of the clock is folded to
    its end; such a stream has no last batch, so its trigger must be one that
    goes on. Without, what waits stays in the state.
    """
    session = stream.sparkSession
    session.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = stream.select(*KEYS, "t", "value", "z").groupBy(*KEYS)
    start = states.select(*KEYS, *_NAMES).groupBy(*KEYS) if states is not None else None
    return rows.transformWithStateInPandas(Monitor(rules, timers), OUTPUT, "Append", "ProcessingTime" if timers else "None", initialState=start)


def monitored_batch(rows: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Readings (asset, tag, t, value, ewma, cusum, up) and episodes (asset, tag, start, end, points, kept) of rows (asset, tag, t, value, z)."""
    r = state.ewma_time(rows, rules.half_life)
    r = state.cusum(r, rules.drift)
    r = r.withColumn("up", F.coalesce((F.col("ewma") >= rules.threshold) | (F.col("cusum") >= rules.limit), F.lit(False)))
    ep = episodes.episodes(r.where("up"), KEYS, rules.gap)
    kept = episodes.refractory(ep, KEYS, rules.hold).select(*KEYS, "start", F.lit(True).alias("kept"))
    ep = ep.join(kept, [*KEYS, "start"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    return r.select(*KEYS, "t", "value", "ewma", "cusum", "up"), ep.select(*KEYS, "start", "end", "points", "kept")


def last_states(rows: DataFrame, rules: Rules) -> DataFrame:
    """(asset, tag, STATE) after all of `rows`: sums of the mean as aggregates decayed to the last time, CUSUM at the last row, the newest episode if it is still open, the end of the last kept one that is closed."""
    readings, ep = monitored_batch(rows, rules)
    ends = readings.groupBy(*KEYS).agg(F.max("t").alias("last"), F.max_by("cusum", "t").alias("cusum"))
    fade = F.pow(F.lit(2.0), (F.col("t") - F.col("last")) / F.lit(float(rules.half_life)))
    sums = rows.join(ends, list(KEYS)).groupBy(*KEYS).agg(F.coalesce(F.sum(F.col("value") * fade), F.lit(0.0)).alias("num"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), fade)), F.lit(0.0)).alias("den"))
    late = ep.join(ends.select(*KEYS, "last"), list(KEYS)).withColumn("open", F.col("last") <= F.col("end") + rules.gap)
    pick = lambda c, otherwise: F.coalesce(F.max(F.when(F.col("open"), F.col(c))), F.lit(otherwise).cast("long"))
    newest = late.groupBy(*KEYS).agg(pick("start", -1).alias("start"), pick("end", -1).alias("end"), pick("points", 0).alias("points"), F.coalesce(F.max(F.when(F.col("kept") & ~F.col("open"), F.col("end"))), F.lit(-1).cast("long")).alias("until"))
    whole = ends.join(sums, list(KEYS)).join(newest, list(KEYS), "left").withColumn("top", F.col("last"))
    return whole.select(*KEYS, "num", "den", "last", "cusum", *(F.coalesce(c, F.lit(v).cast("long")).alias(c) for c, v in (("start", -1), ("end", -1), ("points", 0), ("until", -1))), "top")


def standardised(rows: DataFrame, fitted: DataFrame, value: str = "value") -> DataFrame:
    """`rows` with z by the mean and population deviation of each series in `fitted`; null without spread."""
    p = fitted.groupBy(*KEYS).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z: Column = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))
    return rows.join(p, list(KEYS), "left").withColumn("z", z).drop("_m", "_s")


def after_rows(rows: DataFrame, delay: int) -> DataFrame:
    """The rows that are `delay` behind the newest of their series: those that a stream over them has folded."""
    top = F.max("t").over(Window.partitionBy(*KEYS))
    return rows.withColumn("_top", top).where(F.col("t") <= F.col("_top") - delay).drop("_top")
