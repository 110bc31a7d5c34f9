"""Streaming forms: bins and episodes by event time, and the smoothed alert as a fold with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plantwatch.functions.columns import SECOND


def deduplicated(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Rows (asset, tag, ts, value), the first of each (asset, tag, ts) while the watermark allows; later rows are dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["asset", "tag", "ts"])


def binned(stream: DataFrame, size: str = "2 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(asset, tag, start, n, mean, top) of tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = stream.withWatermark("ts", delay).groupBy("asset", "tag", w.alias("w"))
    return g.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top")).select("asset", "tag", F.col("w.start").alias("start"), "n", "mean", "top")


def session_episodes(alerts: DataFrame, gap_seconds: float, delay: str = "10 minutes") -> DataFrame:
    """(asset, start, end, points) of alerts (asset, ts) whose gaps are `gap_seconds` at most.

    A session closes at a gap that equals its length, so it is made one
    microsecond longer; the end is the last alert.
    """
    micro = round(gap_seconds * SECOND) + 1
    g = alerts.withWatermark("ts", delay).groupBy("asset", F.session_window("ts", f"{micro} microseconds").alias("s"))
    return g.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("points")).select("asset", "start", "end", "points")


def _decayed(t: np.ndarray, x: np.ndarray, half_life: float, carry: float, last: int) -> np.ndarray:
    """Running sums at times t of terms that halve with every half_life, `carry` being the sum at `last`; in stretches that neither overflow nor lose digits."""
    out, at = np.empty(len(t)), 0
    while at < len(t):
        to = int(np.searchsorted(t, t[at] + 200 * half_life, side="right"))
        p = (t[at:to] - t[at]) / half_life
        before = carry * 0.5 ** ((t[at] - last) / half_life) if last >= 0 else 0.0
        out[at:to] = (before + np.cumsum(x[at:to] * 2.0**p)) * 2.0**-p
        carry, last, at = float(out[to - 1]), int(t[to - 1]), to
    return out


def alert_stream(stream: DataFrame, half_life: int, threshold: float, least: int, delay: str = "10 minutes") -> DataFrame:
    """(asset, tag, t, ewma, alert) of rows (asset, tag, ts, t, value, off), t in microseconds.

    Rows wait in the state of their series until the watermark has passed them,
    and are then folded in time order; rows of one time count together, at one
    decay. Rows behind the watermark are left out and counted by the query's
    numRowsDroppedByWatermark; run the stream over a table of their own to keep
    them. A run at the threshold or above goes out once it has `least` rows, with
    alerts, or once it ends, without. What a state holds is what arrives in
    `delay`, and at most `least` rows of an open run, so bound a micro-batch by
    maxFilesPerTrigger. The batch form over the same rows gives the same values.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        num, den, last, confirmed, wait_t, wait_v, wait_off, held_t, held_e = state.get if state.exists else (0.0, 0.0, -1, False, [], [], [], [], [])
        t, v, off = [np.array(wait_t, np.int64)], [np.array(wait_v, float)], [np.array(wait_off, bool)]
        for rows in batches:
            t.append(rows["t"].to_numpy(np.int64))
            v.append(rows["value"].to_numpy(float, na_value=np.nan))
            off.append(rows["off"].to_numpy(bool, na_value=False))
        t, v, off = np.concatenate(t), np.concatenate(v), np.concatenate(off)
        order = np.lexsort((~off, t))  # of rows of one time those that are off come first, as in the batch form
        t, v, off = t[order], v[order], off[order]
        now = state.getCurrentWatermarkMs() * 1000
        n = int(np.searchsorted(t, now, side="left"))
        out = pd.DataFrame({"asset": [], "tag": [], "t": [], "ewma": [], "alert": []})
        if n:
            times, back = np.unique(t[:n], return_inverse=True)
            known = ~np.isnan(v[:n])
            nums = _decayed(times, np.bincount(back, np.where(known, v[:n], 0.0)), half_life, num, last)
            dens = _decayed(times, np.bincount(back, known.astype(float)), half_life, den, last)
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = np.where(dens > 0, nums / dens, np.nan)[back]
            num, den, last = float(nums[-1]), float(dens[-1]), int(times[-1])
            when, ewma = np.concatenate([np.array(held_t, np.int64), t[:n]]), np.concatenate([np.array(held_e, float), mean])
            up = np.concatenate([np.ones(len(held_t), bool), (mean >= threshold) & ~off[:n]])
            run = np.concatenate([[0], np.cumsum(up[1:] != up[:-1])])
            alert = up & ((np.bincount(run)[run] >= least) | ((run == 0) & confirmed))
            open_ = up[-1] and not alert[-1]
            confirmed = bool(up[-1] and alert[-1])
            stay = (run == run[-1]) & open_
            held_t, held_e = when[stay].tolist(), ewma[stay].tolist()
            out = pd.DataFrame({"asset": key[0], "tag": key[1], "t": when[~stay], "ewma": ewma[~stay], "alert": alert[~stay]})
        state.update((num, den, last, confirmed, t[n:].tolist(), v[n:].tolist(), off[n:].tolist(), held_t, held_e))
        if n < len(t):
            state.setTimeoutTimestamp(max(int(t[n]) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if len(out):
            yield out

    kept = "num double, den double, last long, confirmed boolean, wait_t array<long>, wait_v array<double>, wait_off array<boolean>, held_t array<long>, held_e array<double>"
    rows = stream.withWatermark("ts", delay).select("asset", "tag", "ts", "t", "value", "off")
    return rows.groupBy("asset", "tag").applyInPandasWithState(fold, "asset long, tag string, t long, ewma double, alert boolean", kept, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what its source holds now, writes a Parquet table in `folder`, a new one, and reads it."""
    base = folder.rstrip("/")
    query = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/rows")
