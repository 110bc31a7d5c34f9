"""Stateful rules on ordered series, as window functions and block scans."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.functions.columns import floor_to
from plantwatch.operators import folds, scans
from plantwatch.operators.blocks import by_rows, decayed_sums, row_numbers
from plantwatch.operators.episodes import runs

KEYS = ("asset", "tag")


def _w(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("t")


def ewma_points(df: DataFrame, half_life: float, keys: Sequence[str] = KEYS, value: str = "value", into: str = "ewma") -> DataFrame:
    """`df` with the bias-corrected mean whose weights halve every `half_life` rows.

    Weights keep decaying over null rows, whose mean is the one carried; null
    before the first value.
    """
    rows = row_numbers(df, keys, 10 * 86_400 * 1_000_000)
    known = F.col(value).isNotNull().cast("double")
    rows = decayed_sums(rows, keys, "n", half_life, {"_num": F.coalesce(F.col(value), F.lit(0.0)), "_den": known})
    return rows.withColumn(into, F.when(F.col("_den") > 0, F.col("_num") / F.col("_den"))).drop("_num", "_den", "n")


def ewma_time(df: DataFrame, half_life: int, keys: Sequence[str] = KEYS, value: str = "value", into: str = "ewma") -> DataFrame:
    """`df` with the mean whose weights halve with every `half_life` of time; nulls have no weight."""
    known = F.col(value).isNotNull().cast("double")
    rows = decayed_sums(df, keys, "t", float(half_life), {"_num": F.coalesce(F.col(value), F.lit(0.0)), "_den": known})
    return rows.withColumn(into, F.when(F.col("_den") > 0, F.col("_num") / F.col("_den"))).drop("_num", "_den")


def ewma_recursive(df: DataFrame, half_life: float, keys: Sequence[str] = KEYS, value: str = "value", into: str = "ewma") -> DataFrame:
    """`df` with s = a x + (1 - a) s, a = 1 - 0.5^(1 / half_life), from the first value on; null rows carry s, rows before have the first value.

    With f the first value the recurrence from 0 differs from s by
    f (1 - a)^(k + 1) after k more values, so one decayed sum gives it.
    """
    a = 1 - 0.5 ** (1 / half_life)
    rows = df.withColumn("_known", F.col(value).isNotNull()).withColumn("_k", F.sum(F.col("_known").cast("long")).over(_w(keys).rowsBetween(Window.unboundedPreceding, 0)))
    valued = decayed_sums(rows.where("_known"), keys, "_k", half_life, {"_s": F.col(value) * a}).select(*keys, "t", "_s")
    first = F.first(value, ignorenulls=True).over(_w(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_f", first).join(valued, [*keys, "t"], "left")
    s = F.col("_s") + F.col("_f") * F.pow(F.lit(1 - a), F.col("_k"))
    return rows.withColumn("_e", s).withColumn(into, F.coalesce(F.last("_e", ignorenulls=True).over(_w(keys).rowsBetween(Window.unboundedPreceding, 0)), F.col("_f"))).drop("_known", "_k", "_s", "_f", "_e")


def cusum(df: DataFrame, drift: float, keys: Sequence[str] = KEYS, z: str = "z", into: str = "cusum", block: int = 30 * 86_400 * 1_000_000) -> DataFrame:
    """`df` with S = max(0, S + z - drift): the running sum less its least value so far, 0 at most; null z adds nothing.

    Sums and least values run within blocks of `block` of time; the blocks
    before add their total and their least value, a window over one row a block.
    """
    step = F.coalesce(F.col(z) - drift, F.lit(0.0))
    run = Window.partitionBy(*keys, "_b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_b", floor_to(F.col("t"), block)).withColumn("_c", F.sum(step).over(run)).withColumn("_m", F.min("_c").over(run))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "_b").agg(F.sum(step).alias("_sum"), F.min("_c").alias("_least"))
    ends = ends.withColumn("_carry", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    ends = ends.withColumn("_low", F.coalesce(F.min(F.col("_carry") + F.col("_least")).over(before), F.lit(0.0))).drop("_sum", "_least")
    low = F.least(F.lit(0.0), F.col("_low"), F.col("_carry") + F.col("_m"))
    return rows.join(ends, [*keys, "_b"]).withColumn(into, F.col("_carry") + F.col("_c") - low).drop("_b", "_c", "_m", "_carry", "_low")


def cusum_segments(df: DataFrame, drift: float, reset: str, load: float, keys: Sequence[str] = KEYS, z: str = "z", into: str = "cusum") -> DataFrame:
    """The same with S multiplied by `load` before each row where `reset` holds.

    In a segment that starts with S = a the sum is C + max(a, -min(0, min C)),
    C the segment's running sum; a is folded over one row a segment.
    """
    run = _w(keys).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_g", F.sum(F.coalesce(F.col(reset), F.lit(False)).cast("long")).over(run))
    inner = Window.partitionBy(*keys, "_g").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_c", F.sum(F.coalesce(F.col(z) - drift, F.lit(0.0))).over(inner))
    rows = rows.withColumn("_low", F.least(F.lit(0.0), F.min("_c").over(inner)))
    ends = rows.groupBy(*keys, "_g").agg(F.max_by("_c", "t").alias("c"), F.min("_low").alias("low"))
    start = F.expr("struct(cast(0 as double) as a, true as first, cast(array() as array<struct<_g:bigint,_a:double>>) as out)")

    def step(acc: Column, x: Column) -> Column:
        a = F.when(acc["first"] & (x["_g"] == 0), 0.0).otherwise(acc["a"] * load)
        return F.struct((x["c"] + F.greatest(a, -x["low"])).alias("a"), F.lit(False).alias("first"), F.concat(acc["out"], F.array(F.struct(x["_g"].alias("_g"), a.alias("_a")))).alias("out"))

    carried = ends.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("_g", "c", "low"))), start, step)["out"].alias("o")).select(*keys, F.explode("o").alias("o")).select(*keys, "o.*")
    return rows.join(carried, [*keys, "_g"]).withColumn(into, F.col("_c") + F.greatest(F.col("_a"), -F.col("_low"))).drop("_g", "_c", "_low", "_a")


def cusum_with_signals(df: DataFrame, drift: float, limit: float, after: float | None = None, most: float | None = None, keys: Sequence[str] = KEYS, z: str = "z", into: str = "cusum", block: int = scans.BLOCK) -> DataFrame:
    """`df` with S = max(0, S + z - drift), S starting from `after` once it has reached `limit` (None: it goes on), and `most` at most.

    Where S starts anew depends on all of it before, so blocks of time are folded
    from a guess and corrected (see folds); null z adds nothing.
    """

    def run(rows: pd.DataFrame, before: tuple) -> tuple[dict[str, object], tuple]:
        s, out = float(before[0]), np.empty(len(rows))
        for k, x in enumerate(np.nan_to_num(rows[z].to_numpy(float, na_value=np.nan) - drift).tolist()):
            s = max(0.0, (after if after is not None and s >= limit else s) + x)
            s = s if most is None else min(s, most)
            out[k] = s
        return {into: out}, (s,)

    return folds.fold_series(df, keys, run, (0.0,), "s double", f"{into} double", block, [z])


def glr(df: DataFrame, spans: Sequence[int], keys: Sequence[str] = KEYS, z: str = "z", into: str = "glr") -> DataFrame:
    """`df` with the largest (C_t - C_{t-j}) / sqrt(j) over j in `spans`, C the running sum; 0 at least."""
    rows = df.withColumn("_c", F.sum(z).over(_w(keys).rowsBetween(Window.unboundedPreceding, 0)))
    steps = [(F.col("_c") - F.coalesce(F.lag("_c", j).over(_w(keys)), F.when(F.row_number().over(_w(keys)) == j, 0.0))) / float(j) ** 0.5 for j in spans]
    return rows.withColumn(into, F.greatest(F.lit(0.0), *steps)).drop("_c")


def running_clock(df: DataFrame, on: str, most: int, keys: Sequence[str] = KEYS, into: str = "ran") -> DataFrame:
    """`df` with the time that has passed while `on` held: a row that is on adds the time since the row before, `most` at most; a first row adds `most`."""
    rows = scans.scan(df, keys, {"_before": scans.known(F.col("t"))}, inclusive=False)
    step = F.when(F.col(on), F.least(F.coalesce(F.col("t") - F.col("_before"), F.lit(most)), F.lit(most))).otherwise(F.lit(0)).cast("long")
    return scans.scan(rows.withColumn("_step", step), keys, {into: scans.total(F.col("_step"))}).drop("_before", "_step")


def sustained_running(df: DataFrame, flag: str, on: str, least: int, most: int, keys: Sequence[str] = KEYS, into: str = "held") -> DataFrame:
    """`df` with `into`: the machine is on, the flag holds, and it has held for `least` of running time; rows that are off stop the clock and don't end a run."""
    rows = running_clock(df, on, most, keys, "_ran").withColumn("_up", F.coalesce(F.col(flag), F.lit(False)))
    # the running time at the last row that was on without the flag
    rows = scans.scan(rows, keys, {"_since": scans.known(F.when(F.col(on) & ~F.col("_up"), F.col("_ran")))})
    long = F.col("_ran") - F.coalesce("_since", F.lit(0)) >= least
    return rows.withColumn(into, F.col(on) & F.col("_up") & long).drop("_ran", "_up", "_since")


def smoothed_median(df: DataFrame, rows: int, value: str, into: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """`df` with the median of the last `rows` values, of as many as there are at first; a key's rows are spread over tasks."""
    median = lambda x, ks: x.withColumn(into, F.percentile(value, 0.5).over(Window.partitionBy(*ks).orderBy("t").rowsBetween(-(rows - 1), 0)))
    return by_rows(df, keys, rows, median)


def sustained(flag: Column | str, rows: int, keys: Sequence[str] = KEYS) -> Column:
    """Whether the flag holds in all of the last `rows` rows."""
    f = F.col(flag) if isinstance(flag, str) else flag
    return F.sum(F.coalesce(f, F.lit(False)).cast("int")).over(_w(keys).rowsBetween(-(rows - 1), 0)) == rows


def k_of_n(flag: Column | str, k: int, n: int, keys: Sequence[str] = KEYS) -> Column:
    """Whether the flag holds in `k` of the last `n` rows."""
    f = F.col(flag) if isinstance(flag, str) else flag
    return F.sum(F.coalesce(f, F.lit(False)).cast("int")).over(_w(keys).rowsBetween(-(n - 1), 0)) >= k


def hysteresis(df: DataFrame, high: float, low: float, keys: Sequence[str] = KEYS, value: str = "z", into: str = "armed") -> DataFrame:
    """`df` with `into`: on from `high`, off below `low`, else as before; off at first."""
    mark = F.when(F.col(value) >= high, True).when(F.col(value) < low, False)
    return scans.scan(df, keys, {into: scans.known(mark)}).withColumn(into, F.coalesce(into, F.lit(False)))


def sticky(flag: Column | str, span: int, keys: Sequence[str] = KEYS) -> Column:
    """Whether the flag held in [t - span, t]: the last time of it is `span` back at most, so that no frame is gone through anew."""
    f = F.col(flag) if isinstance(flag, str) else flag
    last = F.max(F.when(f, F.col("t"))).over(_w(keys).rangeBetween(Window.unboundedPreceding, 0))
    return F.coalesce(last >= F.col("t") - span, F.lit(False))


def frozen_flag(df: DataFrame, rows: int, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """`df` with frozen, whether the value hasn't changed in any of the last `rows` steps."""
    w = _w(keys).rowsBetween(-(rows - 1), 0)
    out = df.withColumn("_d", F.col(value) - F.lag(value).over(_w(keys)))
    return out.withColumn("frozen", (F.count("_d").over(w) == rows) & (F.count_if(F.col("_d") != 0).over(w) == 0)).drop("_d")


def gate_runs(df: DataFrame, flag: str, ok: str, mode: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """`df` with gated: "lock" is on from the first ok row of a run of `flag` to its end, "door" is the run if its first row is ok."""
    rows = runs(df, keys, flag, "_run")
    if mode == "lock":
        rows = scans.in_runs(rows, keys, "_run", {"_held": scans.extreme(F.col(ok))})
    else:  # what the run's first row says
        rows = scans.of_runs(rows, keys, "_run", {"_held": (F.min, F.struct("t", ok))}).withColumn("_held", F.col(f"_held.{ok}"))
    return rows.withColumn("gated", F.col(flag) & F.col("_held")).drop("_run", "_held")


def vote(df: DataFrame, keys: Sequence[str], flag: str, least: int) -> DataFrame:
    """(keys, votes, alarm): how many rows of the keys have the flag, and whether `least` do."""
    out = df.groupBy(*keys).agg(F.count_if(flag).alias("votes"))
    return out.withColumn("alarm", F.col("votes") >= least)


def sequence_to_point(df: DataFrame, k: int, width: int, keys: Sequence[str] = KEYS, flag: str = "is_anom") -> DataFrame:
    """`df`, one row a window with its end as t, with point: whether `k` of the last `width` windows have the flag."""
    return df.withColumn("point", k_of_n(flag, k, width, keys))


def operational_state(df: DataFrame, keys: Sequence[str], long_off: int, transient: int, on: str = "on") -> DataFrame:
    """`df` with state: on, off_short, off_long, or transient up to `transient` after a start; a run of off is long from `long_off` on."""
    rows = scans.of_runs(runs(df, keys, on, "_run"), keys, "_run", {"_from": (F.min, F.col("t")), "_to": (F.max, F.col("t"))})
    span, since = F.col("_to") - F.col("_from"), F.col("t") - F.col("_from")
    started = F.col("_run") > 1
    state = F.when(~F.col(on), F.when(span >= long_off, "off_long").otherwise("off_short")).when(started & (since <= transient), "transient").otherwise("on")
    return rows.withColumn("state", state).drop("_run", "_from", "_to")


def stabilised_cut(df: DataFrame, flag: str, strength: str, share: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """`df` with kept: the flag, until in its run the strength falls below `share` of the run's peak so far."""
    rows = runs(df, keys, flag, "_run")
    run = Window.partitionBy(*keys, "_run").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_low", F.col(strength) < share * F.max(strength).over(run))
    return rows.withColumn("kept", F.col(flag) & ~F.max("_low").over(run)).drop("_run", "_low")


def rearmed(df: DataFrame, keys: Sequence[str], flag: str, ceiling: int, rest: int) -> DataFrame:
    """`df` with kept: of each run of the flag at most `ceiling` rows, then again after `rest` rows of the same run."""
    rows = runs(df, keys, flag, "_run")
    place = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy("t")) - 1
    return rows.withColumn("kept", F.col(flag) & (place % (ceiling + rest) < ceiling)).drop("_run")


def escalate(df: DataFrame, keys: Sequence[str], flag: str, strength: str, age: int, level: float) -> DataFrame:
    """`df` with episode: runs of the flag, cut anew where a run older than `age` first reaches `level`."""
    rows = runs(df, keys, flag, "_run")
    inner = Window.partitionBy(*keys, "_run").orderBy("t")
    old = F.col("t") - F.min("t").over(Window.partitionBy(*keys, "_run")) > age
    high = F.col(flag) & old & (F.col(strength) >= level)
    rows = rows.withColumn("_high", high)
    seen = F.sum(F.col("_high").cast("int")).over(inner.rowsBetween(Window.unboundedPreceding, 0)) > 0
    rows = rows.withColumn("_part", F.when(seen, 1).otherwise(0))
    return rows.withColumn("episode", F.when(F.col(flag), F.concat_ws("-", "_run", "_part"))).drop("_run", "_high", "_part")


def state_of_value(df: DataFrame, keys: Sequence[str], long_off: int, pad: int, off_share: float = 0.05, jump_share: float = 0.99, off_limit: float | None = None, value: str = "value") -> DataFrame:
    """`df` with state from the value alone: off_short, off_long, transient or on.

    Off is a value at or below `off_limit`, or the `off_share` quantile of its
    key. A run of off is long from as many rows as `long_off` has median steps.
    On rows within `pad` of the edge of a run, and those that differ from the
    row before by the `jump_share` quantile of such differences or more, are
    transient.
    """
    w = _w(keys)
    rows = df.withColumn("_d", F.coalesce(F.abs(F.col(value) - F.lag(value).over(w)), F.lit(0.0))).withColumn("_step", F.col("t") - F.lag("t").over(w))
    off = F.percentile(value, off_share) if off_limit is None else F.lit(off_limit)
    limits = rows.groupBy(*keys).agg(off.alias("_off"), F.percentile("_d", jump_share).alias("_jump"), F.greatest(F.lit(1.0), F.ceil(long_off / F.percentile("_step", 0.5))).alias("_long"))
    rows = rows.join(limits, list(keys)).withColumn("_is", F.col(value) <= F.col("_off"))
    rows = runs(rows, keys, "_is", "_run").withColumn("_size", F.count("*").over(Window.partitionBy(*keys, "_run")))
    edge = F.coalesce((F.col("_is") != F.lag("_is").over(w)).cast("int"), F.lit(0))
    rows = rows.withColumn("_edge", edge).withColumn("_near", F.max("_edge").over(w.rangeBetween(-pad, pad)) == 1)
    jump = (F.col("_jump") > 0) & (F.col("_d") >= F.col("_jump"))
    state = F.when(F.col("_is"), F.when(F.col("_size") >= F.col("_long"), "off_long").otherwise("off_short")).when(F.col("_near") | jump, "transient").otherwise("on")
    return rows.withColumn("state", state).select(*df.columns, "state")


def cut_runs(df: DataFrame, flag: str, keys: Sequence[str] = KEYS, value: str = "value", span: int | None = None, calm: int | None = None, gain: float = 0.0, level: float | None = None) -> DataFrame:
    """`df` with kept and part of the runs of `flag`.

    kept ends `span` of time after a run's start, and at the first row from
    which the greatest value so far hasn't grown by the share `gain` over the
    `calm` rows before. part counts the rows at which the value passes `level`
    from below within a run: there a new episode starts.
    """
    inner = Window.partitionBy(*keys, "_run").orderBy("t")
    rows = runs(df, keys, flag, "_run")
    kept = F.col(flag)
    if span is not None:
        kept = kept & (F.col("t") - F.min("t").over(inner) <= span)
    if calm is not None:
        rows = rows.withColumn("_top", F.max(value).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn("_calm", F.coalesce(F.col("_top") <= F.lag("_top", calm).over(inner) * (1 + gain), F.lit(False)))
        kept = kept & ~F.max("_calm").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    part = F.lit(0).cast("long")
    if level is not None:
        rows = rows.withColumn("_rise", F.coalesce(F.col(flag) & (F.col(value) > level) & (F.lag(value).over(inner) <= level), F.lit(False)))
        part = F.sum(F.col("_rise").cast("long")).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("kept", kept).withColumn("part", part).select(*df.columns, "kept", "part")


def cut_by_fold(df: DataFrame, flag: str, grows: float, ceiling: int, rest: int, keys: Sequence[str] = KEYS, value: str = "value", block: int = scans.BLOCK) -> DataFrame:
    """`df` with part and kept, by rules whose state is all that went before; blocks of time are folded from a guess and corrected (see folds).

    Within a run of `flag`, part grows where the value is over `grows` times the
    least one since the last such row. kept holds for `ceiling` rows of the flag,
    then not until the flag has been off for `rest` rows in a row.
    """

    def run(rows: pd.DataFrame, before: tuple) -> tuple[dict[str, object], tuple]:
        up, x = rows[flag].to_numpy(bool, na_value=False).tolist(), np.nan_to_num(rows[value].to_numpy(float, na_value=np.nan)).tolist()
        part, kept = np.zeros(len(up), np.int64), np.zeros(len(up), bool)
        inside, floor, number, had, off = bool(before[0]), float(before[1]), *map(int, before[2:])
        for k, on in enumerate(up):
            if on:
                if not inside:
                    floor, number = x[k], 0
                elif floor > 0 and x[k] > grows * floor:
                    floor, number = x[k], number + 1
                else:
                    floor = min(floor, x[k])
                part[k], off = number, 0
                if had < ceiling:
                    had, kept[k] = had + 1, True
            else:
                off = min(off + 1, rest)
                floor, number = 0.0, 0  # of no use until the next run, so that states meet
                if off >= rest:
                    had = 0
            inside = on
        return {"part": part, "kept": kept}, (inside, floor, number, had, off)

    return folds.fold_series(df, keys, run, (False, 0.0, 0, 0, rest), "inside boolean, floor double, number long, had long, off long", "part long, kept boolean", block, [flag, value])
