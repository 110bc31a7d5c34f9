"""Cleaning of series: masks, filters, fills, scaling. Masked values become null; rows stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.operators import quantiles, scans
from plantwatch.operators.episodes import runs

KEYS = ("asset", "tag")


def mask_range(df: DataFrame, low: Column | float, high: Column | float, value: str = "value") -> DataFrame:
    """`df` with values outside [low, high] null, and masked, whether that was done."""
    inside = F.col(value).between(F.lit(low), F.lit(high))
    return df.withColumn("masked", F.coalesce(~inside, F.lit(False))).withColumn(value, F.when(inside, F.col(value)))


def mask_by_limits(df: DataFrame, limits: DataFrame, on: Sequence[str] = ("tag",), value: str = "value") -> DataFrame:
    """Masks by a table of limits (on, low, high), one row a tag or family; tags without limits stay."""
    joined = df.join(limits, list(on), "left")
    inside = F.col("low").isNull() | F.col(value).between(F.col("low"), F.col("high"))
    return joined.withColumn(value, F.when(inside, F.col(value))).drop("low", "high")


def first_by_time(df: DataFrame, keys: Sequence[str] = KEYS, order: str = "ordinal") -> DataFrame:
    """One row for each key and t, the first by `order`."""
    n = F.row_number().over(Window.partitionBy(*keys, "t").orderBy(order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def long_gaps(df: DataFrame, limit: int, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """`df` with long_gap, whether the row is in a run of more than `limit` nulls."""
    flagged = runs(df.withColumn("_null", F.col(value).isNull()), keys, "_null", "_run")
    size = F.count("*").over(Window.partitionBy(*keys, "_run"))
    return flagged.withColumn("long_gap", F.col("_null") & (size > limit)).drop("_null", "_run")


def interpolate(df: DataFrame, limit: int, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """`df` with filled: on the straight line by position, at most `limit` rows from each side of a gap; the ends are held, as far."""
    rows = scans.scan(df, keys, {"_n": scans.total(F.lit(1))})
    known = F.when(F.col(value).isNotNull(), F.struct("_n", F.col(value).alias("v")))
    rows = scans.scan(rows, keys, {"_p": scans.known(known)})
    rows = scans.scan(rows, keys, {"_q": scans.known(known, descending=True)}, descending=True)
    near = F.least(F.col("_n") - F.col("_p._n"), F.col("_q._n") - F.col("_n")) <= limit
    line = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * (F.col("_n") - F.col("_p._n")) / (F.col("_q._n") - F.col("_p._n"))
    held = F.coalesce("_p.v", "_q.v")
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(near, F.when(F.col("_p").isNull() | F.col("_q").isNull(), held).otherwise(line))
    return rows.withColumn("filled", filled).drop("_n", "_p", "_q")


def fill_all(df: DataFrame, limit: int, keys: Sequence[str] = KEYS, value: str = "value", weighted: bool = True, otherwise: float | None = None) -> DataFrame:
    """`df` with filled: as `interpolate`; then what a gap has left on the line by time between the filled rows beside it (`weighted`) or carried from before; then held ends; then `otherwise`.

    Without `otherwise`, series without values stay null.
    """
    rows = interpolate(df, limit, keys, value)
    known = F.when(F.col("filled").isNotNull(), F.struct("t", F.col("filled").alias("v")))
    rows = scans.scan(rows, keys, {"_p": scans.known(known)})
    rows = scans.scan(rows, keys, {"_q": scans.known(known, descending=True)}, descending=True)
    line = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * ((F.col("t") - F.col("_p.t")) / (F.col("_q.t") - F.col("_p.t")))
    rest = F.coalesce(*([F.when(F.col("_p.t") < F.col("_q.t"), line)] if weighted else []), "_p.v", "_q.v", *([F.lit(otherwise)] if otherwise is not None else []))
    return rows.withColumn("filled", F.coalesce("filled", rest)).drop("_p", "_q")


def constant_runs(df: DataFrame, least: int, keys: Sequence[str] = KEYS, value: str = "value", back_spill: bool = False) -> DataFrame:
    """`df` with constant, whether the row is in a run of `least` equal values; `back_spill` marks the row before a run too."""
    w = Window.partitionBy(*keys).orderBy("t")
    same = F.coalesce(F.col(value) == F.lag(value).over(w), F.lit(False))
    rows = df.withColumn("_new", (~same).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count("*").over(Window.partitionBy(*keys, "_run"))
    rows = rows.withColumn("constant", (size >= least) & F.col(value).isNotNull())
    if back_spill:
        rows = rows.withColumn("constant", F.col("constant") | F.coalesce(F.lead("constant").over(w), F.lit(False)))
    return rows.drop("_new", "_run")


def fabricated(df: DataFrame, least_rows: int, fraction: float, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """`df` with fabricated: its second difference stays under `fraction` of the key's median one for `least_rows` rows; the first two rows never."""
    w = Window.partitionBy(*keys).orderBy("t")
    rows = df.withColumn("_d2", F.abs(F.col(value) - 2 * F.lag(value).over(w) + F.lag(value, 2).over(w)))
    typical = rows.groupBy(*keys).agg(F.percentile("_d2", 0.5).alias("_typical"))
    rows = rows.join(typical, list(keys)).withColumn("_flat", F.coalesce(F.col("_d2") < fraction * F.col("_typical"), F.lit(False)))
    size = F.count("*").over(Window.partitionBy(*keys, "_run"))
    return runs(rows, keys, "_flat", "_run").withColumn("fabricated", F.col("_flat") & (size >= least_rows)).drop("_d2", "_typical", "_flat", "_run")


def hampel(df: DataFrame, half: int, sigma: float = 3.0, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """`df` with cleaned: the median of the 2 half + 1 rows around where the value is more than sigma scaled MADs off.

    The deviations are from the moving median of each row, and windows shrink
    at the ends, as the moving median does.
    """
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(-half, half)
    rows = df.withColumn("_m", F.percentile(value, 0.5).over(w)).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    rows = rows.withColumn("_mad", F.percentile("_d", 0.5).over(w))
    return rows.withColumn("cleaned", F.when(F.col("_d") > sigma * 1.4826 * F.col("_mad"), F.col("_m")).otherwise(F.col(value))).drop("_m", "_d", "_mad")


def clip_bounds(df: DataFrame, how: str = "quantile", low: float = 0.01, high: float = 0.99, k: float = 5.0, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """(keys, low, high) by quantiles, or median -+ k MADs with a MAD of 0 taken as 1e-9."""
    if how == "quantile":
        return df.groupBy(*keys).agg(F.percentile(value, low).alias("low"), F.percentile(value, high).alias("high"))
    mid = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("_m"))
    mad = df.join(mid, list(keys)).groupBy(*keys, "_m").agg(F.percentile(F.abs(F.col(value) - F.col("_m")), 0.5).alias("_d"))
    d = F.when(F.col("_d") == 0, 1e-9).otherwise(F.col("_d"))
    return mad.select(*keys, (F.col("_m") - k * d).alias("low"), (F.col("_m") + k * d).alias("high"))


def clip(df: DataFrame, bounds: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """`df` with values moved to the nearer bound; keys without bounds stay, nulls too."""
    joined = df.join(bounds, list(keys), "left")
    inner = F.when(F.col(value).isNotNull(), F.greatest(F.least(F.col(value), F.col("high")), F.col("low")))
    return joined.withColumn(value, inner).drop("low", "high")


def scales(df: DataFrame, how: str = "robust", keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """(keys, center, scale): mean and sample deviation, or median and interquartile range; a scale of 0 is 1."""
    if how == "zscore":
        center, scale = F.avg(value), F.stddev_samp(value)
    else:
        center, scale = F.percentile(value, 0.5), F.percentile(value, 0.75) - F.percentile(value, 0.25)
    return df.groupBy(*keys).agg(center.alias("center"), scale.alias("scale")).withColumn("scale", F.coalesce(F.when(F.col("scale") != 0, F.col("scale")), F.lit(1.0)))


def normalize(df: DataFrame, params: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """`df` with z by the stored center and scale of its key."""
    return df.join(params, list(keys)).withColumn("z", (F.col(value) - F.col("center")) / F.col("scale")).drop("center", "scale")


def stable(df: DataFrame, quantile: float, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """`df` with stable, whether the step from the row before is within the key's quantile of steps; false for the first."""
    d = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy("t")))
    rows = df.withColumn("_d", d)
    edge = quantiles.cut_points(rows, keys, "_d", {"_e": quantile})
    return rows.join(edge, list(keys)).withColumn("stable", F.coalesce(F.col("_d") <= F.col("_e"), F.lit(False))).drop("_d", "_e")


def merged_windows(events: DataFrame, keys: Sequence[str], before: int, after: int) -> DataFrame:
    """(keys, a, b): the union of [t - before, t + after] of all events as disjoint intervals."""
    w = Window.partitionBy(*keys).orderBy("a")
    spans = events.select(*keys, (F.col("t") - before).alias("a"), (F.col("t") + after).alias("b"))
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("a") <= reach, 0).otherwise(1)
    group = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("_n", new).withColumn("_g", group).groupBy(*keys, "_g").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_g")


def near_events(df: DataFrame, events: DataFrame, keys: Sequence[str], before: int, after: int, into: str = "excluded") -> DataFrame:
    """`df` with whether t is in [event - before, event + after] of an event: only the last event at or before t + before can decide."""
    marks = events.select(*keys, (F.col("t") - before).alias("t"), F.lit(True).alias("_mark"))
    rows = df.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("_mark"), F.col("t"))).over(w)
    inside = F.coalesce(F.col("t") - last <= before + after, F.lit(False))
    return rows.withColumn(into, inside).where("not _mark").drop("_mark")


def starts(df: DataFrame, keys: Sequence[str], on: str = "on", first_counts: bool = True) -> DataFrame:
    """`df` with start, whether the machine is on and was off in the row before; a first row that is on counts if `first_counts`."""
    before = F.lag(on).over(Window.partitionBy(*keys).orderBy("t"))
    return df.withColumn("start", F.col(on) & ~F.coalesce(before, F.lit(not first_counts)))


def since_start(df: DataFrame, keys: Sequence[str], on: str = "on", first_counts: bool = True) -> DataFrame:
    """`df` with since, the time since the last start; null before the first one."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = starts(df, keys, on, first_counts)
    return rows.withColumn("since", F.col("t") - F.max(F.when(F.col("start"), F.col("t"))).over(w))
