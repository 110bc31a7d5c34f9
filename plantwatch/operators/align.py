"""Alignment: grids, as-of joins, range joins, overlaps.

Range conditions become equi-joins on buckets of time, so that no join falls
back to comparing all rows with all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.functions.columns import floor_to
from plantwatch.operators import scans


def regular_grid(df: DataFrame, step: int, keys: Sequence[str] = ("asset", "tag")) -> DataFrame:
    """Every step from the first to the last t of each key; the value is null where `df` has no row."""
    spans = df.groupBy(*keys).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    all_steps = spans.select(*keys, F.explode(F.sequence("a", "b", F.lit(step))).alias("t"))
    return all_steps.join(df, [*keys, "t"], "left")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], direction: str = "backward") -> DataFrame:
    """`left` with the columns of the nearest row of `right` at or before t ("backward"), at or after, or nearest ("nearest": the earlier one on ties).

    One union, whose rows are dealt to tasks by key and block of time; the row
    last seen is carried over the blocks. `t_match` is the time of the row taken.
    """
    pack = F.struct(F.col("t").alias("t_match"), *columns)
    rows = left.withColumn("_r", F.lit(None).cast(right.select(pack.alias("x")).schema["x"].dataType)).withColumn("_side", F.lit(1))
    other = right.select(*keys, "t", pack.alias("_r"), F.lit(0).alias("_side"))
    both = rows.unionByName(other, allowMissingColumns=True)
    if direction != "forward":
        both = scans.scan(both, keys, {"_back": scans.known(F.col("_r"))}, order=("t", "_side"))
    if direction != "backward":
        both = both.withColumn("_rank", -F.col("_side"))  # falling: at one time the right side comes first too
        both = scans.scan(both, keys, {"_ahead": scans.known(F.col("_r"), descending=True)}, order=("t", "_rank"), descending=True).drop("_rank")
    if direction == "nearest":
        nearer = F.col("_ahead.t_match") - F.col("t") < F.col("t") - F.col("_back.t_match")
        found = F.when(F.col("_back").isNull() | nearer, F.coalesce("_ahead", "_back")).otherwise(F.col("_back"))
    else:
        found = F.col("_back" if direction == "backward" else "_ahead")
    return both.withColumn("_f", found).where("_side = 1").select(*left.columns, "_f.*")


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], before: int, after: int, how: str = "inner") -> DataFrame:
    """Rows of `left` with those of `right` (column `u`) of the same keys with u in [t - before, t + after].

    Right rows have one bucket as wide as the range, left rows probe the two
    or three that their range touches.
    """
    width = max(1, before + after)
    probe = left.withColumn("_k", F.explode(F.sequence(floor_to(F.col("t") - before, width), floor_to(F.col("t") + after, width), F.lit(width))))
    bucketed = right.withColumn("_k", floor_to(F.col("u"), width))
    inside = F.col("u").between(F.col("t") - before, F.col("t") + after)
    if how == "inner":
        return probe.join(bucketed, [*keys, "_k"]).where(inside).drop("_k")
    hit = probe.join(bucketed, [*keys, "_k"]).where(inside).select(*keys, "t").distinct()
    return left.join(hit, [*keys, "t"], how)


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int, how: str = "inner") -> DataFrame:
    """Episodes (start, end) of `left` with the intervals (a, b) of `right` that they touch; both sides are put in buckets of `width`.

    A pair that shares several buckets is taken in the first of them.
    """
    own = left.withColumn("_k", F.explode(F.sequence(floor_to(F.col("start"), width), floor_to(F.col("end"), width), F.lit(width))))
    other = right.withColumn("_k", F.explode(F.sequence(floor_to(F.col("a"), width), floor_to(F.col("b"), width), F.lit(width))))
    touch = (F.col("a") <= F.col("end")) & (F.col("b") >= F.col("start")) & (F.col("_k") == floor_to(F.greatest("a", "start"), width))
    found = own.join(other, [*keys, "_k"]).where(touch).drop("_k")
    if how == "inner":
        return found
    return left.join(found.select(*keys, "start", "end").distinct(), [*keys, "start", "end"], how)


def leave_one_out(df: DataFrame, group: Sequence[str], least: int = 2, value: str = "value", otherwise: Column | None = None) -> DataFrame:
    """`df` with residual = value - mean of the other valid values of its group; null (or `otherwise`) with fewer than `least` others."""
    w = Window.partitionBy(*group)
    total, n = F.sum(value).over(w), F.count(value).over(w)
    rest = F.when((n - 1 >= least) & F.col(value).isNotNull(), F.col(value) - (total - F.col(value)) / (n - 1))
    return df.withColumn("residual", rest if otherwise is None else F.coalesce(rest, otherwise))


def aligned(df: DataFrame, keys: Sequence[str], tags: Sequence[str], whole: bool = True) -> DataFrame:
    """Wide form, one column a tag; `whole` keeps the rows that have all tags."""
    wide = df.groupBy(*keys).pivot("tag", list(tags)).agg(F.first("value"))
    return wide.dropna("any", subset=list(tags)) if whole else wide
