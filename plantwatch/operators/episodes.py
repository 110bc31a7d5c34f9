"""Runs, episodes and the rules on them. Points become episodes first; greedy rules fold over the few episodes of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.operators import scans


def runs(df: DataFrame, keys: Sequence[str], flag: str, into: str = "run") -> DataFrame:
    """`df` with a run number that grows by one wherever `flag` changes along t; a null flag is a value of its own."""
    return scans.run_numbers(df, keys, flag, into)


def chain(df: DataFrame, keys: Sequence[str], gap: int, into: str = "episode", strict: bool = False) -> DataFrame:
    """`df` with an episode number: a gap over `gap` since the row before starts a new one; `strict`: a gap of `gap` too."""
    return scans.chains(df, keys, gap, into, strict)


def episodes(df: DataFrame, keys: Sequence[str], gap: int, strict: bool = False, **more: Column) -> DataFrame:
    """(keys, episode, start, end, points, more...) of the chained rows."""
    return chain(df, keys, gap, strict=strict).groupBy(*keys, "episode").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("points"), *(c.alias(k) for k, c in more.items()))


def drop_short_runs(df: DataFrame, keys: Sequence[str], flag: str, least: int | Column) -> DataFrame:
    """`df` with `flag` false in runs of fewer than `least` rows."""
    sized = scans.of_runs(runs(df, keys, flag, "_run"), keys, "_run", {"_size": (F.count, F.lit(1))})
    return sized.withColumn(flag, F.col(flag) & (F.col("_size") >= least)).drop("_run", "_size")


def _fold(rows: DataFrame, keys: Sequence[str], state: Column, step, columns: Sequence[str]) -> DataFrame:
    """Rows (with `start` as order) of each key through a fold that appends what it keeps to `out`."""
    ordered = F.array_sort(F.collect_list(F.struct(*columns)))
    return rows.groupBy(*keys).agg(F.aggregate(ordered, state, step)["out"].alias("_o")).select(*keys, F.explode("_o").alias("_o")).select(*keys, "_o.*")


def _empty(rows: DataFrame, columns: Sequence[str]) -> Column:
    kinds = ",".join(f"{c}:{rows.schema[c].dataType.simpleString()}" for c in columns)
    return F.array().cast(f"array<struct<{kinds}>>").alias("out")


def anchored(df: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """(keys, t): rows farther than `gap` from the last row kept."""
    start = F.struct(F.lit(None).cast("long").alias("last"), _empty(df, ["t"]))

    def step(acc: Column, x: Column) -> Column:
        keep = acc["last"].isNull() | (x["t"] - acc["last"] > gap)
        return F.struct(F.when(keep, x["t"]).otherwise(acc["last"]).alias("last"), F.when(keep, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

    return _fold(df, keys, start, step, ["t"])


def refractory(rows: DataFrame, keys: Sequence[str], hold: int, strength: str | None = None, stronger: float = 0.0, old: int = 0) -> DataFrame:
    """Episodes that start later than `hold` after the end of the last one kept.

    With `strength`, an earlier one stays too if it reaches `stronger` and
    starts `old` or more after the last one's end.
    """
    columns = ["start", "end", *([strength] if strength else [])]
    state = F.struct(F.lit(None).cast("long").alias("until"), _empty(rows, columns))

    def step(acc: Column, x: Column) -> Column:
        keep = acc["until"].isNull() | (x["start"] > acc["until"] + hold)
        if strength:
            keep = keep | ((x[strength] >= stronger) & (x["start"] >= acc["until"] + old))
        return F.struct(F.when(keep, x["end"]).otherwise(acc["until"]).alias("until"), F.when(keep, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

    return _fold(rows, keys, state, step, columns)


def min_duration(rows: DataFrame, least: int, step: int = 0, strength: str | None = None, stronger: float = 0.0, least_if_strong: int = 0) -> DataFrame:
    """Episodes whose end - start + step is `least` or more; strong ones may be shorter."""
    long = F.col("end") - F.col("start") + step
    ok = long >= least
    return rows.where(ok | ((F.col(strength) >= stronger) & (long >= least_if_strong)) if strength else ok)


def ok_aware(alarms: DataFrame, keys: Sequence[str], least: int = 0, ok: str = "OK") -> DataFrame:
    """(keys, start, end): from the first alarm after an OK to the next OK; shorter than `least` are dropped, open ones stay with a null end."""
    w = Window.partitionBy(*keys).orderBy("t")
    is_ok = F.col("condition") == ok
    segment = F.sum(is_ok.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - is_ok.cast("int")
    seg = alarms.withColumn("_s", segment).groupBy(*keys, "_s").agg(F.min(F.when(~is_ok, F.col("t"))).alias("start"), F.max(F.when(is_ok, F.col("t"))).alias("end"))
    return seg.where(F.col("start").isNotNull() & (F.col("end").isNull() | (F.col("end") - F.col("start") >= least))).drop("_s")


def active_intervals(alarms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, start, end): ACT opens if closed, the next INACT closes; one left open ends at the last row of the key."""
    w = Window.partitionBy(*keys).orderBy("t")
    off = F.col("status") == "INACT"
    segment = F.sum(off.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - off.cast("int")
    rows = alarms.withColumn("_s", segment).withColumn("_last", F.max("t").over(Window.partitionBy(*keys)))
    seg = rows.groupBy(*keys, "_s").agg(F.min(F.when(~off, F.col("t"))).alias("start"), F.coalesce(F.max(F.when(off, F.col("t"))), F.max("_last")).alias("end"))
    return seg.where("start is not null").drop("_s")
