"""Scans along a series in blocks of time, for any associative summary.

A window over a whole key keeps it in one task. Here a key's rows are dealt to
tasks by block of time. Each block is summarised in one row, a window over these
few rows gives what lies before (or after) each block, and a window inside the
block adds it. All blocks of all keys go through the same two passes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from plantwatch.functions.columns import DAY, floor_to

#: Time that a block spans. A key's blocks are one row each in the second pass.
BLOCK = 30 * DAY


@dataclass(frozen=True)
class Summary:
    """An associative summary: over the rows of a frame so far, of a block, of the blocks before, and what comes before joined to what comes after."""

    running: Callable[[WindowSpec], Column]
    block: Callable[[Sequence[str]], Column]
    over: Callable[[str, WindowSpec], Column]
    joined: Callable[[Column, Column], Column]


def known(value: Column, descending: bool = False) -> Summary:
    """The last value that isn't null; with `descending` rows come in falling order, so it is the next one."""

    def block(order: Sequence[str]) -> Column:
        pick = F.min_by if descending else F.max_by
        return pick(value, F.when(value.isNotNull(), F.struct(*order)))

    return Summary(lambda w: F.last(value, ignorenulls=True).over(w), block, lambda c, w: F.last(c, ignorenulls=True).over(w), lambda before, own: F.coalesce(own, before))


def total(value: Column) -> Summary:
    """The running sum; nulls add nothing."""
    zero = F.lit(0).cast("long")
    return Summary(lambda w: F.coalesce(F.sum(value).over(w), zero), lambda order: F.coalesce(F.sum(value), zero), lambda c, w: F.sum(c).over(w), lambda before, own: F.coalesce(before, zero) + own)


def extreme(value: Column, least: bool = False) -> Summary:
    """The greatest value so far, or the least; null before the first."""
    f, two = (F.min, F.least) if least else (F.max, F.greatest)
    return Summary(lambda w: f(value).over(w), lambda order: f(value), lambda c, w: f(c).over(w), two)


def scan(df: DataFrame, keys: Sequence[str], columns: dict[str, Summary], block: int = BLOCK, order: Sequence[str] = ("t",), descending: bool = False, inclusive: bool = True) -> DataFrame:
    """`df` with each summary of the rows up to its own in its keys by `order`, whose first column is a time; `inclusive`: its own too.

    With `descending` rows come in falling order, so summaries are of the row
    and those after it. Null keys are a key of their own; rows with a null time
    come first.
    """
    along = [F.desc(c) if descending else F.asc(c) for c in order]
    rows = df.withColumn("_sc_b", floor_to(F.col(order[0]), block))
    last = 0 if inclusive else -1
    inner = Window.partitionBy(*keys, "_sc_b").orderBy(*along).rowsBetween(Window.unboundedPreceding, last)
    sums = rows.groupBy(*keys, "_sc_b").agg(*(s.block(order).alias(f"_sc_s{k}") for k, s in enumerate(columns.values())))
    blocks = Window.partitionBy(*keys).orderBy(F.desc("_sc_b") if descending else F.asc("_sc_b")).rowsBetween(Window.unboundedPreceding, -1)
    named = {key: f"_sc_k{i}" for i, key in enumerate((*keys, "_sc_b"))}
    before = sums.select(*(F.col(key).alias(n) for key, n in named.items()), *(s.over(f"_sc_s{k}", blocks).alias(f"_sc_c{k}") for k, s in enumerate(columns.values())))
    local = rows.withColumns({f"_sc_l{k}": s.running(inner) for k, s in enumerate(columns.values())})
    same = None
    for key, n in named.items():
        one = F.col(key).eqNullSafe(F.col(n))
        same = one if same is None else same & one
    found = local.join(before, same, "left")
    return found.select(*df.columns, *(s.joined(F.col(f"_sc_c{k}"), F.col(f"_sc_l{k}")).alias(name) for k, (name, s) in enumerate(columns.items())))


def stretches(df: DataFrame, keys: Sequence[str], held: Column, new: Callable[[Column, Column], Column], into: str, block: int = BLOCK) -> DataFrame:
    """`df` with a number from 1 that grows at each row for which `new(before, own)` holds along t, given `held` of the row before and its own.

    Rows of one time are in the order of `held`, so that their order is defined.
    A block's summary is `held` of its first and last row and the new stretches
    inside; the one at its start is known once the block before is.
    """
    rows = df.withColumn("_sc_b", floor_to(F.col("t"), block)).withColumn("_sc_h", F.struct(held.alias("v")))  # a struct, so that null is a value
    w = Window.partitionBy(*keys, "_sc_b").orderBy("t", "_sc_h")
    before = F.lag("_sc_h").over(w)
    rows = rows.withColumn("_sc_new", F.when(before.isNull(), 0).otherwise(F.coalesce(new(before["v"], F.col("_sc_h.v")), F.lit(True)).cast("long")))
    ends = rows.groupBy(*keys, "_sc_b").agg(F.sum("_sc_new").alias("_sc_n"), F.min_by("_sc_h", F.struct("t", "_sc_h")).alias("_sc_first"), F.max_by("_sc_h", F.struct("t", "_sc_h")).alias("_sc_last"))
    along = Window.partitionBy(*keys).orderBy("_sc_b")
    last = F.lag("_sc_last").over(along)
    ends = ends.withColumn("_sc_more", F.when(last.isNull(), 1).otherwise(F.coalesce(new(last["v"], F.col("_sc_first.v")), F.lit(True)).cast("long")))
    ends = ends.withColumn("_sc_from", F.sum(F.col("_sc_n") + F.col("_sc_more")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sc_n"))
    inner = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(ends.select(*keys, "_sc_b", "_sc_from"), [*keys, "_sc_b"]).withColumn(into, F.col("_sc_from") + F.sum("_sc_new").over(inner)).select(*df.columns, into)


def run_numbers(df: DataFrame, keys: Sequence[str], flag: str, into: str = "run", block: int = BLOCK) -> DataFrame:
    """`df` with a run number from 1 that grows wherever `flag` changes along t; a null flag is a value of its own."""
    return stretches(df, keys, F.col(flag), lambda a, b: ~a.eqNullSafe(b), into, block)


def chains(df: DataFrame, keys: Sequence[str], gap: int, into: str = "episode", strict: bool = False, block: int = BLOCK) -> DataFrame:
    """`df` with a number from 1 that grows where the time since the row before is over `gap`; `strict`: `gap` or over."""
    return stretches(df, keys, F.col("t"), lambda a, b: b - a >= gap if strict else b - a > gap, into, block)


def of_runs(df: DataFrame, keys: Sequence[str], run: str, columns: dict[str, tuple[Callable[..., Column], Column]], block: int = BLOCK) -> DataFrame:
    """`df` with aggregates of its whole run: name -> (F.min, F.max, F.sum or F.count, of what).

    A run may be a whole series, so it is aggregated in blocks first, and each
    block of it gets the result.
    """
    merge = {F.count: F.sum}
    rows = df.withColumn("_sc_b", floor_to(F.col("t"), block))
    parts = rows.groupBy(*keys, run, "_sc_b").agg(*(f(x).alias(f"_sc_p{k}") for k, (f, x) in enumerate(columns.values())))
    whole = Window.partitionBy(*keys, run)
    parts = parts.select(*keys, run, "_sc_b", *(merge.get(f, f)(f"_sc_p{k}").over(whole).alias(name) for k, (name, (f, _)) in enumerate(columns.items())))
    return rows.join(parts, [*keys, run, "_sc_b"]).select(*df.columns, *columns)


def in_runs(df: DataFrame, keys: Sequence[str], run: str, columns: dict[str, Summary], block: int = BLOCK) -> DataFrame:
    """`df` with summaries of the rows of its run up to its own."""
    return scan(df, [*keys, run], columns, block)
