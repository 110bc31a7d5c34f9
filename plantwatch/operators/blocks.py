"""Physical patterns for long single series: blocks with a halo, block scans.

A window function keeps one key in one task. A bounded look-back doesn't need
that: rows are keyed by (key, block of time) too, and each block gets copies of
the rows that its first rows look back to. A linear recurrence is computed in
blocks, carried over the block totals, and applied.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.functions.columns import floor_to


def with_halo(df: DataFrame, block: int, back: int, ahead: int = 0, order: str = "t", outer: bool = False) -> DataFrame:
    """`df` with columns _block and _own: each row in its own block of `order`, and as a halo in those that look back or ahead to it.

    A row is copied at most ceil(back / block) + ceil(ahead / block) times. Rows
    with a null `order` are left out; with `outer` they are the null block.
    """
    if block < 1:
        raise ValueError("block must be positive")
    own = floor_to(F.col(order), block)
    first, last = floor_to(F.col(order) - ahead, block), floor_to(F.col(order) + back, block)
    copies = (F.explode_outer if outer else F.explode)(F.sequence(first, last, F.lit(block)))
    return df.withColumn("_block", copies).withColumn("_own", F.col("_block").eqNullSafe(own))


def rolling(df: DataFrame, keys: Sequence[str], back: int, columns: dict[str, Callable[[Window], Column]], ahead: int = 0, block: int | None = None) -> DataFrame:
    """`df` with `columns` computed over the rows with t in [t - back, t + ahead] of the same keys.

    With `block`, a key's rows are spread over tasks by blocks of that length.
    """
    if block is None:
        frame = Window.partitionBy(*keys).orderBy("t").rangeBetween(-back, ahead)
        return df.withColumns({k: f(frame) for k, f in columns.items()})
    frame = Window.partitionBy(*keys, "_block").orderBy("t").rangeBetween(-back, ahead)
    wide = with_halo(df, block, back, ahead).withColumns({k: f(frame) for k, f in columns.items()})
    return wide.where("_own").drop("_block", "_own")


def row_numbers(df: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """`df` with n, the row's number in its key from 0 by t; numbered in blocks, then shifted by the rows of the blocks before."""
    df = df.withColumn("_block", floor_to(F.col("t"), block))
    sizes = df.groupBy(*keys, "_block").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).drop("_c")
    number = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("t")) - 1
    return df.withColumn("_k", number).join(sizes, [*keys, "_block"]).withColumn("n", (F.col("_k") + F.col("_before")).cast("long")).drop("_k", "_before", "_block")


def by_rows(df: DataFrame, keys: Sequence[str], back: int, compute: Callable[[DataFrame, list[str]], DataFrame], ahead: int = 0, block: int = 200_000, span: int = 10 * 86_400 * 1_000_000) -> DataFrame:
    """What `compute(rows, keys)` gives for every row, with a key's rows dealt to tasks by blocks of `block` rows.

    `compute` may look `back` rows back and `ahead` rows ahead along t and keeps
    all columns; it is called with the block as one more key. Rows are numbered
    in blocks of `span` of time. Times of a key are distinct.
    """
    wide = with_halo(row_numbers(df, keys, span), block, back, ahead, "n").drop("n")
    return compute(wide, [*keys, "_block"]).where("_own").drop("_block", "_own")


def decayed_sums(df: DataFrame, keys: Sequence[str], order: str, half_life: float, columns: dict[str, Column], block: float | None = None) -> DataFrame:
    """`df` with running sums of `columns` in which a row's term halves with every `half_life` of `order` that passes.

    Null terms add nothing. Blocks span 200 half-lives, in which the closed
    form sum(x * 2^(i / h)) * 2^(-p / h) neither overflows nor loses digits;
    the carries over the blocks are a window over one row a block.
    """
    span = float(block or 200 * half_life)
    place = F.col(order).cast("double")
    df = df.withColumn("_b", F.floor(place / span).cast("long")).withColumn("_p", (place - F.col("_b") * span) / half_life)
    run = Window.partitionBy(*keys, "_b").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    local = {f"_l{i}": F.coalesce(F.sum(x * F.pow(F.lit(2.0), F.col("_p"))).over(run), F.lit(0.0)) for i, x in enumerate(columns.values())}
    totals = df.groupBy(*keys, "_b").agg(*(F.coalesce(F.sum(x * F.pow(F.lit(2.0), F.col("_p"))), F.lit(0.0)).alias(f"_s{i}") for i, x in enumerate(columns.values())))
    # carry into block b, measured at its start: the last three blocks before it that aren't nought, each decayed from its own
    # start; what lies before them is less than 2^-200 of what they hold
    sums = [f"_s{i}" for i in range(len(columns))]
    along = Window.partitionBy(*keys).orderBy("_b")
    held = F.struct(F.col("_b").alias("b"), *sums)
    some = totals.where(" or ".join(f"{c} <> 0" for c in sums)).select(*keys, "_b", held.alias("_p1"))
    some = some.select(*keys, "_b", F.struct("_p1", F.lag("_p1", 1).over(along).alias("_p2"), F.lag("_p1", 2).over(along).alias("_p3")).alias("_p"))
    before = F.last("_p", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.join(some, [*keys, "_b"], "left").withColumn("_p", before)
    fade = lambda p: F.pow(F.lit(2.0), (p["b"] - F.col("_b")) * (span / half_life))
    carry = lambda c: sum((F.coalesce(F.col("_p")[k][c] * fade(F.col("_p")[k]), F.lit(0.0)) for k in ("_p2", "_p3")), F.coalesce(F.col("_p")["_p1"][c] * fade(F.col("_p")["_p1"]), F.lit(0.0)))
    names = [f"_c{i}" for i in range(len(columns))]
    carried = carried.select(*keys, "_b", *(carry(c).alias(n) for c, n in zip(sums, names, strict=True)))
    df = df.withColumns(local).join(carried, [*keys, "_b"])
    fade = F.pow(F.lit(2.0), -F.col("_p"))
    return df.withColumns({k: (F.col(f"_l{i}") + F.col(f"_c{i}")) * fade for i, k in enumerate(columns)}).drop("_b", "_p", *local, *names)
