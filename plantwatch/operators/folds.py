"""Folds along a series whose steps aren't associative, in speculative blocks.

The state after a block depends on the state before it, so a fold seems to need
the series in one task. But most folds forget: trajectories from different
states meet, at a zero or a restart. So all blocks are folded at once from a
guess of their first state; then only the blocks whose guess was wrong are
folded again, from the last state of the block before, until none is. A block's
guess is right after as many rounds as trajectories take blocks to meet: two or
three for rules that restart, and at most one round for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.functions.columns import floor_to
from plantwatch.operators.lineage import cut_lineage
from plantwatch.operators.scans import BLOCK

#: Takes a block's rows in time order and the state before them; gives the columns to add, and the state after.
Fold = Callable[[pd.DataFrame, tuple], tuple[dict[str, object], tuple]]


def fold_series(df: DataFrame, keys: Sequence[str], fold: Fold, first: tuple, state: str, columns: str, block: int = BLOCK, inputs: Sequence[str] | None = None) -> DataFrame:
    """`df` with `columns` (a schema) that `fold` gives for each row along t, from the state `first` (of schema `state`) on.

    Blocks span `block` of time; times of a key are distinct, keys aren't null.
    A state is a tuple of numbers and flags, compared exactly. Only `inputs` and
    t go to the rounds; the last pass adds the columns to the whole rows.
    """
    names = [part.split()[0] for part in columns.split(", ")]
    parts = [part.split()[0] for part in state.split(", ")]
    own = f"struct<{', '.join(f'{p.split()[0]}:{p.split()[1]}' for p in state.split(', '))}>"
    rows = df.withColumn("_fo_b", floor_to(F.col("t"), block))
    ids = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", _fo_b long"
    at = [*keys, "_fo_b"]
    lean = rows.select(*at, "t", *(c for c in (inputs or df.columns) if c not in (*at, "t")))
    begin = F.struct(*map(F.lit, first)).cast(own)

    def ends(_, block_rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        if not len(starts) or not len(block_rows):
            return pd.DataFrame({c: [] for c in (*at, *parts)})
        ordered = block_rows.sort_values("t", kind="stable")
        last = fold(ordered, tuple(starts.iloc[0][p] for p in parts))[1]
        return pd.DataFrame([[*(ordered.iloc[0][c] for c in at), *last]], columns=[*at, *parts])

    spread = lambda c: [F.col(f"{c}.{p}").alias(p) for p in parts]
    known = cut_lineage(rows.select(*at).distinct().withColumn("_fo_start", begin).withColumn("_fo_end", F.lit(None).cast(own)).withColumn("_fo_do", F.lit(True)))
    along = Window.partitionBy(*keys).orderBy("_fo_b")
    while True:
        todo = known.where("_fo_do").select(*at, *spread("_fo_start"))
        chosen = known.where("_fo_do").select(*(F.col(c).alias(c) for c in at))
        folded = lean.join(chosen, at, "left_semi").groupBy(*at).cogroup(todo.groupBy(*at)).applyInPandas(ends, f"{ids}, {state}")
        folded = folded.select(*at, F.struct(*parts).cast(own).alias("_fo_got"))
        after = known.join(folded, at, "left").withColumn("_fo_end", F.coalesce("_fo_got", "_fo_end")).drop("_fo_got")
        right = F.coalesce(F.lag("_fo_end").over(along), begin)
        after = after.withColumn("_fo_right", right).withColumn("_fo_do", ~F.col("_fo_right").eqNullSafe(F.col("_fo_start")))
        known = cut_lineage(after.select(*at, F.col("_fo_right").alias("_fo_start"), "_fo_end", "_fo_do"))
        if known.where("_fo_do").isEmpty():
            break

    def add(_, block_rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        ordered = block_rows.sort_values("t", kind="stable")
        found, _ = fold(ordered, tuple(starts.iloc[0][p] for p in parts))
        return ordered.drop(columns="_fo_b").assign(**{n: found[n] for n in names})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    starts = known.select(*at, *spread("_fo_start"))
    return rows.groupBy(*at).cogroup(starts.groupBy(*at)).applyInPandas(add, f"{schema}, {columns}")
