"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.tables import cut_lineage


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (u long, v long).

    The component is the smallest node reachable. Large-star and small-star
    rounds alternate until the edges are stars apart from each other; each is a
    few grouped minimums and joins, so a node with very many edges is summed
    before it is shuffled, and no component is gathered anywhere. Loops and
    repeated edges are ignored; an edge with a null end is ignored too.
    """
    edges = cut_lineage(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        if _stars_apart(edges):
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")  # repeats, one an edge at most, go with those of the small stars
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = cut_lineage(small)
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars_apart(edges: DataFrame) -> bool:
    """Whether each node is the greater end of one edge at most and, if it is, the lesser end of none: then no round changes an edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    roles = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return roles.agg(F.max((F.col("up") + F.when(F.col("up") > 0, F.col("down")).otherwise(0)))).first()[0] in (None, 0, 1)
