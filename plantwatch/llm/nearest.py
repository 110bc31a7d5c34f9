"""Nearest vectors by cosine through vantage-point trees.

Vectors are scaled to length one, where the Euclidean distance orders as the
cosine does. A small vantage-point tree over a bounded sample deals all vectors
to at most ROUTES regions, regions of many vectors to several shards; each shard
is indexed whole by a tree of its own. A branch, and a region, is left out when
the triangle inequality, with the distance to the k-th neighbour so far
multiplied by `factor`, says that it holds nothing nearer. Factor one is exact;
smaller factors are faster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.llm.tables import cut_lineage

#: Vectors of a shard and queries of a block; both are memory bounds of a task.
SHARD_ROWS, BLOCK_QUERIES = 32_768, 16_384
#: Most regions, and vectors of the sample that draws them.
ROUTES, SAMPLE = 256, 4096
#: Vectors of a leaf.
LEAF = 256
FACTOR = 0.5
#: Queries that are compared at once, and pairs that are scored at once.
QUERIES_AT_ONCE, PAIRS_AT_ONCE = 256, 1 << 16
#: Squared distances that are as near as this count as equal until the exact scores are known.
NEARLY = 1e-11


class VpTree:
    """A tree over unit vectors: each node has a vantage point and the median distance of the rest to it."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.x, self.leaf = x, leaf
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= self.leaf:
            self.nodes[me] = ("leaf", rows)
            return me
        far = rows[np.argmax(((self.x[rows] - self.x[rows[0]]) ** 2).sum(axis=1))]  # an outer point cuts better than an inner one
        rows = rows[rows != far]
        d = np.sqrt(np.maximum(0, ((self.x[rows] - self.x[far]) ** 2).sum(axis=1)))
        radius = float(np.median(d))
        inside = d <= radius
        if inside.all():
            self.nodes[me] = ("leaf", np.append(rows, far))
            return me
        self.nodes[me] = ("node", far, radius, self._build(rows[inside]), self._build(rows[~inside]))
        return me

    def _apart(self, who: np.ndarray, rows: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Squared distances of queries to rows, a bounded number of them at once."""
        step = max(1, (1 << 22) // max(1, len(rows)))
        for at in range(0, len(who), step):
            own = who[at : at + step]
            yield own, np.maximum(0.0, 2.0 - 2.0 * (q[own] @ self.x[rows].T))

    def search(self, q: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, int]:
        """Squared distances and rows of the k nearest of each query (unset: infinity and -1), and the distances computed."""
        best, rows = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
        count = 0

        def offer(who: np.ndarray, found: np.ndarray) -> None:
            nonlocal count
            for own, d in self._apart(who, found, q):
                count += d.size
                if d.shape[1] > k:
                    near = np.argpartition(d, k - 1, axis=1)[:, :k]
                    d, ids = np.take_along_axis(d, near, 1), found[near]
                else:
                    ids = np.broadcast_to(found, d.shape)
                d, ids = np.concatenate([best[own], d], axis=1), np.concatenate([rows[own], ids], axis=1)
                order = np.argsort(d, axis=1, kind="stable")[:, :k]
                best[own], rows[own] = np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)

        def visit(node: int, who: np.ndarray) -> None:
            if not len(who):
                return
            kind, *rest = self.nodes[node]
            if kind == "leaf":
                offer(who, rest[0])
                return
            point, radius, inner, outer = rest
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (q[who] @ self.x[point])))
            offer(who, np.array([point]))
            near = d <= radius
            visit(inner, who[near])
            visit(outer, who[~near])
            reach = factor * np.sqrt(best[who, k - 1] + NEARLY)
            visit(outer, who[near & (d + reach >= radius)])
            visit(inner, who[~near & (d - reach <= radius)])

        visit(self.root, np.arange(len(q)))
        return best, rows, count

    def within(self, q: np.ndarray, most: np.ndarray, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the rows whose squared distance is `most` of the query or less."""
        out = [np.zeros((2, 0), np.int64)]

        def visit(node: int, who: np.ndarray) -> None:
            if not len(who):
                return
            kind, *rest = self.nodes[node]
            found = rest[0] if kind == "leaf" else np.array([rest[0]])
            for own, d in self._apart(who, found, q):
                i, j = np.nonzero(d <= most[own, None])
                out.append(np.stack([own[i], found[j]]))
            if kind == "leaf":
                return
            point, radius, inner, outer = rest
            d, reach = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (q[who] @ self.x[point]))), factor * np.sqrt(most[who])
            visit(inner, who[d - reach <= radius])
            visit(outer, who[d + reach >= radius])

        visit(self.root, np.arange(len(q)))
        return tuple(np.concatenate(out, axis=1))


class Router:
    """The regions of a vantage-point tree over a sample, as at most ROUTES leaves."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.nodes: list[tuple] = []
        self.leaves = 0
        self._build(_unit(sample), max(1, leaves))

    def _build(self, x: np.ndarray, leaves: int) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        if leaves > 1 and len(x) > 2:
            far = x[np.argmax(((x - x[0]) ** 2).sum(axis=1))]
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ far)))
            radius = float(np.median(d))
            if (d <= radius).any() and (d > radius).any():
                self.nodes[me] = (far, radius, self._build(x[d <= radius], leaves - leaves // 2), self._build(x[d > radius], leaves // 2))
                return me
        self.nodes[me] = (self.leaves,)
        self.leaves += 1
        return me

    def regions(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, region) of the regions that may hold something within `reach` of each unit vector; with reach 0 below nought, its own one alone."""
        out = [np.zeros((2, 0), np.int64)]

        def visit(node: int, who: np.ndarray) -> None:
            if not len(who):
                return
            if len(self.nodes[node]) == 1:
                out.append(np.stack([who, np.full(len(who), self.nodes[node][0])]))
                return
            far, radius, inner, outer = self.nodes[node]
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x[who] @ far)))
            own = reach[who] < 0
            visit(inner, who[np.where(own, d <= radius, d - reach[who] <= radius)])
            visit(outer, who[np.where(own, d > radius, d + reach[who] >= radius)])

        visit(0, np.arange(len(x)))
        return tuple(np.concatenate(out, axis=1))


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)  # first by the largest component, so that no square leaves the range
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, in double precision; powers of two, which change no digit, keep squares in range."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))[1]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _search_shard(k: int, factor: float) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if not len(shard) or not len(queries):
            return nothing
        shard = shard.sort_values("vec_id", ignore_index=True)
        x, ids = np.stack(shard["v"]) + 0.0, shard["vec_id"].to_numpy()  # -0.0 becomes 0.0
        # equal vectors are one point of the tree; of its rows only the k + 1 with the smallest ids can be among the k nearest
        _, first, group = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(len(first) + 1))
        points = x[first]
        tree = VpTree(_unit(points))
        q, q_ids = np.stack(queries["v"]) + 0.0, queries["vec_id"].to_numpy()
        unit, kept = _unit(q), [nothing]
        most = min(k + 1, len(points))  # the query itself may be one of them
        for at in range(0, len(q), QUERIES_AT_ONCE):
            own = unit[at : at + QUERIES_AT_ONCE]
            best, rows, _ = tree.search(own, most, factor)
            who, point = tree.within(own, best[:, -1] + NEARLY, factor)  # all that are as near as the last one
            pairs = np.unique(np.concatenate([who * len(points) + point, (np.arange(len(own))[:, None] * len(points) + rows)[rows >= 0]]))
            who, point = pairs // len(points) + at, pairs % len(points)
            score = np.concatenate([np.zeros(0), *(cosine(q[who[i : i + PAIRS_AT_ONCE]], points[point[i : i + PAIRS_AT_ONCE]]) for i in range(0, len(who), PAIRS_AT_ONCE))])
            size = np.minimum(np.diff(cuts)[point], k + 1)
            place = np.repeat(cuts[point] - np.cumsum(size) + size, size) + np.arange(size.sum())
            out = pd.DataFrame({"query_id": np.repeat(q_ids[who], size), "vec_id": ids[order[place]], "score": np.repeat(score, size)})
            out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            kept.append(out.groupby("query_id").head(k))
        return pd.concat(kept, ignore_index=True)

    return run


def usable(vector: str) -> Column:
    """Whether a vector has components, none of them null or not finite, and isn't zero."""
    return F.coalesce(F.expr(f"size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vector}, x -> x <> 0)"), F.lit(False))


def _routed(df: DataFrame, routers: dict[int, Router], factor: float) -> DataFrame:
    """`df` (vec_id, v, dim, reach) with a row for each region that may hold something within factor * reach; below nought: the vector's own region."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for dim, own in rows.groupby("dim"):
                if dim not in routers:
                    yield own.assign(region=0)
                    continue
                reach = own["reach"].to_numpy(float)
                at, region = routers[dim].regions(_unit(np.stack(own["v"]) + 0.0), np.where(reach < 0, reach, factor * reach))
                yield own.iloc[at].assign(region=region)

    return df.mapInPandas(run, "vec_id long, v array<double>, dim int, reach double, region long") if routers else df.withColumn("region", F.lit(0).cast("long"))


def _found(index: DataFrame, queries: DataFrame, k: int, factor: float, shard_rows: int, block_queries: int) -> DataFrame:
    """The k nearest of each query in each shard of its region; both tables have (vec_id, v, dim, region)."""
    shards = index.groupBy("dim", "region").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))  # ROUTES rows a length of vectors at most
    blocks = queries.groupBy("dim", "region").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("blocks"))
    sizes = cut_lineage(shards.join(blocks, ["dim", "region"]))
    number = lambda name, most: F.pmod(F.xxhash64("vec_id"), F.col(most)).cast("int").alias(name)
    every = lambda name, most: F.explode(F.sequence(F.lit(0), F.col(most) - 1)).alias(name)
    keys = ["dim", "region", "shard", "block"]
    left = index.join(F.broadcast(sizes), ["dim", "region"]).select("dim", "region", number("shard", "shards"), every("block", "blocks"), "vec_id", "v")
    right = queries.join(F.broadcast(sizes), ["dim", "region"]).select("dim", "region", every("shard", "shards"), number("block", "blocks"), "vec_id", "v")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search_shard(k, factor), "query_id long, vec_id long, score double")


def nearest(index: DataFrame, queries: DataFrame, k: int = 5, factor: float = FACTOR, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest rows of `index` other than those with its id.

    score is the cosine of the original vectors in double precision; ties go
    to the smaller id. Vectors that are null, empty, zero or hold a null or
    non-finite component take no part, nor do rows with a null id; vectors of
    different lengths aren't compared. Rows that repeat an id of the index count
    once each, rows that repeat a query id must be equal. An empty table gives
    no rows. Every query is first compared with its own region; the distance to
    the k-th nearest there tells which other regions it goes to.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    top = lambda df: df.withColumn("rank", rank).where(F.col("rank") <= k)
    clean = lambda df: df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable("v")).withColumn("dim", F.size("v"))
    left, right = clean(index), clean(queries).dropDuplicates(["vec_id"])
    routers = {}
    for row in left.groupBy("dim").count().where(F.col("count") > shard_rows).collect():  # a row a length of vectors
        sample = left.where(F.col("dim") == row["dim"]).select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
        routers[row["dim"]] = Router(np.array([r["v"] for r in sample]) + 0.0, min(ROUTES, -(-row["count"] // shard_rows)))
    left = _routed(left.withColumn("reach", F.lit(-1.0)), routers, factor)
    first = _found(left, _routed(right.withColumn("reach", F.lit(-1.0)), routers, factor), k, factor, shard_rows, block_queries)
    if not routers:
        return top(first).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    first = cut_lineage(top(first))
    reach = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("score")) + NEARLY)).alias("reach"))
    asked = _routed(right.join(reach, "vec_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf")))), routers, factor)
    home = _routed(right.withColumn("reach", F.lit(-1.0)), routers, factor).select("vec_id", "region")
    second = _found(left, asked.join(home, ["vec_id", "region"], "left_anti"), k, factor, shard_rows, block_queries)
    return top(first.drop("rank").union(second)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
