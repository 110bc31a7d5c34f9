"""Quantiles in rounds against `percentile`, and the rows that a task holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantwatch.operators import quantiles

SHARES = {"low": 0.0, "a": 0.013, "half": 0.5, "b": 0.95, "top": 1.0}


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(31)
    rows = [("normal", 1, float(x)) for x in rng.normal(size=6000)]
    rows += [("heavy", 1, float(x)) for x in np.exp(rng.normal(0, 60, 5000))]
    rows += [("tied", 1, float(x)) for x in rng.integers(0, 3, 4000)]
    rows += [("one value", 2, 7.0)] * 3000 + [("few", 2, float(x)) for x in range(40)] + [("none", 2, None)] * 50 + [("one", 3, 1.5)]
    rows += [(None, 3, float(x) if k % 5 else None) for k, x in enumerate(rng.normal(size=3000))]
    return spark.createDataFrame(rows, "tag string, asset int, value double").repartition(5).cache()


def values(df, keys):
    return sorted((tuple(r) for r in df.select(*keys, *SHARES).collect()), key=str)


@pytest.mark.parametrize("keys", [["tag"], ["tag", "asset"], []])
@pytest.mark.parametrize("rows", [10**6, 1000, 30])
def test_quantiles_are_those_of_percentile(groups, keys, rows):
    want = groups.groupBy(*keys).agg(*(F.percentile("value", q).alias(c) for c, q in SHARES.items()))
    got = quantiles.quantiles(groups, keys, "value", SHARES, rows)
    for g, w in zip(values(got, keys), values(want, keys), strict=True):
        assert g[: len(keys)] == w[: len(keys)]
        for a, b in zip(g[len(keys) :], w[len(keys) :], strict=True):
            assert a == b or a == pytest.approx(b, rel=1e-14)


def test_order_statistics_by_rank_and_of_nothing(groups, spark):
    ranks = spark.createDataFrame([("normal", r) for r in (0, 17, 2999, 5999, 6000)] + [("tied", 3999), ("missing", 0)], "tag string, rank long")
    got = {(r["tag"], r["rank"]): r["x"] for r in quantiles.order_statistics(groups, ["tag"], "value", ranks, 50).collect()}
    x = sorted(r["value"] for r in groups.where("tag = 'normal'").collect())
    assert got == {("normal", r): x[r] for r in (0, 17, 2999, 5999)} | {("tied", 3999): 2.0}
    assert quantiles.quantiles(groups.where("false"), ["tag"], "value", SHARES, 50).count() == 0
