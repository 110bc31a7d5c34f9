"""Curves of ever wider settings without a row for each setting, many quantiles in three passes, and k02 on repeated values."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plantwatch.operators import evaluate, quantiles
from plantwatch.plans import q_rest  # noqa: F401
from plantwatch.plans.registry import QUERIES, SQL

LEVELS, HORIZON, GAP = 6, 80, 60


def plain(alerts, incidents):
    """(by, k) -> (recall, false episodes), setting by setting."""
    out = {}
    for by in {a[0] for a in alerts}:
        for k in range(LEVELS):
            said = [(asset, t) for b, asset, t, level in alerts if b == by and level <= k]
            if not said:
                continue
            hit = sum(any(a == asset and a is not None and t is not None and i - HORIZON <= t <= i for a, t in said) for asset, i in incidents)
            false = sum(t is None for _, t in said)
            for asset in {a for a, _ in said}:
                times = sorted(t for a, t in said if a == asset and t is not None)
                for run in np.split(times, np.flatnonzero(np.diff(times) > GAP) + 1) if times else []:
                    false += not any(a == asset and a is not None and run[0] <= i and run[-1] >= i - HORIZON for a, i in incidents)
            out[by, k] = (hit / len(incidents), false)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_nested_curve_is_that_of_each_setting(spark, seed):
    rng = np.random.default_rng(seed)
    alerts = [(str(rng.choice(["a", "b"])), int(rng.integers(0, 3)), int(rng.integers(0, 9000)), int(rng.integers(1, LEVELS))) for _ in range(700)]
    alerts += [(by, asset, t + GAP, level) for by, asset, t, level in alerts[:60]]  # gaps at their limit
    alerts += [("a", None, 100, 2), ("a", None, 100 + GAP + 1, 1), ("b", 1, None, 3), ("b", 1, None, 3)]
    # one incident a time and asset; one at the limits of an alert, and none of the last asset
    incidents = sorted({(int(rng.integers(0, 2)), int(t)) for t in rng.choice(9000, 60)} | {(alerts[0][1], alerts[0][2] + HORIZON), (0, -500), (1, 99_000)})
    a = spark.createDataFrame(alerts, "tag string, asset int, t long, l int").repartition(5)
    i = spark.createDataFrame(incidents, "asset int, t long")
    got = {(r["tag"], r["k"]): (r["recall"], r["false"]) for r in evaluate.nested_curve(a, i, ["asset"], ["tag"], "l", LEVELS, HORIZON, GAP).collect()}
    assert got == plain(alerts, incidents)
    assert evaluate.nested_curve(a, i.where("false"), ["asset"], ["tag"], "l", LEVELS, HORIZON, GAP).isEmpty()


def test_many_quantiles_to_the_last_bit(spark):
    rng = np.random.default_rng(5)
    rows = [("n", float(x)) for x in rng.normal(size=5000)] + [("tied", float(x) / 10) for x in rng.integers(0, 40, 4000)] + [("one", 0.1), ("none", None), (None, 1.0)]
    shares = [0.0, 1.0, *rng.random(60).tolist()]
    df = spark.createDataFrame(rows, "tag string, value double")
    got = {r["tag"]: r["points"] for r in quantiles.sorted_points(df.repartition(3), ["tag"], "value", shares).collect()}
    frame = df.toPandas()  # noqa: F841
    want = dict(duckdb.sql(f"select tag, quantile_cont(value, {shares}) from frame where tag is not null and value is not null group by tag").fetchall())
    assert got == want and set(got) == {"n", "tied", "one"}


def test_position_by_halving(spark):
    df = spark.range(12).select(F.array(*map(F.lit, (1, 3, 3, 7, 9))).alias("c"), "id")
    got = df.select(quantiles.position("c", 5, lambda y: y < F.col("id"))).collect()
    assert [r[0] for r in got] == [sum(c < i for c in (1, 3, 3, 7, 9)) for i in range(12)]


def test_k02_on_repeated_values_is_the_sql(spark, tmp_path):
    """Six readings of each value: thresholds between equal values are off them by a last bit, up or down."""
    duckdb.sql(f"copy (select event_id, ts + to_seconds(i) as ts, user_id, event_type, value, props from '/root/testdata/sf0.001/events.parquet', range(6) t(i)) to '{tmp_path}/events.parquet'")
    own = duckdb.connect()
    own.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    name = "k02_alarm_optimised_threshold"
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(own.sql(SQL[name]).fetchall())
