"""Rolling means and covered shares whose cost doesn't grow with the rows in a span."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantwatch.operators import evaluate, rolling
from plantwatch.operators.frames import Sums

KEYS = ["asset", "tag"]


def test_sums_of_frames():
    rng = np.random.default_rng(5)
    x = rng.normal(size=77)
    low = rng.integers(0, 78, 400)
    high = np.maximum(low, rng.integers(0, 78, 400))
    assert Sums(x).over(low, high) == pytest.approx([x[a:b].sum() for a, b in zip(low, high, strict=True)])
    assert list(Sums(np.array([1.0, np.inf, 2.0])).over([0, 0, 2], [1, 2, 3])) == [1.0, np.inf, 2.0]


def test_means_are_those_of_a_window(spark):
    rng = np.random.default_rng(6)
    rows = [(int(a), "x", int(t), None if v < -1.5 else float(v)) for a, t, v in zip(rng.integers(0, 3, 500), rng.integers(-50, 150, 500), rng.normal(size=500), strict=True)]
    df = spark.createDataFrame([*rows, (0, "x", None, 4.0), (0, "x", None, 6.0)], "asset int, tag string, t long, value double")
    plain = df.withColumn("m", F.expr("avg(value) over (partition by asset, tag order by t range between 12 preceding and current row)"))
    got = rolling.means(df, KEYS, 12, {"m": F.col("value")}, 7)
    order = lambda x: sorted(map(tuple, x.withColumn("m", F.round("m", 9)).collect()), key=str)
    assert order(got) == order(plain)


def test_no_query_goes_through_each_frame_anew(spark):
    from __spark_entry__ import queries

    for name in ("e04_long_baseline", "k15_coverage_null", "i11_k_of_n", "i14_sticky_alert"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "specifiedwindowframe(RangeFrame, -" not in plan, name


def test_coverage_counts_rows_without_a_flag(spark):
    rows = [(1, 0, None), (1, 5, True), (1, 5, False), (1, 13, None), (1, 14, False)]
    df = spark.createDataFrame(rows, "asset int, t long, alert boolean")
    assert evaluate.coverage_null(df, ["asset"], "alert", 8, 2).collect() == [(1, 0.6, pytest.approx(0.36))]
