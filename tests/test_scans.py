"""Block scans and speculative folds against whole-key windows and plain Python, with few rows and with one long series."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plantwatch.operators import align, episodes, folds, scans, state

KEYS = ["asset", "tag"]
BLOCK = 1000


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(21)
    rows = []
    for asset, n in ((0, 900), (1, 1), (2, 150)):
        t = np.cumsum(rng.choice([1, 3, 40, 1500], n, p=[0.5, 0.3, 0.15, 0.05]))
        for k in range(n):
            rows.append((asset, "x", int(t[k]), None if rng.random() < 0.2 else float(rng.normal()), [True, False, None][int(rng.choice(3, p=[0.6, 0.3, 0.1]))]))
    return spark.createDataFrame(rows, "asset long, tag string, t long, value double, flag boolean").cache()


def same(a, b, columns):
    pick = lambda df: sorted(map(tuple, df.select(*KEYS, "t", *columns).collect()), key=str)
    assert pick(a) == pick(b)


def test_scans_are_windows_over_the_key(series):
    w = Window.partitionBy(*KEYS).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*KEYS).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    up = F.coalesce((F.col("value") > 0).cast("long"), F.lit(0))
    got = scans.scan(series, KEYS, {"a": scans.known(F.col("value")), "b": scans.total(up), "c": scans.extreme(F.col("value")), "d": scans.extreme(F.col("value"), least=True)}, BLOCK)
    want = series.withColumns({"a": F.last("value", ignorenulls=True).over(w), "b": F.sum(up).over(w), "c": F.max("value").over(w), "d": F.min("value").over(w)})
    same(got, want, "abcd")
    back = scans.scan(series, KEYS, {"a": scans.known(F.col("value"), descending=True), "b": scans.total(up)}, BLOCK, descending=True)
    same(back, series.withColumns({"a": F.last("value", ignorenulls=True).over(ahead), "b": F.sum(up).over(ahead)}), "ab")
    before = Window.partitionBy(*KEYS).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    same(scans.scan(series, KEYS, {"a": scans.known(F.col("value"))}, BLOCK, inclusive=False), series.withColumn("a", F.last("value", ignorenulls=True).over(before)), "a")


def test_runs_and_chains_are_windows_over_the_key(series):
    w = Window.partitionBy(*KEYS).orderBy("t")
    change = (~F.col("flag").eqNullSafe(F.lag("flag").over(w)) | (F.row_number().over(w) == 1)).cast("long")
    want = series.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = scans.run_numbers(series, KEYS, "flag", "run", BLOCK)
    same(got, want, ["run"])
    whole = Window.partitionBy(*KEYS, "run")
    got = scans.of_runs(got, KEYS, "run", {"n": (F.count, F.lit(1)), "a": (F.min, F.col("t")), "b": (F.max, F.col("value")), "s": (F.sum, F.col("t"))}, BLOCK)
    want = want.withColumns({"n": F.count("*").over(whole), "a": F.min("t").over(whole), "b": F.max("value").over(whole), "s": F.sum("t").over(whole)})
    same(got, want, ["run", "n", "a", "b", "s"])
    inner = Window.partitionBy(*KEYS, "run").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    same(scans.in_runs(want, KEYS, "run", {"top": scans.extreme(F.col("value"))}, BLOCK), want.withColumn("top", F.max("value").over(inner)), ["run", "top"])
    for strict in (False, True):
        since = F.col("t") - F.lag("t").over(w)
        new = series.withColumn("_c", F.when(since < 40 if strict else since <= 40, 0).otherwise(1)).withColumn("e", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        same(scans.chains(series, KEYS, 40, "e", strict, BLOCK), new, ["e"])


def test_scans_of_nothing_and_null_keys(spark, series):
    assert scans.run_numbers(series.where("false"), KEYS, "flag").count() == 0
    null = spark.createDataFrame([(None, "x", 1, 5.0, True), (None, "x", 5000, None, True)], series.schema)
    assert sorted(r["a"] for r in scans.scan(null, KEYS, {"a": scans.known(F.col("value"))}, BLOCK).collect()) == [5.0, 5.0]


def test_one_long_series_is_spread_over_tasks(spark):
    minute = 60_000_000
    rows = spark.range(0, 600_000, 1, 8).select(F.lit(0).cast("long").alias("asset"), F.lit("x").alias("tag"), (F.col("id") * minute).alias("t"), (F.xxhash64("id") % 1000 / 1000.0).alias("value"))
    runs = episodes.runs(rows.withColumn("up", F.col("value") > 0.2), KEYS, "up")
    tasks = scans.of_runs(runs, KEYS, "run", {"n": (F.count, F.lit(1))}).withColumn("p", F.floor(F.col("t") / scans.BLOCK))
    assert tasks.select("p").distinct().count() == 14
    assert tasks.agg(F.max("run")).first()[0] == runs.select("run").distinct().count()
    armed = state.hysteresis(rows, 0.9, -0.9, value="value")
    mark = F.when(F.col("value") >= 0.9, True).when(F.col("value") < -0.9, False)
    w = Window.partitionBy(*KEYS).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("t", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)).alias("want"))
    assert armed.join(want, "t").where("armed <> want").count() == 0


def plain_cusum(z, drift, limit, after, most):
    s, out = 0.0, []
    for x in z:
        s = max(0.0, (after if after is not None and s >= limit else s) + (0.0 if x is None else x - drift))
        s = s if most is None else min(s, most)
        out.append(s)
    return out


@pytest.mark.parametrize(("after", "most", "drift"), [(0.0, None, 0.1), (2.0, None, -0.3), (None, 3.0, 0.0), (1.0, 2.5, 0.2)])
def test_folds_in_blocks_are_folds_over_the_series(series, after, most, drift):
    rows = series.withColumnRenamed("value", "z").drop("flag")
    got = state.cusum_with_signals(rows, drift, 2.0, after, most, block=BLOCK).collect()
    for asset in (0, 1, 2):
        own = sorted((r["t"], r["z"], r["cusum"]) for r in got if r["asset"] == asset)
        assert [r[2] for r in own] == plain_cusum([r[1] for r in own], drift, 2.0, after, most)


def test_a_fold_whose_trajectories_never_meet_ends(series):
    """A plain sum forgets nothing: one round a block."""
    def add(rows, before):
        total = before[0] + np.cumsum(np.ones(len(rows)))
        return {"n": total}, (float(total[-1]),)

    some = series.where("asset = 2")
    got = [r["n"] for r in folds.fold_series(some, KEYS, add, (0.0,), "n double", "n double", 4000, ["value"]).orderBy("t").collect()]
    assert got == [float(k + 1) for k in range(len(got))] and len(got) == 150
    assert folds.fold_series(series.where("false"), KEYS, add, (0.0,), "n double", "n double").count() == 0


def test_asof_in_every_direction_over_blocks(spark):
    rng = np.random.default_rng(5)
    day = 86_400_000_000
    left = sorted({int(x) * day for x in rng.integers(0, 400, 60)})
    right = sorted({int(x) * day for x in rng.integers(0, 400, 25)})
    a = spark.createDataFrame([(0, t) for t in left], "asset long, t long")
    b = spark.createDataFrame([(0, t, t // day) for t in right], "asset long, t long, v long")
    for how in ("backward", "forward", "nearest"):
        got = {r["t"]: r["t_match"] for r in align.asof(a, b, ["asset"], ["v"], how).collect()}
        for t in left:
            back, ahead = max((u for u in right if u <= t), default=None), min((u for u in right if u >= t), default=None)
            near = ahead if back is None or (ahead is not None and ahead - t < t - back) else back
            assert got[t] == {"backward": back, "forward": ahead, "nearest": near}[how]


def test_rows_of_one_time_are_in_the_order_of_the_flag(spark):
    rng = np.random.default_rng(22)
    rows = [(0, "x", int(t), None, bool(f)) for t, f in zip(rng.integers(0, 9, 60) * 400, rng.random(60) < 0.5, strict=True)]
    df = spark.createDataFrame(rows, "asset long, tag string, t long, value double, flag boolean").repartition(3)
    got = sorted((r["t"], r["flag"], r["run"]) for r in scans.run_numbers(df, KEYS, "flag", "run", BLOCK).collect())
    run, want = 1, []
    ordered = sorted((t, f) for _, _, t, _, f in rows)
    for k, (t, f) in enumerate(ordered):
        run += k > 0 and f != ordered[k - 1][1]
        want.append((t, f, run))
    assert got == want


def test_scans_keep_columns_of_any_name(series):
    """Names that other operators use for columns of their own."""
    names = ["_b", "_h", "_s0", "_c0", "_l0", "_k0", "_n", "_new", "_first", "_last", "_from"]
    rows = series.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    got = scans.run_numbers(scans.scan(rows, KEYS, {"a": scans.known(F.col("value"))}, BLOCK), KEYS, "flag", "run", BLOCK)
    got = scans.of_runs(got, KEYS, "run", {"n": (F.count, F.lit(1))}, BLOCK)
    assert got.select(*names).distinct().collect() == [tuple(range(len(names)))] and got.count() == series.count()
