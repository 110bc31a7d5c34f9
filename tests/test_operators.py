"""Operators on small hand-made series; expected values are worked out by hand or by a plain loop."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantwatch.functions import columns as C
from plantwatch.functions.columns import HOUR, MINUTE
from plantwatch.operators import align, blocks, clean, episodes, evaluate, models, rolling, state
from plantwatch.sources import sensors

KEYS = ["asset", "tag"]


def series(spark, values, step=1, asset=0, tag="x"):
    rows = [(asset, tag, i * step, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "asset long, tag string, t long, value double")


def column(df, name, order="t"):
    return [r[name] for r in df.orderBy("asset", "tag", order).collect()]


def test_sentinels_are_masked_and_rows_stay(spark):
    df = clean.mask_range(series(spark, [-40.5, 10, 900, None]), 0.0, 500.0)
    assert column(df, "value") == [None, 10.0, None, None]
    assert column(df, "masked") == [True, False, True, False]


def test_hampel_replaces_a_spike_and_keeps_a_ramp(spark):
    assert column(clean.hampel(series(spark, [1, 2, 1, 2, 90, 1, 2, 1, 2]), 2), "cleaned")[4] == 2.0
    assert column(clean.hampel(series(spark, range(12)), 2), "cleaned") == [float(i) for i in range(12)]
    assert column(clean.hampel(series(spark, [5] * 6), 2), "cleaned") == [5.0] * 6


def test_long_gap_marks_the_whole_run(spark):
    df = series(spark, [1, None, None, 2, None, None, None, 3])
    assert column(clean.long_gaps(df, 2), "long_gap") == [False] * 4 + [True] * 3 + [False]


def test_interpolation_fills_from_both_sides_only_so_far(spark):
    df = series(spark, [None, 0, None, None, None, None, None, 6, None, None])
    assert column(clean.interpolate(df, 2), "filled") == [0.0, 0.0, 1.0, 2.0, None, 4.0, 5.0, 6.0, 6.0, 6.0]


def test_fabricated_ramp_is_found(spark):
    rng = np.random.default_rng(0)
    values = list(rng.normal(0, 1, 60)) + list(np.linspace(0, 5, 40)) + list(rng.normal(0, 1, 60))
    flags = column(clean.fabricated(series(spark, values), 10, 0.05), "fabricated")
    assert all(flags[65:95]) and not any(flags[:55]) and not any(flags[110:])
    assert column(clean.fabricated(series(spark, [1, 2]), 1, 0.5), "fabricated") == [False, False]


def test_constant_runs_and_back_spill(spark):
    df = series(spark, [1, 2, 2, 2, 3, 3])
    assert column(clean.constant_runs(df, 3), "constant") == [False, True, True, True, False, False]
    assert column(clean.constant_runs(df, 3, back_spill=True), "constant") == [True, True, True, True, False, False]


def test_common_mode_residual(spark):
    rows = [(0, f"p{i}", 0, 700.0 + i) for i in range(1, 7)]
    df = spark.createDataFrame(rows, "asset long, tag string, t long, value double")
    got = {r["tag"]: r["residual"] for r in align.leave_one_out(df, ["asset", "t"], 2).collect()}
    assert got["p3"] == pytest.approx(-0.6)
    alone = align.leave_one_out(df.where("tag in ('p1', 'p2')"), ["asset", "t"], 2)
    assert [r["residual"] for r in alone.collect()] == [None, None]


def test_normalisation_uses_training_rows_only(spark):
    df = series(spark, [10, 12, 14, 16, 18, 1000])
    p = clean.scales(df.where("t < 5")).first()
    assert (p["center"], p["scale"]) == (14.0, 4.0)
    assert column(clean.normalize(df, clean.scales(df.where("t < 5"))), "z")[5] == pytest.approx(986 / 4)
    assert clean.scales(series(spark, [3, 3, 3])).first()["scale"] == 1.0


def test_startup_and_starts(spark):
    df = spark.createDataFrame([(0, "x", i, v) for i, v in enumerate([True, True, False, True, True])], "asset long, tag string, t long, on boolean")
    assert column(clean.starts(df, KEYS), "start") == [True, False, False, True, False]
    assert column(clean.starts(df, KEYS, first_counts=False), "start") == [False, False, False, True, False]
    assert column(clean.since_start(df, KEYS, first_counts=False), "since") == [None, None, None, 0, 1]


def test_near_events_is_closed_on_both_ends(spark):
    events = spark.createDataFrame([(0, 10)], "asset long, t long")
    got = column(clean.near_events(series(spark, range(20)), events, ["asset"], 2, 3), "excluded")
    assert [i for i, x in enumerate(got) if x] == [8, 9, 10, 11, 12, 13]
    merged = clean.merged_windows(spark.createDataFrame([(0, 10), (0, 14), (0, 40)], "asset long, t long"), ["asset"], 2, 3).orderBy("a").collect()
    assert [(r["a"], r["b"]) for r in merged] == [(8, 17), (38, 43)]


def loop_ewma(values, half_life):
    num = den = 0.0
    out = []
    for v in values:
        num, den = num * 0.5 ** (1 / half_life), den * 0.5 ** (1 / half_life)
        if v is not None:
            num, den = num + v, den + 1
        out.append(num / den if den else None)
    return out


@pytest.mark.parametrize("half_life", [0.05, 2.0, 30.0])
def test_ewma_by_blocks_is_the_loop(spark, half_life):
    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.1 else float(x) for x in rng.normal(5, 2, 300)]
    got = column(state.ewma_points(series(spark, values), half_life), "ewma")
    for a, b in zip(got, loop_ewma(values, half_life), strict=True):
        assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9) or half_life < 0.1)


def test_recursive_ewma_carries_and_fills(spark):
    a = 1 - 0.5 ** (1 / 4)
    got = column(state.ewma_recursive(series(spark, [None, 2, 4, None, 8]), 4.0), "ewma")
    s2 = 2.0
    s4 = a * 4 + (1 - a) * s2
    s8 = a * 8 + (1 - a) * s4
    assert got == pytest.approx([2.0, s2, s4, s4, s8])


def test_cusum_forms_are_the_loop(spark):
    rng = np.random.default_rng(5)
    z = list(rng.normal(0.1, 1, 120))
    df = series(spark, z).withColumnRenamed("value", "z").withColumn("reset", F.col("t") % 17 == 5)
    s, r, plain, reset = 0.0, 0.0, [], []
    for i, x in enumerate(z):
        s = max(0.0, s + x - 0.2)
        r = max(0.0, r * (0.25 if i % 17 == 5 else 1) + x - 0.2)
        plain.append(s)
        reset.append(r)
    assert column(state.cusum(df, 0.2), "cusum") == pytest.approx(plain)
    assert column(state.cusum_segments(df, 0.2, "reset", 0.25), "cusum") == pytest.approx(reset)


def test_rules_on_flags(spark):
    df = series(spark, [0, 1, 1, 1, 0, 1, 0, 0, 1, 1]).withColumn("f", F.col("value") > 0)
    assert column(df.withColumn("s", state.sustained("f", 3)), "s") == [False] * 3 + [True] + [False] * 6
    assert column(df.withColumn("s", state.sustained("f", 1)), "s") == column(df, "f")
    assert column(df.withColumn("s", state.sticky("f", 1)), "s") == [False, True, True, True, True, True, True, False, True, True]
    assert column(episodes.drop_short_runs(df, KEYS, "f", 2), "f") == [False, True, True, True, False, False, False, False, True, True]
    h = series(spark, [0, 5, 3, 1, 3, 5, 4])
    assert column(state.hysteresis(h, 5, 2, value="value", into="s"), "s") == [False, True, True, False, False, True, True]


def test_episode_gaps_and_dedups_differ(spark):
    t = spark.createDataFrame([(0, x) for x in (0, 4, 8, 12, 30)], "asset long, t long")
    assert [(r["start"], r["end"]) for r in episodes.episodes(t, ["asset"], 4).orderBy("start").collect()] == [(0, 12), (30, 30)]
    assert episodes.episodes(t, ["asset"], 4, strict=True).count() == 5
    assert sorted(r["t"] for r in episodes.anchored(t, ["asset"], 7).collect()) == [0, 8, 30]
    ep = spark.createDataFrame([(0, 0, 5, 1.0), (0, 8, 9, 9.0), (0, 20, 21, 1.0)], "asset long, start long, end long, power double")
    assert sorted(r["start"] for r in episodes.refractory(ep, ["asset"], 4).collect()) == [0, 20]
    assert sorted(r["start"] for r in episodes.refractory(ep, ["asset"], 4, "power", 5.0, 2).collect()) == [0, 8, 20]
    assert sorted(r["start"] for r in episodes.refractory(ep, ["asset"], 0).collect()) == [0, 8, 20]


def test_alarm_intervals(spark):
    rows = [(0, 0, "HI", "ACT"), (0, 2, "HI", "ACT"), (0, 5, "OK", "INACT"), (0, 6, "OK", "INACT"), (0, 9, "HIHI", "ACT"), (0, 12, "HI", "ACT")]
    a = spark.createDataFrame(rows, "asset long, t long, condition string, status string")
    assert [(r["start"], r["end"]) for r in episodes.ok_aware(a, ["asset"]).orderBy("start").collect()] == [(0, 5), (9, None)]
    assert [(r["start"], r["end"]) for r in episodes.active_intervals(a, ["asset"]).orderBy("start").collect()] == [(0, 5), (9, 12)]


@pytest.mark.parametrize("block", [7, 50, 1000])
def test_rolling_by_blocks_is_the_plain_window(spark, block):
    rng = np.random.default_rng(1)
    df = series(spark, rng.normal(0, 1, 200))
    f = {"m": lambda w: F.avg("value").over(w), "q": lambda w: F.percentile("value", 0.5).over(w)}
    plain, wide = (blocks.rolling(df, KEYS, 12, f, ahead=3, block=b) for b in (None, block))
    assert column(wide, "m") == pytest.approx(column(plain, "m")) and column(wide, "q") == pytest.approx(column(plain, "q"))
    assert wide.count() == 200
    assert column(blocks.row_numbers(df.repartition(5), KEYS, block), "n") == list(range(200))


def test_range_join_and_overlaps_are_the_nested_loops(spark):
    rng = np.random.default_rng(2)
    left, right = sorted(rng.choice(1000, 40, replace=False).tolist()), sorted(rng.choice(1000, 40, replace=False).tolist())
    a, b = (spark.createDataFrame([(0, int(x)) for x in v], f"asset long, {c} long") for v, c in ((left, "t"), (right, "u")))
    got = sorted((r["t"], r["u"]) for r in align.range_join(a, b, ["asset"], 15, 4).collect())
    assert got == sorted((x, y) for x in left for y in right if x - 15 <= y <= x + 4)
    ep = [(0, s, s + int(d)) for s, d in zip(left, rng.integers(0, 60, 40), strict=True)]
    iv = [(0, s, s + int(d)) for s, d in zip(right, rng.integers(0, 60, 40), strict=True)]
    e, i = spark.createDataFrame(ep, "asset long, start long, end long"), spark.createDataFrame(iv, "asset long, a long, b long")
    got = sorted((r["start"], r["a"]) for r in align.overlaps(e, i, ["asset"], 25).collect())
    assert got == sorted((s, a) for _, s, t in ep for _, a, b in iv if a <= t and b >= s)


def test_asof_directions(spark):
    left = spark.createDataFrame([(0, 5), (0, 10), (0, 16), (0, 1)], "asset long, t long")
    right = spark.createDataFrame([(0, 4, "a"), (0, 10, "b"), (0, 20, "c")], "asset long, t long, v string")
    take = lambda how: [r["v"] for r in align.asof(left, right, ["asset"], ["v"], how).orderBy("t").collect()]
    assert take("backward") == [None, "a", "b", "b"] and take("forward") == ["a", "b", "b", "c"] and take("nearest") == ["a", "a", "b", "c"]


def test_point_evaluation_of_the_documented_case(spark):
    flags = [0, 1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0]
    alerts = spark.createDataFrame([(0, i * HOUR) for i, f in enumerate(flags) if f], "asset long, t long")
    incidents = spark.createDataFrame([(0, 2 * HOUR), (0, 5 * HOUR)], "asset long, t long")
    m = evaluate.match(alerts, incidents, ["asset"], 90 * MINUTE, 90 * MINUTE).collect()
    assert sorted((r["t"] - r["first"]) // MINUTE for r in m) == [60, 60]
    assert evaluate.false_episodes(alerts, incidents, ["asset"], HOUR, 90 * MINUTE).count() == 1


def test_operating_points(spark):
    c = spark.createDataFrame([("a", 1, 0.9, 3.0), ("a", 2, 0.8, 0.5), ("a", 3, 0.8, 0.2), ("b", 1, 0.4, 9.0), ("b", 2, 0.3, 8.0)], "k string, y int, recall double, false_per_day double")
    best = {r["k"]: r["y"] for r in evaluate.operating_point(c, ["k"], 1.0, "y").collect()}
    assert best == {"a": 2, "b": 1}
    assert {(r["k"], r["y"]): r["worst"] for r in evaluate.neighbour_worst(c, ["k"], "y", "recall").collect()}[("a", 2)] == 0.8


def test_statistics(spark):
    row = spark.range(1).select(evaluate.binomial_tail(F.lit(3), F.lit(5), F.lit(0.4)).alias("b"), evaluate.poisson_tail(F.lit(3), F.lit(1.5)).alias("p"), *(x.alias(n) for x, n in zip(C.wilson(F.lit(5), F.lit(10)), ("lo", "hi"), strict=True))).first()
    assert row["b"] == pytest.approx(sum(math.comb(5, i) * 0.4**i * 0.6 ** (5 - i) for i in (3, 4, 5)))
    assert row["p"] == pytest.approx(1 - math.exp(-1.5) * (1 + 1.5 + 1.125))
    assert row["lo"] == pytest.approx(0.2366, abs=1e-4) and row["hi"] == pytest.approx(0.7634, abs=1e-4)
    df = spark.createDataFrame([(0, 1.0, False), (0, 2.0, True), (0, 2.0, False), (0, 3.0, True)], "k int, s double, y boolean")
    assert evaluate.auc(df, ["k"], "s", "y").first()["auc"] == pytest.approx(0.875)


def test_features(spark):
    x = series(spark, [1, 3, 2, 5, 4, 6, 8, 7])
    got = column(rolling.shape_features(x, 5), "kurt")
    assert got[:3] == [0.0] * 3 and got[7] == pytest.approx(pd.Series([5, 4, 6, 8, 7]).kurt())
    w = models.windows(x, 4, 2).orderBy("seq").collect()
    assert [r["x"] for r in w] == [[1, 3, 2, 5], [2, 5, 4, 6], [4, 6, 8, 7]]
    wave = series(spark, [math.sin(2 * math.pi * 3 * i / 16) for i in range(16)])
    assert rolling.spectral_bands(wave, 16, 16).first()["dominant"] == 3
    ranks = column(rolling.rank_percent(series(spark, [1, 2, 2, 4]), KEYS), "rank_pct")
    assert ranks == [0.25, 0.625, 0.625, 1.0]


def test_models(spark):
    rng = np.random.default_rng(4)
    u = rng.normal(0, 1, 300)
    x = np.stack([u, 2 * u, -u], axis=1) + rng.normal(0, 0.01, (300, 3))
    x[7] += [0, 3, 0]
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(300)))
    top = models.pca_residual(df, ["a", "b", "c"], 0.95).orderBy(F.desc("residual")).first()
    assert top["id"] == 7
    assert models.mahalanobis(df, ["a", "b", "c"], 0.01).orderBy(F.desc("distance")).first()["id"] == 7
    y = spark.createDataFrame([(0, float(i), 3.0 + 2 * i + 0.5 * i * i) for i in range(10)], "g int, load double, y double")
    assert max(abs(r["residual"]) for r in models.quadratic_residual(y, "y", "load", ["g"]).collect()) < 1e-6
    far = pd.DataFrame({"id": range(400), "p": rng.normal(0, 1, 400), "q": rng.normal(0, 1, 400)})
    far.loc[11, ["p", "q"]] = [9, 9]
    scores = models.isolation_scores(spark.createDataFrame(far), ["p", "q"], "id", trees=16, sample=128)
    assert scores.orderBy(F.desc("score")).first()["id"] == 11


def test_time_and_text(spark):
    df = spark.createDataFrame([("2025-01-10 03:00:00", False), ("10/01/2025 03:00:00", True), ("01/10/2025 03:00:00", False), ("No Data", True)], "s string, d boolean")
    got = [str(r[0]) for r in df.select(C.parse_time(F.col("s"), F.col("d"))).collect()]
    assert got == ["2025-01-10 03:00:00"] * 3 + ["None"]
    local = spark.createDataFrame([("2025-01-10 00:00:00",), ("2018-02-17 23:30:00",)], "s string").select(C.to_utc(F.to_timestamp("s"), "America/Sao_Paulo").alias("u")).collect()
    assert str(local[0]["u"]) == "2025-01-10 03:00:00" and local[1]["u"] is None  # the second wall time occurs twice
    text = spark.createDataFrame([("TRIP por vibração",), ("Muito Alta pressão",), ("normal",)], "s string")
    assert [r[0] for r in text.select(C.protection_level(F.col("s"))).collect()] == ["trip", "very high", None]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,P1,P 2\n2025-01-01 00:00:00,1.5,No Data\n2025-01-01 00:00:30,NaN,4\nbad,1,1\n")
    got = {(r["tag"], r["value"]) for r in sensors.wide_csv(spark, str(tmp_path / "a.csv"), ["time", "P1", "P 2"], "time").collect()}
    assert got == {("P1", 1.5), ("P_2", None), ("P1", None), ("P_2", 4.0)}
    raw = spark.createDataFrame([("2025", "T1", "hihi")], ["Data da Ocorrência", "Tag", "Condição do Alarme"])
    row = sensors.alarm_log(raw).first()
    assert (row["ts"], row["tag"], row["condition"], row["status"]) == ("2025", "T1", "HIHI", None)
    trips = sensors.trips_json(spark.createDataFrame([('["2025-01-02 00:00:00"]',), ('{"trips": ["2025-01-01 00:00:00"]}',), ("x",)], ["value"]))
    assert trips.count() == 2
    grid = series(spark, range(5), step=HOUR)
    sensors.write_grid(grid, str(tmp_path / "grid"))
    assert sensors.read_grid(spark, str(tmp_path / "grid"), ["x"], ["1970-01"]).count() == 5
    with pytest.raises(ValueError):
        sensors.Config.of({"no_such_option": 1})
    with pytest.raises(Exception):
        sensors.consolidate([(grid, 0, None, None), (grid.drop("value"), 0, None, None)]).count()


def test_empty_tables_give_no_rows(spark):
    none = spark.createDataFrame([], "asset long, tag string, t long, value double")
    assert clean.hampel(none, 2).count() == 0 and state.ewma_points(none, 3.0).count() == 0 and align.regular_grid(none, 5).count() == 0
    assert episodes.episodes(none, ["asset"], 3).count() == 0 and models.walk_forward(none, 5, 10, 2).count() == 0


def test_isolation_trees_have_their_samples_of_many_rows(spark):
    n, sample = 5_000_000, 256
    rows = spark.range(n).select("id", ((F.col("id") * 7919) % 10_007).cast("double").alias("p"))
    # the sample of a tree is exactly the rows with the smallest hashes
    h = F.xxhash64("id", F.lit(0), F.lit(1))
    under = rows.where(h <= models._hash_bound(n, sample)).count()
    assert sample <= under <= 4 * sample
    assert models._hash_bound(100, sample) == 2**63 - 1
    scores = models.isolation_scores(rows, ["p"], "id", trees=2, sample=sample).where("id % 1000 = 0")
    got = scores.agg(F.count("*").alias("n"), F.count_if(F.isnan("score")).alias("nan"), F.min("score").alias("low"), F.max("score").alias("top")).first()
    assert got["n"] == n // 1000 and got["nan"] == 0
    assert 0.2 < got["low"] < 0.7 and got["low"] < got["top"] < 1.0


def test_wide_to_long_takes_every_order(spark, tmp_path):
    import __spark_entry__

    orders = spark.sql("select id as o_orderkey, timestamp_ntz'2024-01-01' as o_orderdate, id * 1.5D as o_totalprice, id + 100 as o_custkey from range(1, 22)")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r["asset"], r["tag"]): r["value"] for r in __spark_entry__.queries()["a02_wide_to_long_all"](spark, str(tmp_path)).collect()}
    assert got == {(k, "price"): k * 1.5 for k in range(1, 22)} | {(k, "customer"): k + 100.0 for k in range(1, 22)}


def test_row_blocks_give_what_whole_series_give(spark):
    from plantwatch.operators import blocks, clean

    rng = np.random.default_rng(41)
    data = [(a, "x", int(t), float(v)) for a in range(2) for t, v in zip(np.cumsum(rng.integers(1, 9, 400)), rng.normal(0, 1, 400), strict=True)]
    df = spark.createDataFrame(data, "asset long, tag string, t long, value double")
    keys = ["asset", "tag"]
    for back, ahead, f in ((12, 0, lambda x, k: rolling.shape_features(x, 12, k)), (4, 4, lambda x, k: clean.hampel(x, 2, keys=k)), (17, 0, lambda x, k: state.glr(x, [4, 16], k, "value"))):
        whole, parts = f(df, keys), blocks.by_rows(df, keys, back, f, ahead, block=37, span=200)
        assert parts.columns == whole.columns
        a, b = (x.orderBy("asset", "t").toPandas() for x in (whole, parts))
        assert np.allclose(a.select_dtypes("number"), b.select_dtypes("number"), atol=1e-9)


def test_block_cusum_and_decayed_sums_are_the_loops(spark):
    from plantwatch.operators import blocks

    rng = np.random.default_rng(42)
    t = np.cumsum(rng.choice([1, 2, 900, 5000], 300, p=[0.6, 0.37, 0.02, 0.01]))
    z = rng.normal(0.1, 1, 300)
    df = spark.createDataFrame([(0, "x", int(a), float(b)) for a, b in zip(t, z, strict=True)], "asset long, tag string, t long, value double")
    s, want = 0.0, []
    for v in z:
        s = max(0.0, s + v - 0.2)
        want.append(s)
    for block in (7, 100, 10**9):
        got = [r["cusum"] for r in state.cusum(df, 0.2, z="value", block=block).orderBy("t").collect()]
        assert got == pytest.approx(want, abs=1e-9)
    num = [sum(z[j] * 0.5 ** ((t[i] - t[j]) / 3.0) for j in range(i + 1)) for i in range(300)]
    got = [r["s"] for r in blocks.decayed_sums(df, ["asset", "tag"], "t", 3.0, {"s": F.col("value")}).orderBy("t").collect()]
    assert got == pytest.approx(num, rel=1e-9, abs=1e-12)


def test_order_statistics_are_recomputed_ones(spark):
    rng = np.random.default_rng(43)
    t, x = np.cumsum(rng.integers(0, 4, 250)), np.round(rng.normal(0, 2, 250))
    data = [(0, "x", int(a), None if k % 17 == 0 else float(b)) for k, (a, b) in enumerate(zip(t, x, strict=True))]
    df = spark.createDataFrame(data, "asset long, tag string, t long, value double").withColumn("k", F.monotonically_increasing_id())
    for back, ahead, block in ((20, 0, 30), (20, -1, 50), (5, 5, 1000)):
        for r in rolling.order_statistics(df, ["asset", "tag"], back, ahead, block, 0.9).collect():
            own = [v for _, _, u, v in data if r["t"] - back <= u <= r["t"] + ahead and v is not None]
            assert r["n"] == len(own)
            if own:
                assert r["quantile"] == pytest.approx(np.quantile(own, 0.9), abs=1e-9)
                if r["value"] is not None and ahead >= 0:
                    assert r["rank_pct"] == pytest.approx((2 * sum(v < r["value"] for v in own) + sum(v == r["value"] for v in own) + 1) / (2 * len(own)))


def test_tests_of_counts_for_small_and_large_numbers(spark):
    import math

    rows = [(3, 10, 0.2), (0, 10, 0.2), (10, 10, 0.5), (11, 10, 0.5), (40, 60, 0.3), (700, 2000, 0.33), (120_000, 400_000, 0.3), (121_500, 400_000, 0.3)]
    got = spark.createDataFrame(rows, "k long, n long, p double").select("k", "n", "p", evaluate.binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("b"), evaluate.poisson_tail(F.col("k"), F.col("n") * F.col("p")).alias("q")).collect()
    log = lambda n, i, p: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)
    for r in got:
        want = sum(math.exp(log(r["n"], i, r["p"])) for i in range(r["k"], r["n"] + 1)) if r["k"] else 1.0
        assert r["b"] == pytest.approx(min(want, 1.0), rel=1e-6, abs=1e-12), r
        m = r["n"] * r["p"]
        want = 1 - sum(math.exp(i * math.log(m) - m - math.lgamma(i + 1)) for i in range(r["k"])) if r["k"] else 1.0
        assert r["q"] == pytest.approx(max(want, 0.0), rel=1e-6, abs=1e-9), r
    fisher = spark.createDataFrame([(3, 4, 4, 8), (1, 4, 4, 8), (0, 4, 4, 8)], "a long, r long, c long, n long").select(evaluate.fisher_tail(F.col("a"), F.col("r"), F.col("c"), F.col("n")).alias("p")).collect()
    assert [r["p"] for r in fisher] == pytest.approx([17 / 70, 69 / 70, 1.0])


def test_residuals_and_distances_of_vectors(spark):
    from plantwatch.operators import models

    rng = np.random.default_rng(44)
    x = rng.normal(0, 1, (200, 5)) @ rng.normal(0, 1, (5, 5)) + 3
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: r["distance"] for r in models.mahalanobis_of_vectors(df, "embedding").collect()}
    z = x - x.mean(axis=0)
    cov, n, d = z.T @ z / 200, 200, 5
    mu = np.trace(cov) / d
    apart = ((cov - mu * np.eye(d)) ** 2).sum() / d
    noise = min(apart, sum(((np.outer(v, v) - cov) ** 2).sum() for v in z) / n**2 / d)
    inverse = np.linalg.inv((1 - noise / apart) * cov + noise / apart * mu * np.eye(d))
    assert got[999] is None and [got[i] for i in range(200)] == pytest.approx([float(np.sqrt(v @ inverse @ v)) for v in z], rel=1e-6)
    res = {r["vec_id"]: r["residual"] for r in models.pca_residual_of_vectors(df, "embedding", 0.8).collect()}
    w, v = np.linalg.eigh(cov)
    order = np.argsort(w)[::-1]
    k = int(np.searchsorted(np.cumsum(w[order]) / w.sum(), 0.8) + 1)
    rest = v[:, order[k:]]
    assert res[999] is None and [res[i] for i in range(200)] == pytest.approx((((z @ rest) ** 2).sum(axis=1) / d).tolist(), rel=1e-6, abs=1e-9)
