"""Rules in their whole form: exact trends, fills, formats by share, stored statistics, running time."""

from itertools import permutations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantwatch.functions.columns import micros, parse_by_shares, time_shares
from plantwatch.operators import channels, clean, evaluate, models, ranks, state

KEYS = ["asset", "tag"]


def series(spark, values, times=None):
    times = times or range(len(values))
    return spark.createDataFrame([(0, "x", int(t), v) for t, v in zip(times, values, strict=True)], "asset long, tag string, t long, value double")


def midranks(x):
    return [sum(y < v for y in x) + (sum(y == v for y in x) + 1) / 2 for v in x]


@pytest.mark.parametrize("ties", [False, True])
def test_exact_trends_are_those_of_all_orders(ties):
    rng = np.random.default_rng(61)
    for n in range(3, 9):
        for _ in range(2):
            x = (rng.integers(0, 4, n) if ties else rng.permutation(n)).astype(float).tolist()
            r = midranks(x)
            far = lambda order: abs(sum(k * v for k, v in enumerate(order, 1)) - n * (n + 1) ** 2 / 4)  # noqa: E731, B023
            s = lambda order: abs(sum(np.sign(order[j] - order[i]) for i in range(n) for j in range(i)))  # noqa: E731, B023
            orders = list(permutations(r))
            assert ranks.spearman_p(x) == pytest.approx(sum(far(o) >= far(r) - 1e-9 for o in orders) / len(orders), abs=1e-12)
            if n < 8:
                assert ranks.kendall_p(x) == pytest.approx(sum(s(o) >= s(r) for o in orders) / len(orders), abs=1e-12)


def test_trends_of_many_periods_and_of_few(spark):
    assert ranks.kendall_null([1] * 4) == [1, 3, 5, 6, 5, 3, 1] and sum(ranks.kendall_null([1] * 30)) == factorial(30)
    assert sum(ranks.spearman_null([2 * k for k in range(1, 13)])) == 479001600
    rows = spark.createDataFrame([(0, "long", k, float(k)) for k in range(40)] + [(0, "twelve", k, float(-k)) for k in range(12)] + [(0, "two", k, 1.0) for k in range(2)] + [(0, "flat", k, 1.0) for k in range(5)], "asset long, tag string, p long, v double")
    got = {r["tag"]: (r["periods"], r["rho_p"], r["tau_p"]) for r in ranks.trends(rows, KEYS, "p", "v").collect()}
    assert got["long"][0] == 40 and got["long"][1] is None and got["long"][2] < 1e-40
    assert got["twelve"] == (12, pytest.approx(2 / 479001600), pytest.approx(2 / 479001600)) and got["two"] == (2, None, None) and got["flat"] == (5, 1.0, 1.0)
    assert ranks.trends(rows.where("false"), KEYS, "p", "v").count() == 0


def test_fills_of_uneven_times(spark):
    values = [None, None, None, 1.0, None, None, None, None, 9.0, None, None]
    times = [0, 1, 2, 3, 4, 5, 50, 51, 53, 54, 60]
    rows = series(spark, values, times)
    take = lambda df: [r["filled"] for r in df.orderBy("t").collect()]
    limited = [None, None, 1.0, 1.0, 1.0 + 8 / 5, None, None, 1.0 + 8 * 4 / 5, 9.0, 9.0, None]
    assert take(clean.interpolate(rows, 1)) == limited
    a, b = 2.6, 7.4
    line = lambda t: a + (b - a) * ((t - 4) / (51 - 4))
    assert take(clean.fill_all(rows, 1)) == pytest.approx([1, 1, 1, 1, a, line(5), line(50), b, 9, 9, 9])
    assert take(clean.fill_all(rows, 1, weighted=False)) == pytest.approx([1, 1, 1, 1, a, a, a, b, 9, 9, 9])
    assert take(clean.fill_all(series(spark, [None, None]), 1, otherwise=0.0)) == [0.0, 0.0] and take(clean.fill_all(series(spark, [None]), 1)) == [None]


def test_formats_by_share(spark):
    cases = {
        "day first": ["05/01/2024 10:00:00"] * 9 + ["2024-01-05 10:00:00"],
        "iso": ["2024-01-05 10:00:00"] * 10 + ["05/01/2024"],
        "loose iso": ["2024-01-05 10:00:00"] * 8 + ["2024-01-05", "junk"],
        "month first": ["05/01/2024"] * 5 + ["2024-05-01"] * 5,
        "empty": [None, ""],
    }
    rows = spark.createDataFrame([(k, i, s) for k, own in cases.items() for i, s in enumerate(own)], "k string, i int, s string")
    shares = rows.groupBy("k").agg(*(c.alias(n) for n, c in time_shares(F.col("s")).items()))
    at = rows.join(shares, "k").withColumn("t", F.date_format(parse_by_shares(F.col("s"), F.col("slashed"), F.col("iso"), F.col("failed")), "MM-dd"))
    got = {}
    for r in at.orderBy("k", "i").collect():
        got.setdefault(r["k"], []).append(r["t"])
    assert got["day first"] == ["01-05"] * 10 and got["iso"] == ["01-05"] * 10 + [None] and got["loose iso"] == ["01-05"] * 9 + [None]
    assert got["month first"] == ["05-01"] * 10 and got["empty"] == [None, None] and micros(F.col("s")) is not None


def test_scores_with_stored_statistics(spark):
    rows = series(spark, [1.0, 3.0, 100.0, None, 5.0, 5.0]).withColumn("on", F.col("t") != 5)
    bundles = spark.createDataFrame([(0, "x", 1.0, 0.0, 1.5, None, 11.0)], "asset long, tag string, centre double, scale double, threshold double, low double, high double")
    got = models.score_with_bundles(rows.where("t <> 3"), bundles, 2, 1, on="on").orderBy("seq").collect()
    assert [(r["seq"], r["end"], r["score"], r["state"], r["is_anom"]) for r in got] == [(0, 1, 1.0, "on", False), (1, 2, 6.0, "on", True), (2, 4, 7.0, "on", True), (3, 5, 4.0, "off", False)]
    more = bundles.unionByName(bundles.withColumn("tag", F.lit("gone")))
    with pytest.raises(ValueError, match="0/gone"):
        models.score_with_bundles(rows, more, 2, 1)


def test_a_clock_that_stops_while_off(spark):
    on = [True, True, False, False, True, True, True]
    up = [False, True, True, False, True, True, False]
    rows = series(spark, [0.0] * 7, [0, 1, 2, 3, 4, 5, 50]).withColumn("on", F.element_at(F.array(*map(F.lit, on)), F.when(F.col("t") == 50, 7).otherwise(F.col("t") + 1).cast("int")))
    rows = rows.withColumn("up", F.element_at(F.array(*map(F.lit, up)), F.when(F.col("t") == 50, 7).otherwise(F.col("t") + 1).cast("int")))
    clock = [r["ran"] for r in state.running_clock(rows, "on", 10).orderBy("t").collect()]
    assert clock == [10, 11, 11, 11, 12, 13, 23]
    held = [r["held"] for r in state.sustained_running(rows, "up", "on", 3, 10).orderBy("t").collect()]
    assert held == [False, False, False, False, False, True, False]


def test_causal_z_reaches_back_over_usable_time_only(spark):
    values = [1.0, 2.0, 3.0, 50.0, 50.0, 4.0, 7.0, 5.0]
    rows = series(spark, values).withColumn("hot", F.col("value") < 50)
    got = {r["t"]: r["z"] for r in models.causal_z(rows, 5, 2, 2, "hot", 1).collect()}
    assert got[5] == pytest.approx((4 - 2.5) / (1.4826 * 0.5)) and got[7] == pytest.approx((5 - 2.5) / (1.4826 * 0.5)) and got[0] is None
    flat = series(spark, [1.0, 1.0, 1.0, 3.0, 1.0, 2.0]).withColumn("hot", F.lit(True))
    z = {r["t"]: r["z"] for r in models.causal_z(flat, 5, 5, 2, "hot", 1).collect()}
    assert z[5] == pytest.approx((2 - 1) / np.std([1, 1, 1, 3, 1], ddof=1))


def test_cuts_and_leaving_one_out(spark):
    rng = np.random.default_rng(62)
    rows = [(f, f"e{k}", None if k == 11 else float(rng.integers(0, 9)), bool(rng.random() < 0.4)) for f in ("a", "b", "c") for k in range(30)] + [("one", "e1", 2.0, True), ("one", "e2", 3.0, False)]
    got = {r["feature"]: tuple(r)[1:] for r in evaluate.cuts_that_keep_positives(spark.createDataFrame(rows, "feature string, event string, x double, positive boolean")).collect()}
    for f in ("a", "b", "c", "one"):
        own = [(-np.inf if x is None else x, y, e) for g, e, x, y in rows if g == f]
        good = [(x, e) for x, y, e in own if y]
        cut = min(x for x, _ in good)
        loo = sum(any(e != o for _, o in good) and x >= min(v for v, o in good if o != e) for x, e in good)
        assert got[f] == (cut, len(good), len(own) - len(good), sum(x >= cut for x, y, _ in own if not y), loo)


def test_baselines_of_periods_of_any_length(spark):
    values, periods = [1.0, 2.0, 3.0, 9.0, 4.0, 6.0, 8.0, 5.0], [1, 1, 1, 2, 3, 3, 3, 4]
    rows = series(spark, values).withColumn("p", F.element_at(F.array(*map(F.lit, periods)), (F.col("t") + 1).cast("int")))
    z = lambda m: {r["t"]: r["z"] for r in models.period_z(rows, "p", 3, m).collect()}
    assert z(1)[0] is None and z(1)[3] == pytest.approx((9 - 2) / 1.4826) and z(1)[4] == pytest.approx((4 - 2) / 1.4826) and z(1)[7] == pytest.approx((5 - 6) / 1.4826 / 2)
    assert z(2)[7] == pytest.approx((5 - 4) / (1.4826 * 1.5)) and z(2)[4] == z(1)[4]


def test_channels_of_specs_are_those_of_brute_force(spark):
    rng = np.random.default_rng(63)
    tags, rows, data = ["a", "b", "c", "d"], [], {}
    for asset in (0, 1):
        for t in range(90):
            base = rng.normal()
            for k, tag in enumerate(tags):
                x = None if rng.random() < 0.1 else float(base * (k + 1) + 0.1 * rng.normal())
                rows.append((asset, tag, t, t // 30, x))
                data[asset, t, tag] = x
    specs = [("p", "pca", tags, None), ("q", "pca", ["a", "c"], None), ("m", "zmax", tags, None), ("s", "spread", ["b", "a", "c"], None), ("g", "spread_alvo", tags, "b")]
    z = spark.createDataFrame(rows, "asset long, tag string, t long, period long, z double")
    got = {(r["channel"], r["asset"], r["t"]): r["score"] for r in channels.channel_scores(z, spark.createDataFrame(specs, "channel string, kind string, tags array<string>, target string")).collect()}
    want = {}
    for channel, kind, own, target in specs:
        for asset in (0, 1):
            bases = {}
            for period in range(3):
                full = np.array([[data[asset, t, g] for g in sorted(own)] for t in range(30 * period, 30 * period + 30) if all(data[asset, t, g] is not None for g in own)])
                if len(full) >= 20:
                    mean = full.mean(axis=0)
                    values, vectors = np.linalg.eigh(np.cov(full.T, bias=True))
                    order = np.argsort(values)[::-1]
                    rest = vectors[:, order[int(np.searchsorted(np.cumsum(values[order]) / values.sum(), 0.95)) + 1 :]]
                    bases[period] = mean, rest @ rest.T
            for t in range(90):
                x = {g: data[asset, t, g] for g in own if data[asset, t, g] is not None}
                apart = {g: abs(v - np.mean([u for h, u in x.items() if h != g])) for g, v in x.items()} if len(x) > 1 else {}
                if kind == "pca":
                    before = [p for p in bases if p < t // 30]
                    if len(x) == len(own) and before:
                        mean, out = bases[max(before)]
                        want[channel, asset, t] = float(((out @ (np.array([x[g] for g in sorted(own)]) - mean)) ** 2).mean())
                elif kind == "zmax" and x:
                    want[channel, asset, t] = max(map(abs, x.values()))
                elif kind == "spread" and apart:
                    want[channel, asset, t] = max(apart.values())
                elif kind == "spread_alvo" and target in apart:
                    want[channel, asset, t] = apart[target]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-9) for k in want)
    assert sum(k[0] == "p" for k in want) > 50
