"""Announced failures, modes, cells and robust selection against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantwatch.operators import evaluate, models

H = 3_600_000_000


def test_failures_take_the_clock_that_announces_most(spark):
    stops = spark.createDataFrame([(0, 100 * H, 2.0), (0, 110 * H, 9.0), (0, 134 * H, 3.0), (1, 100 * H, 4.0), (1, 500 * H, 4.0)], "asset long, start long, hours double")
    alarms = [(0, 97 * H, "B"), (0, 97 * H + 1, "A"), (0, 97 * H + 2, "B"), (0, 107 * H, "C"), (0, 131 * H, "A"), (1, 97 * H, "D"), (1, 100 * H, "E")]
    got = evaluate.failures(stops, spark.createDataFrame(alarms, "asset long, t long, text string"), ["asset"], [-3 * H, 0, 3 * H], H, H // 2, 24 * H)
    rows = sorted((r["asset"], r["event"] // H, r["hours"], r["repeats"], r["texts"], r["offset"] // H) for r in got.collect())
    assert rows == [(0, 100, 9.0, 1, ["B", "A"], 3), (0, 134, 3.0, 0, ["A"], 3), (1, 100, 4.0, 0, ["D"], 3)]  # a gap of 24 h starts anew
    none = evaluate.failures(stops, spark.createDataFrame([], "asset long, t long, text string"), ["asset"], [0], H, H, H)
    assert none.collect() == []


def test_modes_of_texts_and_signals(spark):
    texts = spark.createDataFrame([("seal of bearing",), ("seal",), ("?!",), (None,)], "s string")
    got = [r[0] for r in texts.select(evaluate.text_mode(F.col("s"), [("bearing", "b"), ("seal", "s")])).collect()]
    assert got == ["b", "s", "?", "?"]
    events = spark.createDataFrame([(0, 10 * H, "m"), (0, 20 * H, "m"), (0, 90 * H, "m")], "asset long, t long, mode string")
    rows = [(0, "y", 8 * H, 4.0, 2.0, True), (0, "x", 8 * H, 1.0, 2.0, True), (0, "x", 19 * H, 6.0, 2.0, False), (0, "x", 20 * H, None, 2.0, None), (0, "y", 5 * H, 9.0, 2.0, True)]
    held = evaluate.signal_attribution(spark.createDataFrame(rows, "asset long, tag string, t long, value double, limit double, held boolean"), events, ["asset"], "tag", 4 * H)
    assert sorted((r["t"] // H, r["tag"], r["points"], r["peak"], r["sustained"], r["first"]) for r in held.collect()) == [(10, "x", 1, 0.5, True, 8 * H), (10, "y", 1, 2.0, True, 8 * H), (20, "x", 1, 3.0, False, None)]
    assert evaluate.modes(held, ["asset"], "mode", "tag").collect()[0].asDict() == {"mode": "m", "events": 2, "detected": 1, "lead_h": 2.0, "first_signal": "x"}


def test_cells_of_two_axes(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 2, float(rng.normal()), float(rng.integers(0, 4)), float(rng.normal()), bool(rng.random() < 0.6)) for k in range(240)]
    rows += [(0, None, 1.0, 1.0, True), (0, 1.0, None, 1.0, True), (0, 99.0, 99.0, 1.0, False), (7, 1.0, 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "asset long, a double, b double, y double, fit boolean")
    got = sorted(models.cell_residual(df, ["asset"], {"a": 4, "b": 3}, "y", "fit").select("asset", "a", "b", "y", "fit", "cell", "expected").collect(), key=repr)
    want = []
    for row in rows:
        fit = [r for r in rows if r[4] and r[0] == row[0]]
        cell = expected = None
        if fit and None not in row:
            edges = [np.quantile([r[j] for r in fit if r[j] is not None], [i / n for i in range(1, n)]) for j, n in ((1, 4), (2, 3))]
            at = lambda r: [int((e <= r[j]).sum()) for j, e in zip((1, 2), edges, strict=True)]  # noqa: E731, B023
            cell = at(row)
            own = [r[3] for r in fit if None not in r and at(r) == cell]
            expected = float(np.median(own or [r[3] for r in fit]))
        want.append((*row, cell, expected))
    assert len(got) == len(want)
    by = {tuple(r)[:5]: tuple(r)[5:] for r in got}
    for w in want:
        cell, expected = by[w[:5]]
        assert cell == w[5] and expected == (None if w[6] is None else pytest.approx(w[6]))


def test_left_out_costs_and_five_criteria(spark):
    rng = np.random.default_rng(9)
    incidents = [(a, int(t) * H) for a in (0, 1) for t in rng.choice(200, 5, replace=False)]
    eps = [(c, a, int(s) * H, int(s + rng.integers(0, 30)) * H) for c in range(6) for a in (0, 1) for s in rng.choice(200, 4, replace=False)]
    before = 10 * H
    touches = lambda e, i: e[1] == i[0] and e[2] <= i[1] and e[3] >= i[1] - before
    want = {(c, *i): sum(e[0] == c and not any(touches(e, o) for o in incidents if o != i) for e in eps) for c in range(6) for i in incidents}
    got = evaluate.left_out_costs(spark.createDataFrame(eps, "config int, asset long, start long, end long"), spark.createDataFrame(incidents, "asset long, t long"), ["asset"], ["config"], before, 24 * H)
    assert {(r["config"], r["asset"], r["t"]): r["false"] for r in got.collect()} == want

    table = [(c, f"e{k}", bool(rng.random() < 0.5), float(rng.integers(0, 9)), float(rng.integers(0, 5))) for c in range(6) for k in range(7)]
    beside = [(c, o) for c in range(6) for o in (c - 1, c + 1) if 0 <= o < 6]
    hit, lead, cost = ({(c, e): r[j] for r in table for c, e in [r[:2]]} for j in (2, 3, 4))
    events = sorted({r[1] for r in table})
    hits = dict.fromkeys(evaluate.CRITERIA, 0)
    for e in events:
        found = {c: sum(hit[c, o] for o in events if o != e) for c in range(6)}
        mean = {c: np.mean([lead[c, o] for o in events if o != e]) for c in range(6)}
        worst = {c: min([found[c]] + [found[o] for a, o in beside if a == c]) for c in range(6)}
        plateau = {c: sum(found[o] >= found[c] for a, o in beside if a == c) for c in range(6)}
        marks = {"found": lambda c: found[c] * 1000 - cost[c, e], "worst": lambda c: worst[c] * 1000 - cost[c, e], "plateau": lambda c: found[c] * 1000 + plateau[c] * 10 - cost[c, e]}  # noqa: B023
        marks |= {"found_lead": lambda c: found[c] * 1000 + mean[c], "worst_lead": lambda c: worst[c] * 1000 + mean[c]}  # noqa: B023
        within = [c for c in range(6) if cost[c, e] <= 1]
        for name, mark in marks.items():
            if within:
                hits[name] += hit[max(within, key=lambda c: (round(mark(c), 9), -c)), e]  # noqa: B023
    got = evaluate.robust_selection(spark.createDataFrame(table, "config int, event string, hit boolean, lead double, cost double"), spark.createDataFrame(beside, "config int, other int"), "config", "event", "cost", 1.0)
    assert {r["criterion"]: (r["hits"], r["events"]) for r in got.collect()} == {k: (v, 7) for k, v in hits.items()}
