"""Movements and the scaled PCA score against plain numpy and pandas."""

import numpy as np
import pandas as pd
import pytest

from plantwatch.operators import channels, models

H = 3_600_000_000


def test_movements_are_those_of_pandas(spark):
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.integers(1, 4, 80)) * H
    v = pd.Series(rng.normal(size=80).cumsum())
    on = rng.random(80) < 0.6
    df = spark.createDataFrame([(0, "a", int(a), float(b), bool(c)) for a, b, c in zip(t, v, on, strict=True)] + [(0, "b", H, 1.0, False)], "asset long, tag string, t long, value double, on boolean")
    got = {(r["tag"], r["t"]): r for r in channels.movements(df, 6, 2 * H, "on").collect()}
    e = v.ewm(halflife=pd.Timedelta("2h"), times=pd.to_datetime(t, unit="us")).mean()
    slope = pd.Series([np.nan if i < 4 else np.polyfit(np.arange(max(0, i - 5), i + 1), e[max(0, i - 5) : i + 1], 1)[0] for i in range(80)])
    wanted = {"volatility": v.rolling(6, min_periods=3).std(), "delta": e - e.shift(6).rolling(6, min_periods=3).median(), "slope": slope}
    for form, x in wanted.items():
        m = x[on].median()
        z = (x - m).abs() / (1.4826 * (x[on] - m).abs().median())
        for a, b in zip(t, z, strict=True):
            own = got["a", int(a)][form]
            assert own is None if np.isnan(b) else own == pytest.approx(b, rel=1e-6, abs=1e-9), (form, a)
    assert [got["b", H][form] for form in channels.FORMS] == [None] * 3
    assert channels.movements(df.limit(0), 6, 2 * H, "on").count() == 0


def test_scaled_pca_score_is_that_of_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 5)) + 0.1 * rng.normal(size=(60, 5))
    x = np.hstack([x * [1, 10, 100, 1, 1], np.ones((60, 1))])  # a component without spread
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)] + [(99, None)], "vec_id long, v array<double>")
    got = {r["vec_id"]: r["score"] for r in models.scaled_pca_score(df, "v", 0.95).collect()}
    a, m, b = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    s = (x - m) / np.where(b > a, b - a, 1)
    c = s - s.mean(axis=0)
    w, u = np.linalg.eigh(c.T @ c / len(c))
    w, u = w[::-1], u[:, ::-1]
    k = int(np.searchsorted(np.cumsum(w) / w.sum(), 0.95) + 1)
    r = ((c @ u[:, k:]) ** 2).sum(axis=1) / 6
    assert [got[i] for i in range(60)] == pytest.approx(list(r / np.quantile(r, 0.99)), rel=1e-6)
    assert got[99] is None
    assert models.scaled_pca_score(df.limit(0), "v").count() == 0
