"""Order statistics of many frames against sorting each frame."""

import numpy as np
import pytest

from plantwatch.operators import models
from plantwatch.operators.frames import Frames


@pytest.mark.parametrize("ties", [False, True])
def test_frames_against_sorting(ties):
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 64, 65, 500):
        x = rng.integers(-4, 5, n).astype(float) if ties else rng.normal(size=n)
        low = rng.integers(0, n + 1, 200)
        high = np.minimum(n, low + rng.integers(0, n + 1, 200))
        f, centre = Frames(x), rng.choice(x, 200) + rng.choice([0.0, 0.3], 200)
        for share in (0.0, 0.5, 0.9, 1.0):
            want = [np.quantile(x[a:b], share) if b > a else np.nan for a, b in zip(low, high, strict=True)]
            np.testing.assert_allclose(f.quantile(low, high, share), want, rtol=0, atol=1e-12)
        for side, less in (("left", np.less), ("right", np.less_equal)):
            want = [less(x[a:b], c).sum() for a, b, c in zip(low, high, centre, strict=True)]
            assert f.below(low, high, centre, side).tolist() == want
        want = [np.median(np.abs(x[a:b] - c)) if b > a else np.nan for a, b, c in zip(low, high, centre, strict=True)]
        np.testing.assert_allclose(f.median_distance(low, high, centre), want, rtol=0, atol=1e-12)


def test_no_values_and_infinite_ones():
    empty = Frames(np.array([]))
    assert np.isnan(empty.quantile(np.array([0]), np.array([0]), 0.5)).all()
    assert empty.below(np.array([0]), np.array([0]), np.array([1.0])).tolist() == [0]
    f = Frames(np.array([-np.inf, 1.0, np.inf]))
    assert f.quantile(np.array([0, 0]), np.array([3, 1]), 0.5).tolist() == [1.0, -np.inf]


def test_long_references_of_a_series(spark):
    """References of 400 units every 6, as the inventory has them, with nulls, ties and rows that aren't fitted to."""
    rng = np.random.default_rng(8)
    rows = []
    for asset in (0, 1):
        for t in np.sort(rng.choice(6000, 900, replace=False)) - 700:
            rows.append((asset, "x", int(t), None if rng.random() < 0.1 else float(np.round(rng.normal(), 1)), bool(rng.random() < 0.8), f"row {t}"))
    df = spark.createDataFrame(rows, "asset long, tag string, t long, value double, ok boolean, note string")
    for usable in (None, "ok"):
        got = {(r["asset"], r["t"]): r for r in models.guarded_z(df, 6, 24, 424, 20, usable=usable).collect()}
        assert len(got) == len(rows)
        for asset, _, t, v, _, note in rows:
            start = t // 6 * 6
            fit = np.array([r[3] for r in rows if r[0] == asset and start - 424 <= r[2] < start - 24 and r[3] is not None and (usable is None or r[4])])
            z = None
            if len(fit) >= 20 and v is not None and (mad := np.median(np.abs(fit - np.median(fit)))) > 0:
                z = (v - np.median(fit)) / (1.4826 * mad)
            assert got[asset, t]["note"] == note
            assert got[asset, t]["z"] == (None if z is None else pytest.approx(z, abs=1e-9))
    assert models.guarded_z(df.where("asset > 5"), 6, 24, 424, 20).count() == 0
