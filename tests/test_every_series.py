"""Queries over all series against a plain loop."""

import datetime as dt

import numpy as np
import pytest

import __spark_entry__

ASSETS, TAGS, HOURS = 8, ("click", "error", "view"), 40


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(a, tag, start + dt.timedelta(hours=k, minutes=a), float(v)) for a in range(ASSETS) for tag in TAGS for k, v in enumerate(rng.gamma(2, 30, HOURS))]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp_ntz, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    series = {(a, tag): [r[3] for r in rows if r[:2] == (a, tag)] for a in range(ASSETS) for tag in TAGS}
    return folder, series


def loop(name, x):
    z, s, out = (np.array(x) - np.mean(x)) / np.std(x), 0.0, []
    for k, v in enumerate(x):
        if name == "i01_ewma_points_all":
            w = 0.5 ** (np.arange(k, -1, -1) / 12)
            s = float((w * x[: k + 1]).sum() / w.sum())
        elif name == "i03_health_ewma_all":
            s = v if k == 0 else (1 - 0.5 ** (1 / 8)) * v + 0.5 ** (1 / 8) * s
        elif name == "i04_cusum_all":
            s = max(0.0, s + z[k] - 0.5)
        elif name == "i05_cusum_with_reset_all":
            s = max(0.0, s * (0.25 if k and k % 24 == 0 else 1) + z[k] - 0.2)
        else:
            s = s * 0.5 ** (1 / 10) + z[k]
        out.append(s)
    return out


@pytest.mark.parametrize(("name", "column"), [("i01_ewma_points_all", "ewma"), ("i03_health_ewma_all", "health"), ("i04_cusum_all", "cusum"), ("i05_cusum_with_reset_all", "cusum"), ("i06_forgetting_cusum_all", "leaky")])
def test_every_series_is_the_loop(spark, events, name, column):
    folder, series = events
    got = {}
    for r in __spark_entry__.queries()[name](spark, folder).orderBy("asset", "tag", "t").collect():
        got.setdefault((r["asset"], r["tag"]), []).append(r[column])
    assert got.keys() == series.keys()
    for key, x in series.items():
        assert got[key] == pytest.approx(loop(name, x), abs=2e-6)
