"""The stateful monitor: kept states, late rows, timers, against its batch twin."""

import numpy as np
import pandas as pd
import pytest

from plantwatch.streaming import monitor

SECOND = 1_000_000
RULES = monitor.Rules(half_life=20 * SECOND, threshold=1.2, drift=0.4, limit=2.5, gap=4 * SECOND, hold=15 * SECOND, delay=5 * SECOND)
SCHEMA = "asset long, tag string, t long, value double, z double"


def data(n=400, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for asset in (0, 1):
        t = np.cumsum(rng.choice([1, 1, 1, 2, 9], n)) * SECOND + 10**12
        x = rng.normal(1, 1, n)
        out += [(asset, "x", int(a), None if k % 17 == 0 else float(b), None if k % 23 == 0 else float(b - 1)) for k, (a, b) in enumerate(zip(t, x, strict=True))]
    return out


def write(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, tmp_path, states=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = monitor.monitored(stream, RULES, states).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return spark.read.schema(monitor.OUTPUT).parquet(str(tmp_path / "out"))


def close_to(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g[3:], w[3:], strict=True):
            assert a == b or (a is not None and b is not None and a == pytest.approx(b, rel=1e-9, abs=1e-9)), (g, w)


def readings(df):
    return sorted((r["asset"], r["tag"], r["t"], r["ewma"], r["cusum"], r["up"]) for r in df.collect())


def closed(df):
    return sorted((r["asset"], r["tag"], r["start"], r["end"], r["points"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize("share", [0.0, 0.5])
def test_stream_from_a_kept_state_is_the_batch_over_all_rows(spark, tmp_path, share):
    rows = sorted(data(), key=lambda r: r[2])
    cut = int(len(rows) * share)
    folder = str(tmp_path / "in")
    rest = rows[cut:]
    swapped = [r for k in range(0, len(rest), 3) for r in reversed(rest[k : k + 3])]  # out of order, within the delay
    for k in range(4):
        write(spark, swapped[k * len(rest) // 4 : (k + 1) * len(rest) // 4], folder)
    past = spark.createDataFrame(rows[:cut], SCHEMA)
    out = run(spark, folder, tmp_path, monitor.last_states(past, RULES) if cut else None).cache()
    whole = spark.createDataFrame(rows, SCHEMA)
    new = {(r[0], r[1], r[2]) for r in rest}
    assert out.where("kind = 'late'").count() == 0
    want, episodes = monitor.monitored_batch(whole, RULES)
    folded = monitor.after_rows(whole, RULES.delay).select("asset", "tag", "t")
    want = [r for r in readings(want.join(folded, ["asset", "tag", "t"])) if r[:3] in new]
    close_to(readings(out.where("kind = 'reading'")), want)
    top = {a: max(r[2] for r in rows if r[0] == a) - RULES.delay for a in (0, 1)}
    mine, theirs = closed(out.where("kind = 'episode'")), closed(episodes)
    before = {a: max([r[2] for r in rows[:cut] if r[0] == a], default=-1) for a in (0, 1)}
    expected = [e for e in theirs if e[3] + RULES.gap < top[e[0]] and e[3] + RULES.gap >= before[e[0]]]
    assert mine == expected and len(mine) > 10 and {e[5] for e in mine} == {True, False}


def test_late_rows_are_all_in_the_side_table(spark, tmp_path):
    rows = sorted(data(200), key=lambda r: r[2])
    folder = str(tmp_path / "in")
    late = [r for r in rows[50:250:9]]
    again = rows[100:104]
    write(spark, [r for r in rows if r not in late], folder)
    write(spark, late + again, folder)
    out = run(spark, folder, tmp_path).cache()
    got = sorted((r["asset"], r["t"]) for r in out.where("kind = 'late'").collect())
    tops = {a: max(r[2] for r in rows if r[0] == a and r not in late) for a in (0, 1)}
    behind = [r for r in late + again if r[2] <= tops[r[0]] - RULES.delay or r in again]
    assert got == sorted((r[0], r[2]) for r in behind) and len(got) > 20
    on_time = spark.createDataFrame([r for r in rows if r not in behind or r in again], SCHEMA)
    want, _ = monitor.monitored_batch(on_time, RULES)
    want = want.join(monitor.after_rows(on_time, RULES.delay).select("asset", "tag", "t"), ["asset", "tag", "t"])
    close_to(readings(out.where("kind = 'reading'")), readings(want))


class Kept:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, x):
        self.value = x

    put = update

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, name, schema):  # noqa: N802
        return Kept()

    def getListState(self, name, schema):  # noqa: N802
        return Kept()

    def listTimers(self):  # noqa: N802
        return self.timers

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


class Clock:
    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return 1000


def test_an_idle_series_is_folded_and_closed_by_its_timer():
    m = monitor.Monitor(RULES, timers=True)
    m.init(handle := Handle())
    rows = pd.DataFrame({"t": [10 * SECOND, 11 * SECOND], "value": [5.0, 5.0], "z": [0.0, 0.0]})
    assert list(m.handleInputRows((0, "x"), iter([rows]), Clock())) == [] and handle.timers == [1000 + RULES.idle_ms]
    out = pd.concat(m.handleExpiredTimer((0, "x"), Clock(), None))
    assert out["kind"].tolist() == ["reading", "reading", "episode"] and out["points"].iloc[-1] == 2 and bool(out["kept"].iloc[-1])
    again = pd.concat(m.handleInputRows((0, "x"), iter([rows]), Clock()))
    assert again["kind"].tolist() == ["late", "late"] and len(handle.timers) == 1
