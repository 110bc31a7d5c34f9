"""Points that rows are compared with, to the last bit those of the SQL, and queries without any stop."""

import duckdb
import numpy as np

from plantwatch.operators import quantiles


def test_cut_points_are_those_of_the_sql(spark):
    rng = np.random.default_rng(9)
    rows = [(k, float(x)) for k in range(60) for x in ([round(float(rng.exponential(50)), 2)] * (k + 2) if k % 2 else np.round(rng.exponential(50, k + 2), 2))]
    rows += [(98, None), (99, 4.25)]
    df = spark.createDataFrame(rows, "tag int, value double")
    got = {tuple(r) for r in quantiles.cut_points(df, ["tag"], "value", {"a": 0.33, "b": 0.6, "c": 0.66}).collect()}
    c = duckdb.connect()
    c.execute("create table v (tag int, value double)")
    c.executemany("insert into v values (?, ?)", rows)
    assert got == set(c.execute("select tag, quantile_cont(value, 0.33), quantile_cont(value, 0.6), quantile_cont(value, 0.66) from v group by tag").fetchall())


def test_no_stops_no_rows(spark, tmp_path):
    from __spark_entry__ import oracle_sql, queries

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_type in ('view', 'error') and (event_type = 'error' or value > 20)")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert c.execute(oracle_sql()["b03_clock_offset"]).fetchall() == []
    assert queries()["b03_clock_offset"](spark, str(tmp_path)).collect() == []
