"""Queries: streaming forms, run over the given events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwatch.functions.columns import HOUR, MINUTE, micros
from plantwatch.plans import tables as T
from plantwatch.plans.q_clean import r6
from plantwatch.plans.q_series import KEYS
from plantwatch.plans.q_state import _P
from plantwatch.plans.registry import query
from plantwatch.streaming import alerting, monitor


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """(asset, tag, ts, t, value) of the events as they are found in the folder."""
    schema = T.table(spark, d, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    ts = F.col("ts").cast("timestamp")
    return e.select((F.col("user_id") % 8).alias("asset"), F.col("event_type").alias("tag"), ts.alias("ts"), micros(F.col("ts")).alias("t"), "value")


@query("l03_stream_bins", f"""with {T.READINGS}, b as (select asset, tag, t // 7200000000 * 7200000000 as start, count(*) as n, round(avg(value), 6) as mean, max(value) as top from readings group by all) select * from b where start + 7200000000 <= (select max(t) - 600000000 from readings)""")
def l03(spark: SparkSession, d: str) -> DataFrame:
    out = alerting.run_to_table(alerting.binned(event_stream(spark, d), "2 hours"), T.shared_folder(spark, "stream"))
    return out.select("asset", "tag", micros(F.col("start")).alias("start"), "n", r6("mean").alias("mean"), "top")


@query("l04_stream_alerts", f"""with {T.READINGS}, e as (select a.asset, a.tag, a.t, a.value, sum(b.value * power(0.5, (a.t - b.t) / 21600000000.0)) / sum(power(0.5, (a.t - b.t) / 21600000000.0)) as m from readings a join readings b on a.asset = b.asset and a.tag = b.tag and b.t <= a.t where a.t < ((select max(t) from readings) // 1000 - 600000) * 1000 group by all),
    f as (select *, m >= 60 and value >= 2 as up from e), g as (select *, sum(case when up is distinct from p then 1 else 0 end) over ({_P} rows unbounded preceding) as run from (select *, lag(up) over ({_P}) as p from f)), h as (select *, count(*) over (partition by asset, tag, run) as size, max(run) over (partition by asset, tag) as newest from g)
    select asset, tag, t, round(m, 6) as ewma, up and size >= 3 as alert from h where not (up and size < 3 and run = newest)""")
def l04(spark: SparkSession, d: str) -> DataFrame:
    stream = event_stream(spark, d).withColumn("off", F.col("value") < 2)
    out = alerting.run_to_table(alerting.alert_stream(stream, 6 * HOUR, 60.0, 3), T.shared_folder(spark, "stream"))
    return out.select("asset", "tag", "t", r6("ewma").alias("ewma"), "alert")


@query("l05_stream_dedup", f"""with {T.READINGS} select asset, tag, count(distinct t) as n from readings group by all""")
def l05(spark: SparkSession, d: str) -> DataFrame:
    stream = event_stream(spark, d)
    out = alerting.run_to_table(alerting.deduplicated(stream.union(stream)), T.shared_folder(spark, "stream"))
    return out.groupBy("asset", "tag").agg(F.count("*").alias("n"))


_RULES = monitor.Rules(half_life=6 * HOUR, threshold=60.0, drift=0.5, limit=4.0, gap=6 * HOUR, hold=24 * HOUR, delay=10 * MINUTE)
_CUT = "(select min(t) + (max(t) - min(t)) // 2 from readings)"
_MON = f"""{T.READINGS}, p as (select asset, tag, avg(value) as mu, stddev_pop(value) as sd from readings where t <= {_CUT} group by all), zs as (select asset, tag, t, value, case when sd > 0 then (value - mu) / sd end as z from readings left join p using (asset, tag)),
    n as (select *, row_number() over ({_P}) as k, sum(coalesce(z - 0.5, 0)) over ({_P} rows unbounded preceding) as c from zs), cs as (select *, c - least(0, min(c) over ({_P} rows unbounded preceding)) as s from n),
    es as (select a.asset, a.tag, a.t, sum(b.value * power(0.5, (a.t - b.t) / 21600000000.0)) / sum(power(0.5, (a.t - b.t) / 21600000000.0)) as ewma from readings a join readings b on a.asset = b.asset and a.tag = b.tag and b.t <= a.t group by all),
    rd as (select asset, tag, cs.t, ewma, s as cusum, ewma >= 60 or s >= 4 as up from cs join es using (asset, tag, t)), tops as (select asset, tag, max(t) as top, max(t) filter (where t <= {_CUT}) as before from readings group by all)"""


def _past_and_stream(spark: SparkSession, d: str) -> DataFrame:
    """The monitor's rows over the second half of the events as a stream, from the states that the first half leaves."""
    rows = T.readings(spark, d)
    cut = rows.agg(F.expr("min(t) + (max(t) - min(t)) div 2").alias("cut")).first()["cut"]
    past = rows.where(F.col("t") <= F.lit(cut))
    states = monitor.last_states(monitor.standardised(past, past), _RULES)
    fitted = past.groupBy(*KEYS).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    stream = event_stream(spark, d).where(F.col("t") > F.lit(cut)).join(fitted, list(KEYS), "left")
    stream = stream.withColumn("z", F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")))
    return alerting.run_to_table(monitor.monitored(stream, _RULES, states), T.shared_folder(spark, "stream"))


@query("l01_stream_from_kept_states", f"""with {_MON} select asset, tag, t, round(ewma, 6) as ewma, round(cusum, 6) as cusum, up from rd join tops using (asset, tag) where t > {_CUT} and t <= top - 600000000""")
def l01_stream(spark: SparkSession, d: str) -> DataFrame:
    return _past_and_stream(spark, d).where("kind = 'reading'").select(*KEYS, "t", r6("ewma").alias("ewma"), r6("cusum").alias("cusum"), "up")


@query("l04_stream_episodes", f"""with recursive {_MON}, e as (select asset, tag, min(t) as start, max(t) as "end", count(*) as points from (select *, sum(case when t - q <= 21600000000 then 0 else 1 end) over ({_P} rows unbounded preceding) as e from (select *, lag(t) over ({_P}) as q from rd where up)) group by asset, tag, e),
    m as (select *, row_number() over (partition by asset, tag order by start) as j from e),
    r as (select asset, tag, j, start, "end", points, "end" as until, true as kept from m where j = 1 union all select m.asset, m.tag, m.j, m.start, m."end", m.points, case when m.start > r.until + 86400000000 then m."end" else r.until end, m.start > r.until + 86400000000 from r join m on m.asset = r.asset and m.tag = r.tag and m.j = r.j + 1)
    select asset, tag, start, "end", points, kept from r join tops using (asset, tag) where "end" + 21600000000 < top - 600000000 and ("end" + 21600000000 >= before or before is null)""")
def l04_episodes(spark: SparkSession, d: str) -> DataFrame:
    return _past_and_stream(spark, d).where("kind = 'episode'").select(*KEYS, "start", "end", "points", "kept")


@query("l04_stream_late_rows", f"""with {T.READINGS}, p as (select *, t % 3600000000 < 600000000 as held from readings), a as (select asset, tag, max(t) as top from p where not held group by all) select asset, tag, t, value from p join a using (asset, tag) where held and t <= top - {6 * HOUR}""")
def l04_late(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the first ten minutes of each hour arrive after all others, when the stream is started again; those six hours or more behind are late."""
    folder, to = T.shared_folder(spark, "arrivals"), T.shared_folder(spark, "stream")
    rows = T.readings(spark, d).withColumn("z", F.lit(0.0))
    held = F.col("t") % HOUR < 10 * MINUTE
    for part in (~held, held):
        rows.where(part).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        out = alerting.run_to_table(monitor.monitored(stream, monitor.Rules(delay=6 * HOUR)), to)  # goes on from its checkpoint
    return out.where("kind = 'late'").select(*KEYS, "t", "value")
