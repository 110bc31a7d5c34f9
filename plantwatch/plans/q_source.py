"""Queries: sources and sinks; each writes what Spark derives from the given tables to a shared folder and reads it again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwatch.functions.columns import DAY, HOUR, MINUTE
from plantwatch.operators import models, state
from plantwatch.plans import tables as T
from plantwatch.plans.q_clean import r6
from plantwatch.plans.q_eval import _WIN, windows
from plantwatch.plans.q_series import KEYS
from plantwatch.plans.registry import query
from plantwatch.sources import sensors

#: The five event types, which are the tags of the given tables; fixed names.
TAGS = ("click", "error", "purchase", "signup", "view")
_WIDE = f"{T.BINS}, x as (select asset, t from bins group by all), tags as (select unnest({list(TAGS)}) as tag), wide as (select x.asset, tags.tag, x.t, b.value from x cross join tags left join bins b on b.asset = x.asset and b.t = x.t and b.tag = tags.tag)"


def _wide_file(spark: SparkSession, d: str, first: str) -> str:
    """Path of CSV files with a column a tag, an asset column, and the time under the name `first` in front."""
    path = T.shared_folder(spark, "csv")
    at = F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd HH:mm:ss")
    time = F.when(F.col("asset") % 2 == 0, at).otherwise(F.concat(F.date_format(F.timestamp_micros(F.col("t") - 3 * HOUR), "yyyy-MM-dd HH:mm:ss"), F.lit("-03:00")))  # with and without a zone
    pivoted = T.bins(spark, d).groupBy("asset", "t").pivot("tag", list(TAGS)).agg(F.first("value"))
    pivoted.select(time.alias(first), "asset", *TAGS).write.csv(path, header=True)
    return path


@query("a01_wide_csv_scan", f"with {_WIDE} select asset, tag, t, round(value, 6) as value from wide")
def a01(spark: SparkSession, d: str) -> DataFrame:
    rows = sensors.wide_csv(spark, _wide_file(spark, d, "data_datetime"), ["data_datetime", "asset", *TAGS], "data_datetime", None)
    return rows.select("asset", "tag", "t", r6("value").alias("value"))


@query("a02_first_column_is_the_time", f"with {_WIDE} select asset, tag, t, round(value, 6) as value from wide")
def a02(spark: SparkSession, d: str) -> DataFrame:
    rows = sensors.wide_csv(spark, _wide_file(spark, d, "when"), ["when", "asset", *TAGS], asset=None)
    return rows.select("asset", "tag", "t", r6("value").alias("value"))


@query("a08_csv_column_list", f"with {_WIDE} select asset, tag, t, round(value, 6) as value from wide where tag in ('error', 'view')")
def a08(spark: SparkSession, d: str) -> DataFrame:
    rows = sensors.wide_csv(spark, _wide_file(spark, d, "when"), ["when", "asset", *TAGS], asset=None, keep=["error", "view"])
    return rows.select("asset", "tag", "t", r6("value").alias("value"))


_GRID_SQL = f"with {T.READINGS}, g as (select asset, tag, t // 120000000 * 120000000 as t, quantile_cont(case when value between 1 and 200 then value end, 0.5) as value from readings group by all)"


@query("a04_masked_grid_job", f"{_GRID_SQL} select asset, tag, t, round(value, 6) as value from g")
def a04(spark: SparkSession, d: str) -> DataFrame:
    path = T.shared_folder(spark, "grid")
    sensors.grid_job(T.readings(spark, d), path, 2 * MINUTE, 1.0, 200.0)
    return sensors.read_grid(spark, path).select(F.col("asset").cast("long").alias("asset"), "tag", "t", r6("value").alias("value"))


@query("a07_grid_columns_and_months", f"{_GRID_SQL} select asset, tag, t, round(value, 6) as value from g where tag in ('click', 'view') and strftime(make_timestamp(t), '%Y-%m') = '2024-01'")
def a07(spark: SparkSession, d: str) -> DataFrame:
    path = T.shared_folder(spark, "grid")
    sensors.grid_job(T.readings(spark, d), path, 2 * MINUTE, 1.0, 200.0)
    return sensors.read_grid(spark, path, ["click", "view"], ["2024-01"]).select(F.col("asset").cast("long").alias("asset"), "tag", "t", r6("value").alias("value"))


@query("a10_trip_register", f"with {T.INCIDENTS}, e as (select distinct t // 1000000 * 1000000 as t from incidents) select t, 'csv' as source from e union all select t, 'json' from e")
def a10(spark: SparkSession, d: str) -> DataFrame:
    at = F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd HH:mm:ss")
    i = T.incidents(spark, d)
    csv, text = T.shared_folder(spark, "trips"), T.shared_folder(spark, "trips")
    i.select(at.alias("evento"), "asset").write.csv(csv, header=True)
    i.groupBy("asset").agg(F.to_json(F.struct(F.collect_list(at).alias("trips"))).alias("value")).select("value").repartition(8, "value").write.text(text)
    lists = sensors.trips_json(spark.read.text(text))
    missing = sensors.trips(spark, T.shared_folder(spark, "trips"))  # no such file: no trips
    return sensors.trips(spark, csv).union(missing).withColumn("source", F.lit("csv")).union(lists.withColumn("source", F.lit("json")))


@query("a11_bundles", f"with {T.READINGS} select asset || '-' || tag as sensor, 30 as time_steps, round(quantile_cont(value, 0.5), 6) as center, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) as scale, round(max(value), 6) as threshold, 4.0::double as half_life_hours, round(quantile_cont(value, 0.9), 6) as ewma_abs_threshold, 1.0::double as debounce_hours from readings group by asset, tag")
def a11(spark: SparkSession, d: str) -> DataFrame:
    path, q = T.shared_folder(spark, "bundles"), lambda x: F.percentile("value", x)
    g = T.readings(spark, d).groupBy(*KEYS).agg(r6(q(0.5)).alias("center"), r6(q(0.75) - q(0.25)).alias("scale"), r6(F.max("value")).alias("threshold"), r6(q(0.9)).alias("top"))
    alerting = F.struct(F.lit(4.0).alias("half_life_hours"), F.col("top").alias("ewma_abs_threshold"), F.lit(1.0).alias("debounce_hours"))
    g.select(F.to_json(F.struct(F.concat_ws("-", *KEYS).alias("sensor"), F.lit(30).alias("time_steps"), "center", "scale", "threshold", alerting.alias("production_alerting")))).write.text(path)
    return sensors.bundle_json(spark.read.text(path))


@query("a12_score_sink", f"""with {_WIN}, e as (select asset, tag, start, list_avg(list_transform(x, lambda v: abs(v - list_avg(x)))) as mae from win), q as (select asset, tag, quantile_cont(mae, 0.95) as q from e group by all) select asset, e.tag, start as seq_start, round(mae + 1e-9, 4) as mae_seq, mae > q as is_anom_seq from e join q using (asset, tag)""")
def a12(spark: SparkSession, d: str) -> DataFrame:
    path = T.shared_folder(spark, "scores")
    e = windows(spark, d).select(*KEYS, F.col("start").alias("seq_start"), models.window_error(F.col("x")).alias("mae_seq"))
    q = e.groupBy(*KEYS).agg(F.percentile("mae_seq", 0.95).alias("q"))
    sensors.write_scores(e.join(q, KEYS).select(*KEYS, "seq_start", F.round(F.col("mae_seq") + 1e-9, 4).alias("mae_seq"), (F.col("mae_seq") > F.col("q")).alias("is_anom_seq")), path)
    return spark.read.parquet(path)


@query("a13_report_sink", f'with {T.READINGS} select tag, count(*) as "rows", count(distinct asset) as assets, min(t) as first_t, max(t) as last_t, round(quantile_cont(value, 0.5), 6) as middle from readings group by tag')
def a13(spark: SparkSession, d: str) -> DataFrame:
    path = T.shared_folder(spark, "report")
    g = T.readings(spark, d).groupBy("tag")
    sensors.write_report(g.agg(F.count("*").alias("rows"), F.count_distinct("asset").alias("assets"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), r6(F.percentile("value", 0.5)).alias("middle")), path)
    return spark.read.schema("tag string, rows long, assets long, first_t long, last_t long, middle double").json(path)


@query("a14_episode_summary_sink", f"""with {T.BINS}, a as (select asset, t, max(value) as strength, count(*) as channels from bins where value > 60 group by all), e as (select *, sum(case when t - p <= 21600000000 then 0 else 1 end) over (partition by asset order by t rows unbounded preceding) as e from (select *, lag(t) over (partition by asset order by t) as p from a))
    select asset, min(t) as start, max(t) as "end", round((max(t) - min(t)) / 3.6e9, 6) as hours, round(max(strength), 6) as strength, max(channels) as channels from e group by asset, e""")
def a14(spark: SparkSession, d: str) -> DataFrame:
    path = T.shared_folder(spark, "episodes")
    alerts = T.bins(spark, d).where("value > 60").groupBy("asset", "t").agg(F.max("value").alias("strength"), F.count("*").alias("channels"))
    sensors.episode_summary(alerts, 6 * HOUR).write.parquet(path)
    return spark.read.parquet(path).select("asset", "start", "end", r6("hours").alias("hours"), r6("strength").alias("strength"), "channels")


@query("l01_warm_up_rerun", f"""with {T.READINGS}, z as (select asset, tag, max(t) as z from readings group by all), e as (select a.asset, a.tag, a.t, sum(b.value * power(0.5, (a.t - b.t) / 43200000000.0)) / sum(power(0.5, (a.t - b.t) / 43200000000.0)) as whole,
    sum(b.value * power(0.5, (a.t - b.t) / 43200000000.0)) filter (where b.t > z - {15 * DAY}) / sum(power(0.5, (a.t - b.t) / 43200000000.0)) filter (where b.t > z - {15 * DAY}) as again from readings a join z using (asset, tag) join readings b on a.asset = b.asset and a.tag = b.tag and b.t <= a.t where a.t > z - {3 * DAY} group by all)
    select asset, tag, count(*) as n, round(max(abs(whole - again)), 4) as apart from e group by all""")
def l01(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d)
    last = rows.groupBy(*KEYS).agg(F.max("t").alias("z"))
    whole = state.ewma_time(rows, 12 * HOUR, into="whole").select(*KEYS, "t", "whole")
    late = rows.join(last, KEYS).where(F.col("t") > F.col("z") - 15 * DAY)
    again = state.ewma_time(late, 12 * HOUR, into="again").where(F.col("t") > F.col("z") - 3 * DAY).select(*KEYS, "t", "again")
    return again.join(whole, [*KEYS, "t"]).groupBy(*KEYS).agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("whole") - F.col("again"))), 4).alias("apart"))


@query("l02_bundle_expiry", f"""with {T.READINGS}, b as (select asset, tag, max(t) as baseline_end from readings where value > 250 group by all), n as (select asset, max(baseline_end) as newest from b group by asset) select asset, tag, baseline_end, (select max(t) from readings) - newest > {2 * DAY} as expired from b join n using (asset)""")
def l02(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d)
    b = rows.where("value > 250").groupBy(*KEYS).agg(F.max("t").alias("baseline_end"))
    now = rows.agg(F.max("t")).first()[0]
    return sensors.expired(b, now or 0, 2).select(*KEYS, "baseline_end", "expired")
