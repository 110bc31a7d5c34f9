"""The given tables as sensor data, in Spark and as SQL common table expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantwatch.functions.columns import HOUR, floor_to, micros
from plantwatch.operators.align import regular_grid
from plantwatch.operators.episodes import chain

KEYS = ("asset", "tag")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder that all machines share, in spark.checkpoint.dir; a temporary one on one machine where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix=f"spark-{kind}-")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, tag, t, value): asset is user_id % 8, tag the event type."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 8).alias("asset"), F.col("event_type").alias("tag"), micros(F.col("ts")).alias("t"), "value")


def bins(spark: SparkSession, sf_dir: str, step: int = HOUR) -> DataFrame:
    """(asset, tag, t, value): medians of `step` bins."""
    return readings(spark, sf_dir).groupBy("asset", "tag", floor_to(F.col("t"), step).alias("t")).agg(F.percentile("value", 0.5).alias("value"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bins with every hour from the first to the last of a series; holes are null."""
    return regular_grid(bins(spark, sf_dir), HOUR)


def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, t, on): whether the last known `view` value is above 15; unknown counts as off."""
    last = F.last("value", ignorenulls=True).over(Window.partitionBy("asset").orderBy("t"))
    return grid(spark, sf_dir).where("tag = 'view'").select("asset", "t", F.coalesce(last > 15, F.lit(False)).alias("on"))


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, tag, t, condition, priority, status) of the error events."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    condition = F.when(F.col("value") > 120, "HIHI").when(F.col("value") > 60, "HI").when(F.col("value") < 5, "OK").otherwise("CFN")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select((F.col("user_id") % 8).alias("asset"), F.concat(F.lit("T"), (F.col("user_id") % 3).cast("string")).alias("tag"), micros(F.col("ts")).alias("t"), condition.alias("condition"), F.when(k >= 70, "HIGH").otherwise("LOW").alias("priority"))
    return e.withColumn("status", F.when(F.col("condition") == "OK", "INACT").otherwise("ACT"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, t): first alarms of runs of HI and HIHI whose gaps are 4 h at most."""
    serious = alarms(spark, sf_dir).where("condition in ('HI', 'HIHI')")
    return chain(serious.select("asset", "t"), ["asset"], 4 * HOUR).groupBy("asset", "episode").agg(F.min("t").alias("t")).select("asset", "t")


READINGS = "readings as (select user_id % 8 as asset, event_type as tag, epoch_us(ts) as t, value from events)"
BINS = f"{READINGS}, bins as (select asset, tag, t // 3600000000 * 3600000000 as t, quantile_cont(value, 0.5) as value from readings group by all)"
GRID = f"""{BINS}, grid as (select s.asset, s.tag, s.t, b.value from
    (select asset, tag, unnest(generate_series(a, b, 3600000000)) as t from (select asset, tag, min(t) as a, max(t) as b from bins group by all)) s left join bins b using (asset, tag, t))"""
RUNNING = f"""{GRID}, running as (select asset, t, coalesce(last_value(value ignore nulls) over (partition by asset order by t) > 15, false) as "on" from grid where tag = 'view')"""
ALARMS = """alarms as (select user_id % 8 as asset, 'T' || (user_id % 3) as tag, epoch_us(ts) as t,
    case when value > 120 then 'HIHI' when value > 60 then 'HI' when value < 5 then 'OK' else 'CFN' end as condition,
    case when cast(json_extract_string(props, '$.k') as int) >= 70 then 'HIGH' else 'LOW' end as priority,
    case when value < 5 then 'INACT' else 'ACT' end as status from events where event_type = 'error')"""
INCIDENTS = f"""{ALARMS}, incidents as (select asset, min(t) as t from (select *, sum(new) over (partition by asset order by t rows unbounded preceding) as e from
    (select asset, t, case when t - lag(t) over (partition by asset order by t) <= 14400000000 then 0 else 1 end as new from alarms where condition in ('HI', 'HIHI'))) group by asset, e)"""
