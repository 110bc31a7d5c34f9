"""Queries: movements against watched rows, peaks of episodes and hours since start, the robustly scaled PCA score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwatch.functions.columns import DAY, HOUR, floor_to
from plantwatch.operators import align, channels, clean, episodes, models
from plantwatch.plans import tables as T
from plantwatch.plans.q_clean import r6
from plantwatch.plans.q_rest import _RULER, _hourly_alerts
from plantwatch.plans.q_series import KEYS
from plantwatch.plans.registry import query

_N = 12
_AT = lambda a, b: f"(partition by asset, tag order by t rows between {a} preceding and {b})"
_FIT = lambda f: f"(select asset, tag, m, quantile_cont(abs({f} - m), 0.5) as d from f join (select asset, tag, quantile_cont({f}, 0.5) as m from f where \"on\" group by all) using (asset, tag) where \"on\" group by all)"


@query("e27_movements_of_watched_rows", f"""with {T.RUNNING}, b as (select bins.*, coalesce(r."on", false) as "on" from bins left join running r on r.asset = bins.asset and r.t = bins.t),
    e as (select a.asset, a.tag, a.t, any_value(a.value) as value, any_value(a."on") as "on", sum(b.value * power(0.5, (a.t - b.t) / {2 * HOUR}.0)) / sum(power(0.5, (a.t - b.t) / {2 * HOUR}.0)) as e from b a join b on a.asset = b.asset and a.tag = b.tag and b.t <= a.t group by all),
    k as (select *, row_number() over (partition by asset, tag order by t) as k from e),
    f as (select asset, tag, t, "on", case when k >= {_N // 2} then stddev_samp(value) over {_AT(_N - 1, 'current row')} end as v, case when k >= {_N + _N // 2} then e - quantile_cont(e, 0.5) over {_AT(2 * _N - 1, f'{_N} preceding')} end as dl, case when k > 0.8 * {_N} then regr_slope(e, k) over {_AT(_N - 1, 'current row')} end as sl from k)
    select f.asset, f.tag, f.t, {', '.join(f"round(abs({c} - {x}.m) / greatest(1.4826 * {x}.d, 1e-9), 4) as {n}" for c, x, n in (("v", "p", "volatility"), ("dl", "q", "delta"), ("sl", "r", "slope")))} from f {' '.join(f"left join {_FIT(c)} {x} on {x}.asset = f.asset and {x}.tag = f.tag" for c, x in (("v", "p"), ("dl", "q"), ("sl", "r")))}""")
def e27(spark: SparkSession, d: str) -> DataFrame:
    on = T.running(spark, d)
    rows = T.bins(spark, d).join(on, ["asset", "t"], "left").withColumn("on", F.coalesce("on", F.lit(False)))
    out = channels.movements(rows, _N, 2 * HOUR, "on")
    return out.select(*KEYS, "t", *(F.round(f, 4).alias(f) for f in channels.FORMS))


@query("k28_peaks_and_hours_since_start", f"""with {_RULER}, st as (select asset, t from (select asset, t, "on" and not coalesce(lag("on") over (partition by asset order by t), false) as st from s) where st)
    select ep.asset, ep."start", r.tag, round(max(r.value), 6) as peak, round(quantile_cont(r.value, 0.5), 6) as middle, round((ep."start" - (select max(st.t) from st where st.asset = ep.asset and st.t <= ep."start")) / 3.6e9, 6) as since_start from ep join readings r on r.asset = ep.asset and r.t between ep."start" and ep."end" group by ep.asset, ep."start", r.tag""")
def k28(spark: SparkSession, d: str) -> DataFrame:
    hourly = _hourly_alerts(spark, d)
    ep = episodes.episodes(hourly.where("alert").select("asset", "t"), ["asset"], 6 * HOUR).select("asset", "start", "end")
    since = clean.since_start(hourly.select("asset", "t", "on"), ["asset"]).select("asset", "t", "since")
    ep = align.asof(ep.withColumn("t", F.col("start")), since, ["asset"], ["since"]).select("asset", "start", "end", (F.col("since") / float(HOUR)).alias("hours"))
    own = ep.withColumn("_k", F.explode(F.sequence(floor_to(F.col("start"), DAY), floor_to(F.col("end"), DAY), F.lit(DAY))))  # a row a day, for an equi-join
    r = own.join(T.readings(spark, d).withColumn("_k", floor_to(F.col("t"), DAY)), ["asset", "_k"]).where(F.col("t").between(F.col("start"), F.col("end")))
    return r.groupBy("asset", "start", "tag").agg(r6(F.max("value")).alias("peak"), r6(F.percentile("value", 0.5)).alias("middle"), r6(F.first("hours")).alias("since_start"))


@query("j07_scaled_pca_score")
def j07(spark: SparkSession, d: str) -> DataFrame:
    return models.scaled_pca_score(T.table(spark, d, "embeddings"), "embedding").select("vec_id", r6("score").alias("score"))
