"""Queries: joins, aggregations, windows, top-k, sets, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from plantwatch.functions import columns as C
from plantwatch.functions.columns import DAY, HOUR, MINUTE
from plantwatch.operators import align, blocks, clean, quantiles, rolling
from plantwatch.operators.episodes import episodes, runs
from plantwatch.plans import tables as T
from plantwatch.plans.q_clean import r6
from plantwatch.plans.registry import query

KEYS = ["asset", "tag"]


def W() -> WindowSpec:
    """Rows of a series in time order."""
    return Window.partitionBy(*KEYS).orderBy("t")


@query("c01_inner_alignment", f"""with {T.BINS}, n as (select asset, t, max(value) filter (where tag = 'click') as click, max(value) filter (where tag = 'view') as "view" from bins group by all)
    select * from n where click is not null and "view" is not null""")
def c01(spark: SparkSession, d: str) -> DataFrame:
    return align.aligned(T.bins(spark, d).where("tag in ('click', 'view')"), ["asset", "t"], ["click", "view"])


@query("c02_outer_max_with_carry", f"""with {T.BINS}, tags as (select distinct tag from bins), ts as (select distinct asset, t from bins),
    f as (select ts.asset, ts.t, tag, coalesce(last_value(value ignore nulls) over (partition by ts.asset, tag order by ts.t), 0) as v from ts cross join tags left join bins using (asset, t, tag))
    select asset, t, round(max(v), 6) as health from f group by all""")
def c02(spark: SparkSession, d: str) -> DataFrame:
    b = T.bins(spark, d)
    frame = b.select("asset", "t").distinct().crossJoin(F.broadcast(b.select("tag").distinct())).join(b, ["asset", "t", "tag"], "left")
    return frame.withColumn("v", F.coalesce(F.last("value", ignorenulls=True).over(W()), F.lit(0.0))).groupBy("asset", "t").agg(r6(F.max("v")).alias("health"))


@query("c03_state_at_row", f"""with {T.RUNNING} select b.asset, b.tag, b.t, coalesce(r."on", false) as "on" from bins b left join running r using (asset, t)""")
def c03(spark: SparkSession, d: str) -> DataFrame:
    return T.bins(spark, d).join(T.running(spark, d), ["asset", "t"], "left").select("asset", "tag", "t", F.coalesce("on", F.lit(False)).alias("on"))


@query("c04_nearest_asof", f"""with {T.READINGS}, {T.INCIDENTS}, v as (select asset, t, value from readings where tag = 'view')
    select i.asset, i.t, first(v.t order by abs(v.t - i.t), v.t) as t_match, first(v.value order by abs(v.t - i.t), v.t) as value from incidents i join v on v.asset = i.asset and v.t between i.t - 86400000000 and i.t + 86400000000 group by i.asset, i.t""")
def c04(spark: SparkSession, d: str) -> DataFrame:
    view = T.readings(spark, d).where("tag = 'view'").select("asset", "t", "value")
    return align.asof(T.incidents(spark, d), view, ["asset"], ["value"], "nearest").where(F.abs(F.col("t_match") - F.col("t")) <= DAY)


@query("c05_regrade_with_tolerance", f"""with {T.READINGS}, b as (select *, (t + 900000000) // 1800000000 * 1800000000 as g from readings) select asset, tag, g as t, arg_min(value, [abs(t - g), t]) as value from b where abs(t - g) <= 600000000 group by all""")
def c05(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d).withColumn("g", C.floor_to(F.col("t") + 15 * MINUTE, 30 * MINUTE))
    off = F.abs(F.col("t") - F.col("g"))
    return rows.where(off <= 10 * MINUTE).groupBy("asset", "tag", F.col("g").alias("t0")).agg(F.min_by("value", F.struct(off, "t")).alias("value")).withColumnRenamed("t0", "t")


@query("c06_backward_asof", f"""with {T.RUNNING}, {T.INCIDENTS}, s as (select asset, t from (select *, "on" and not coalesce(lag("on") over (partition by asset order by t), false) as start from running) where start)
    select i.asset, i.t, s.t as start_t from incidents i asof left join s on s.asset = i.asset and s.t <= i.t""")
def c06(spark: SparkSession, d: str) -> DataFrame:
    s = clean.starts(T.running(spark, d), ["asset"]).where("start").select("asset", "t")
    return align.asof(T.incidents(spark, d), s, ["asset"], []).withColumnRenamed("t_match", "start_t")


@query("c07_model_validity", f"""with {T.READINGS}, m as (select distinct asset, tag, t // 604800000000 * 604800000000 as valid_from from readings)
    select r.asset, r.tag, r.t // 86400000000 * 86400000000 as day, max(m.valid_from) as model from readings r left join m on m.asset = r.asset and m.tag = r.tag and m.valid_from < r.t // 86400000000 * 86400000000 - 86400000000 group by all""")
def c07(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d)
    models = rows.select("asset", "tag", (C.floor_to(F.col("t"), 7 * DAY)).alias("t")).distinct()
    days = rows.select("asset", "tag", (C.floor_to(F.col("t"), DAY)).alias("day")).distinct().withColumn("t", F.col("day") - DAY - 1)
    return align.asof(days, models, KEYS, []).select("asset", "tag", "day", F.col("t_match").alias("model"))


@query("c08_alerts_before_incidents", f"""with {T.READINGS}, {T.INCIDENTS}, a as (select asset, t as u from readings where tag = 'purchase' and value > 60)
    select i.asset, i.t, count(u) as alerts, min(u) as first_alert, round((i.t - min(u)) / 3600000000.0, 6) as lead_h from incidents i join a on a.asset = i.asset and u between i.t - 28800000000 and i.t group by i.asset, i.t""")
def c08(spark: SparkSession, d: str) -> DataFrame:
    a = T.readings(spark, d).where("tag = 'purchase' and value > 60").select("asset", F.col("t").alias("u"))
    met = align.range_join(T.incidents(spark, d), a, ["asset"], 8 * HOUR, 0)
    return met.groupBy("asset", "t").agg(F.count("u").alias("alerts"), F.min("u").alias("first_alert"), r6((F.col("t") - F.min("u")) / float(HOUR)).alias("lead_h"))


_EPISODES = f"""{T.READINGS}, a as (select asset, t from readings where tag = 'purchase' and value > 60),
    ep as (select asset, e as episode, min(t) as start, max(t) as "end", count(*) as points from (select *, sum(case when t - p <= 21600000000 then 0 else 1 end) over (partition by asset order by t rows unbounded preceding) as e from
    (select *, lag(t) over (partition by asset order by t) as p from a)) group by all)"""


def alert_episodes(spark: SparkSession, d: str) -> DataFrame:
    return episodes(T.readings(spark, d).where("tag = 'purchase' and value > 60"), ["asset"], 6 * HOUR)


@query("c09_false_alarm_episodes", f"""with {_EPISODES}, {T.INCIDENTS} select asset, start, "end" from ep where not exists (select 1 from incidents i where i.asset = ep.asset and ep.start <= i.t and ep."end" >= i.t - 28800000000)""")
def c09(spark: SparkSession, d: str) -> DataFrame:
    i = T.incidents(spark, d).select("asset", (F.col("t") - 8 * HOUR).alias("a"), F.col("t").alias("b"))
    return align.overlaps(alert_episodes(spark, d), i, ["asset"], DAY, "left_anti").select("asset", "start", "end")


@query("c10_texts_around_stops", f"""with {T.INCIDENTS} select i.asset, i.t, array_to_string(list_slice(list_sort(list_distinct(list(a.condition || ' ' || a.tag))), 1, 3), ';') as texts
    from incidents i join alarms a on a.asset = i.asset and a.t between i.t - 3600000000 and i.t + 1800000000 group by i.asset, i.t""")
def c10(spark: SparkSession, d: str) -> DataFrame:
    a = T.alarms(spark, d).select("asset", F.col("t").alias("u"), F.concat_ws(" ", "condition", "tag").alias("text"))
    met = align.range_join(T.incidents(spark, d), a, ["asset"], HOUR, HOUR // 2)
    return met.groupBy("asset", "t").agg(F.array_join(F.slice(F.array_sort(F.collect_set("text")), 1, 3), ";").alias("texts"))


@query("c11_active_interval_overlap", f"""with {_EPISODES}, {T.ALARMS}, s as (select *, sum(case when status = 'INACT' then 1 else 0 end) over w - case when status = 'INACT' then 1 else 0 end as seg, max(t) over (partition by asset) as last from alarms window w as (partition by asset order by t rows unbounded preceding)),
    iv as (select asset, min(t) filter (where status <> 'INACT') as a, coalesce(max(t) filter (where status = 'INACT'), max(last)) as b from s group by asset, seg having a is not null)
    select ep.asset, ep.start, count(iv.a) as n from ep left join iv on iv.asset = ep.asset and iv.a <= ep."end" and iv.b >= ep.start group by all""")
def c11(spark: SparkSession, d: str) -> DataFrame:
    from plantwatch.operators.episodes import active_intervals

    iv = active_intervals(T.alarms(spark, d), ["asset"]).select("asset", F.col("start").alias("a"), F.col("end").alias("b"))
    ep = alert_episodes(spark, d)
    n = align.overlaps(ep, iv, ["asset"], DAY).groupBy("asset", "start").agg(F.count("*").alias("n"))
    return ep.join(n, ["asset", "start"], "left").select("asset", "start", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("c12_tags_without_alarm", f"""with {T.READINGS}, {T.ALARMS} select distinct asset, tag from readings r where not exists (select 1 from alarms a where a.asset = r.asset and a.condition = 'HIHI' and a.priority = 'HIGH' and a.tag = 'T' || (length(r.tag) % 3))""")
def c12(spark: SparkSession, d: str) -> DataFrame:
    a = T.alarms(spark, d).where("condition = 'HIHI' and priority = 'HIGH'").select("asset", F.col("tag").alias("k"))
    rows = T.readings(spark, d).select("asset", "tag").distinct().withColumn("k", F.concat(F.lit("T"), (F.length("tag") % 3).cast("string")))
    return rows.join(a, ["asset", "k"], "left_anti").select("asset", "tag")


@query("c13_tag_to_column_mapping", """with l as (select p_partkey, p_brand, regexp_extract(p_brand, '([0-9]+)', 1) as loop from part), c as (select distinct p_brand as col, regexp_extract(p_brand, '([0-9]+)', 1) as loop from part where p_size > 25)
    select p_partkey, case count(col) when 0 then 'none' when 1 then 'ok' else 'ambiguous' end as status from l left join c using (loop) group by p_partkey""")
def c13(spark: SparkSession, d: str) -> DataFrame:
    part = T.table(spark, d, "part")
    loop = F.regexp_extract("p_brand", "([0-9]+)", 1).alias("loop")
    columns = part.where("p_size > 25").select(F.col("p_brand").alias("col"), loop).distinct().groupBy("loop").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return part.select("p_partkey", loop).join(F.broadcast(columns), "loop", "left").select("p_partkey", F.when(n == 0, "none").when(n == 1, "ok").otherwise("ambiguous").alias("status"))


@query("c14_threshold_grid", f"""with {T.READINGS}, g as (select unnest(generate_series(20, 100, 20)) as y) select y, tag, count(*) filter (where value > y) as above from readings cross join g group by all""")
def c14(spark: SparkSession, d: str) -> DataFrame:
    g = F.explode(F.sequence(F.lit(20), F.lit(100), F.lit(20)))
    return T.readings(spark, d).select("tag", "value", g.alias("y")).groupBy("y", "tag").agg(F.count_if(F.col("value") > F.col("y")).alias("above")).withColumn("y", F.col("y").cast("long"))


@query("d01_resample_median", f"with {T.BINS} select asset, tag, t, round(value, 6) as value from bins")
def d01(spark: SparkSession, d: str) -> DataFrame:
    return T.bins(spark, d).withColumn("value", r6("value"))


@query("d02_resample_mean_max_last", f"""with {T.READINGS} select asset, tag, t // 21600000000 * 21600000000 as bin, round(avg(value), 6) as mean, max(value) as top, arg_max(value, t) as last, avg(case when value > 15 then 1.0 else 0 end) >= 0.5 as majority from readings group by all""")
def d02(spark: SparkSession, d: str) -> DataFrame:
    g = T.readings(spark, d).groupBy("asset", "tag", C.floor_to(F.col("t"), 6 * HOUR).alias("bin"))
    return g.agg(r6(F.avg("value")).alias("mean"), F.max("value").alias("top"), F.max_by("value", "t").alias("last"), (F.avg((F.col("value") > 15).cast("double")) >= 0.5).alias("majority"))


@query("d03_regular_grid", f"with {T.GRID} select asset, tag, count(*) as steps, count(value) as known from grid group by all")
def d03(spark: SparkSession, d: str) -> DataFrame:
    return T.grid(spark, d).groupBy("asset", "tag").agg(F.count("*").alias("steps"), F.count("value").alias("known"))


@query("d04_sampling_interval", f"""with {T.READINGS}, x as (select *, (t - lag(t) over (partition by asset, tag order by t)) / 1000000.0 as dt from readings) select asset, tag, round(coalesce(quantile_cont(dt, 0.5) filter (where dt > 0), 1.0), 6) as seconds, round(8 * 3600 / quantile_cont(dt, 0.5) filter (where dt > 0), 0) as steps_8h from x group by all""")
def d04(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d).withColumn("dt", (F.col("t") - F.lag("t").over(W())) / 1e6).where("dt > 0")
    q = F.percentile("dt", 0.5)
    return rows.groupBy("asset", "tag").agg(r6(F.coalesce(q, F.lit(1.0))).alias("seconds"), F.round(8 * 3600 / q).alias("steps_8h"))


@query("d06_period_drift", f"""with {T.READINGS}, p as (select tag, quantile_cont(value, 0.95) as thr from readings group by tag)
    select tag, t // 604800000000 as week, count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, max(value) as top,
    round(avg(case when value > thr then 1.0 else 0 end), 6) as rate, quantile_cont(value, 0.95) > 1.1 * max(thr) as drifted from readings join p using (tag) group by all""")
def d06(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d)
    thr = quantiles.quantiles(rows, ["tag"], "value", {"thr": 0.95})
    rows = rows.join(thr, "tag").withColumn("week", F.floor(F.col("t") / (7 * DAY)))
    out = rows.groupBy("tag", "week").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("sd"), F.max("value").alias("top"), r6(F.avg((F.col("value") > F.col("thr")).cast("double"))).alias("rate"), F.max("thr").alias("thr"))
    out = out.join(quantiles.quantiles(rows, ["tag", "week"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}), ["tag", "week"])
    return out.select("tag", "week", "n", "mean", "sd", *(r6(k).alias(k) for k in ("p50", "p95", "p99")), "top", "rate", (F.col("p95") > 1.1 * F.col("thr")).alias("drifted"))


@query("d07_threshold_modes", f"""with {T.READINGS} select asset, tag, max(value) as top, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.995), 6) as p995, round(avg(value) + 3 * stddev_pop(value), 6) as mean_std, round(quantile_cont(value, 0.98), 6) as target_rate from readings group by all""")
def d07(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d)
    out = rows.groupBy(*KEYS).agg(F.max("value").alias("top"), r6(F.avg("value") + 3 * F.stddev_pop("value")).alias("mean_std"))
    out = out.join(quantiles.quantiles(rows, KEYS, "value", {"p95": 0.95, "p995": 0.995, "target_rate": 0.98}), list(KEYS))
    return out.select(*KEYS, "top", *(r6(c).alias(c) for c in ("p95", "p995", "target_rate")), "mean_std")


@query("d08_regime_band_thresholds", f"""with {T.BINS}, x as (select b.*, v.value as load from bins b left join bins v on v.asset = b.asset and v.t = b.t and v.tag = 'view' where b.tag = 'click'), c as (select *, case when load is null then -1 when load < 20 then 0 when load < 50 then 1 else 2 end as band from x),
    g as (select quantile_cont(value, 0.9) as thr from c), k as (select band, case when count(*) >= 200 then quantile_cont(value, 0.9) end as thr from c group by band) select band, count(*) as n, round(max(coalesce(k.thr, g.thr)), 6) as thr, count(*) filter (where value > coalesce(k.thr, g.thr)) as above from c join k using (band) cross join g group by band""")
def d08(spark: SparkSession, d: str) -> DataFrame:
    b = T.bins(spark, d)
    load = b.where("tag = 'view'").select("asset", "t", F.col("value").alias("load"))
    rows = b.where("tag = 'click'").join(load, ["asset", "t"], "left")
    rows = rows.withColumn("band", F.when(F.col("load").isNull(), -1).when(F.col("load") < 20, 0).when(F.col("load") < 50, 1).otherwise(2))
    overall = rows.agg(F.percentile("value", 0.9).alias("g"))
    own = rows.groupBy("band").agg(F.when(F.count("*") >= 200, F.percentile("value", 0.9)).alias("k"))
    rows = rows.join(F.broadcast(own), "band").crossJoin(F.broadcast(overall)).withColumn("thr", F.coalesce("k", "g"))
    return rows.groupBy("band").agg(F.count("*").alias("n"), r6(F.max("thr")).alias("thr"), F.count_if(F.col("value") > F.col("thr")).alias("above"))


@query("d10_rate_per_day", f"""with {T.READINGS} select asset, tag, round(count(*) filter (where value > 80) / ((max(t) - min(t)) / 86400000000.0), 6) as per_day from readings group by all""")
def d10(spark: SparkSession, d: str) -> DataFrame:
    g = T.readings(spark, d).groupBy("asset", "tag")
    return g.agg(r6(F.count_if(F.col("value") > 80) / ((F.max("t") - F.min("t")) / float(DAY))).alias("per_day"))


@query("d12_state_counts_and_duty", f"""with {T.RUNNING} select asset, count(*) filter (where "on") as on_rows, count(*) filter (where not "on") as off_rows, round(avg(case when "on" then 1.0 else 0 end), 6) as duty from running group by asset""")
def d12(spark: SparkSession, d: str) -> DataFrame:
    g = T.running(spark, d).groupBy("asset")
    return g.agg(F.count_if("on").alias("on_rows"), F.count_if(~F.col("on")).alias("off_rows"), r6(F.avg(F.col("on").cast("double"))).alias("duty"))


@query("d13_sensor_contribution", f"""with {T.BINS}, x as (select *, max(value) over (partition by asset, t) > 90 as anom from bins) select tag, round(avg(value), 6) as contribution, count(*) as n from x where anom group by tag""")
def d13(spark: SparkSession, d: str) -> DataFrame:
    rows = T.bins(spark, d).withColumn("top", F.max("value").over(Window.partitionBy("asset", "t")))
    return rows.where("top > 90").groupBy("tag").agg(r6(F.avg("value")).alias("contribution"), F.count("*").alias("n"))


@query("d14_flag_agreement", f"""with {T.BINS}, x as (select asset, t, max(value) filter (where tag = 'view') > 15 as a, max(value) filter (where tag = 'click') > 20 as b from bins group by all) select a, b, count(*) as n from x where a is not null and b is not null group by all""")
def d14(spark: SparkSession, d: str) -> DataFrame:
    wide = align.aligned(T.bins(spark, d).where("tag in ('view', 'click')"), ["asset", "t"], ["view", "click"])
    return wide.groupBy((F.col("view") > 15).alias("a"), (F.col("click") > 20).alias("b")).agg(F.count("*").alias("n"))


_RUNS = f"""{T.RUNNING}, rr as (select *, sum(case when "on" is distinct from p then 1 else 0 end) over (partition by asset order by t rows unbounded preceding) as run from (select *, lag("on") over (partition by asset order by t) as p from running))"""


@query("d15_off_blocks", f"""with {_RUNS} select asset, run, min(t) as start, count(*) as rows, case when count(*) >= 6 then 'long' else 'short' end as class from rr where not "on" group by all""")
def d15(spark: SparkSession, d: str) -> DataFrame:
    r = runs(T.running(spark, d), ["asset"], "on").where("not on").groupBy("asset", "run").agg(F.min("t").alias("start"), F.count("*").alias("rows"))
    return r.withColumn("class", F.when(F.col("rows") >= 6, "long").otherwise("short"))


@query("d16_label_scorecard", f"""with {T.READINGS}, {T.INCIDENTS}, p as (select asset, tag, quantile_cont(value, 0.5) as m from readings group by all), q as (select r.asset, r.tag, m, quantile_cont(abs(value - m), 0.5) as mad from readings r join p using (asset, tag) group by all),
    x as (select q.tag, i.asset, i.t, arg_max((value - m) / mad, [abs((value - m) / mad), r.t]) as z from incidents i join readings r on r.asset = i.asset and r.t between i.t - 21600000000 and i.t join q on q.asset = r.asset and q.tag = r.tag group by all)
    select tag, count(*) as covered, round(avg(z), 6) as mean_z, count(*) filter (where z > 0) as up, case when avg(abs(z)) > 3 then 'visible' else 'weak' end as verdict from x group by tag""")
def d16(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d)
    mid = rows.groupBy(*KEYS).agg(F.percentile("value", 0.5).alias("m"))
    mad = rows.join(mid, KEYS).groupBy(*KEYS, "m").agg(F.percentile(F.abs(F.col("value") - F.col("m")), 0.5).alias("mad"))
    z = rows.join(mad, KEYS).select("asset", "tag", F.col("t").alias("u"), ((F.col("value") - F.col("m")) / F.col("mad")).alias("z"))
    met = align.range_join(T.incidents(spark, d), z, ["asset"], 6 * HOUR, 0)
    per = met.groupBy("tag", "asset", "t").agg(F.max_by("z", F.struct(F.abs("z"), "u")).alias("z"))
    return per.groupBy("tag").agg(F.count("*").alias("covered"), r6(F.avg("z")).alias("mean_z"), F.count_if(F.col("z") > 0).alias("up"), F.when(F.avg(F.abs("z")) > 3, "visible").otherwise("weak").alias("verdict"))


@query("d17_sensor_inventory", f"""with {T.RUNNING}, {T.INCIDENTS}, x as (select i.asset, i.t, r."on" from incidents i asof left join running r on r.asset = i.asset and r.t <= i.t) select asset, count(*) as incidents, count(*) filter (where "on") as on_incidents, case when count(*) filter (where "on") >= 40 then 'target' when count(*) > 0 then 'context' else 'none' end as role from x group by asset""")
def d17(spark: SparkSession, d: str) -> DataFrame:
    x = align.asof(T.incidents(spark, d), T.running(spark, d), ["asset"], ["on"])
    return x.groupBy("asset").agg(F.count("*").alias("incidents"), F.count_if("on").alias("on_incidents"), F.when(F.count_if("on") >= 40, "target").when(F.count("*") > 0, "context").otherwise("none").alias("role"))


@query("d18_health_trend", f"""with {T.READINGS}, m as (select asset, tag, t // 86400000000 as day, quantile_cont(value, 0.5) as v from readings group by all) select asset, tag, round(regr_slope(v, day), 6) as slope, case when regr_slope(v, day) > 0.2 then 'rising' when regr_slope(v, day) < -0.2 then 'falling' else 'flat' end as label from m group by all""")
def d18(spark: SparkSession, d: str) -> DataFrame:
    m = T.readings(spark, d).groupBy("asset", "tag", F.floor(F.col("t") / DAY).alias("day")).agg(F.percentile("value", 0.5).alias("v"))
    s = F.regr_slope("v", "day")
    return m.groupBy("asset", "tag").agg(r6(s).alias("slope"), F.when(s > 0.2, "rising").when(s < -0.2, "falling").otherwise("flat").alias("label"))


@query("d19_event_clusters", f"""with {T.READINGS}, a as (select asset, tag, t from readings where value > 60), e as (select *, sum(case when t - p <= 3600000000 then 0 else 1 end) over (partition by asset order by t rows unbounded preceding) as c from (select *, lag(t) over (partition by asset order by t) as p from a))
    select asset, c as cluster, count(*) as n, count(distinct tag) as tags, array_to_string(list_sort(list_distinct(list(tag))), ',') as members from e group by all having count(distinct tag) > 1""")
def d19(spark: SparkSession, d: str) -> DataFrame:
    ep = episodes(T.readings(spark, d).where("value > 60"), ["asset"], HOUR, tags=F.count_distinct("tag"), members=F.array_join(F.array_sort(F.collect_set("tag")), ","))
    return ep.where("tags > 1").select("asset", F.col("episode").alias("cluster"), F.col("points").alias("n"), "tags", "members")


@query("d20_profile", f"""with {T.READINGS} select tag, count(*) as n, min(value) as low, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(quantile_cont(value, 0.99), 6) as p99, max(value) as top, round(avg(case when value < 1 then 1.0 else 0 end), 6) as sentinel_share from readings group by tag""")
def d20(spark: SparkSession, d: str) -> DataFrame:
    g = T.readings(spark, d).groupBy("tag")
    return g.agg(F.count("*").alias("n"), F.min("value").alias("low"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("sd"), r6(F.percentile("value", 0.99)).alias("p99"), F.max("value").alias("top"), r6(F.avg((F.col("value") < 1).cast("double"))).alias("sentinel_share"))


@query("d21_channel_combinations", f"""with {T.READINGS}, a as (select asset, t // 43200000000 as block, array_to_string(list_sort(list_distinct(list(tag))), ',') as combo from readings where value > 80 group by all) select combo, count(*) as n from a group by combo""")
def d21(spark: SparkSession, d: str) -> DataFrame:
    a = T.readings(spark, d).where("value > 80").groupBy("asset", F.floor(F.col("t") / (12 * HOUR)).alias("block")).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("combo"))
    return a.groupBy("combo").agg(F.count("*").alias("n"))


@query("d22_count_dispersion", f"""with {T.INCIDENTS}, span as (select unnest(generate_series((select min(t) // 86400000000 from incidents), (select max(t) // 86400000000 from incidents))) as day), c as (select asset, day, count(i.t) as n from (select distinct asset from incidents) cross join span left join (select asset, t, t // 86400000000 as day from incidents) i using (asset, day) group by all)
    select asset, sum(n)::bigint as total, round(var_samp(n) / avg(n), 6) as dispersion from c group by asset""")
def d22(spark: SparkSession, d: str) -> DataFrame:
    i = T.incidents(spark, d).withColumn("day", F.floor(F.col("t") / DAY))
    span = i.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = i.select("asset").distinct().crossJoin(F.broadcast(span)).select("asset", F.explode(F.sequence("a", "b")).alias("day"))
    n = days.join(i.groupBy("asset", "day").agg(F.count("*").alias("n")), ["asset", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.groupBy("asset").agg(F.sum("n").alias("total"), r6(F.var_samp("n") / F.avg("n")).alias("dispersion"))


@query("d23_sibling_statistics", f"""with {T.BINS} select asset, t, round(quantile_cont(value, 0.5), 6) as mid, max(value) as top, min(value) as low, round(max(value) - min(value), 6) as spread from bins group by all""")
def d23(spark: SparkSession, d: str) -> DataFrame:
    g = T.bins(spark, d).groupBy("asset", "t")
    return g.agg(r6(F.percentile("value", 0.5)).alias("mid"), F.max("value").alias("top"), F.min("value").alias("low"), r6(F.max("value") - F.min("value")).alias("spread"))


_BACK = "over (partition by asset, tag order by t rows between 11 preceding and current row)"


@query("e01_rolling_shape", f"""with {T.READINGS} select asset, tag, t, round(sqrt(avg(value * value) {_BACK}), 6) as rms, round(coalesce(stddev_samp(value) {_BACK}, 0), 6) as std, round(coalesce(max(abs(value)) {_BACK} / nullif(sqrt(avg(value * value) {_BACK}), 0), 0), 6) as crest,
    round(coalesce(value - lag(value) over (partition by asset, tag order by t), 0), 6) as d1, round(case when count(*) {_BACK} >= 4 then coalesce(kurtosis(value) {_BACK}, 0) else 0 end, 4) as kurt from readings""")
def e01(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks.by_rows(T.readings(spark, d), KEYS, 12, lambda x, keys: rolling.shape_features(x, 12, keys))
    return rows.select("asset", "tag", "t", *(r6(c).alias(c) for c in ("rms", "std", "crest", "d1")), F.round("kurt", 4).alias("kurt"))


@query("e02_rolling_slope", f"""with {T.READINGS}, n as (select *, row_number() over (partition by asset, tag order by t) as k from readings) select asset, tag, t, round(case when count(*) {_BACK} = 12 then regr_slope(value, k) {_BACK} else 0 end, 6) as slope from n""")
def e02(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d).withColumn("k", F.row_number().over(W()))
    return rows.select("asset", "tag", "t", r6(rolling.slope("value", "k", 12)).alias("slope"))


@query("e03_covered_slope", f"""with {T.GRID}, n as (select *, row_number() over (partition by asset, tag order by t) as k from grid) select asset, tag, t, round(case when count(value) over w >= 0.5 * 24 then regr_slope(value, k) over w else 0 end, 6) as slope from n window w as (partition by asset, tag order by t rows between 23 preceding and current row)""")
def e03(spark: SparkSession, d: str) -> DataFrame:
    rows = T.grid(spark, d).withColumn("k", F.row_number().over(W()))
    return rows.select("asset", "tag", "t", r6(rolling.slope("value", "k", 24, coverage=0.5)).alias("slope"))


@query("e04_long_baseline", f"""with {T.READINGS} select asset, tag, t, round(value - avg(value) over (partition by asset, tag order by t range between 86400000000 preceding and current row), 6) as dev from readings""")
def e04(spark: SparkSession, d: str) -> DataFrame:
    rows = rolling.means(T.readings(spark, d), KEYS, DAY, {"m": F.col("value")}, 3 * DAY)
    return rows.select("asset", "tag", "t", r6(F.col("value") - F.col("m")).alias("dev"))


@query("e05_context_residual", f"""with {T.BINS}, x as (select a.asset, a.t, a.value as x, c.value as ctx from bins a join bins c using (asset, t) where a.tag = 'click' and c.tag = 'view') select asset, t, round(case when ctx <> 0 then x / ctx else 0 end, 6) as ratio, round(x - ctx / avg(ctx) over (partition by asset) * avg(x) over (partition by asset), 6) as residual from x""")
def e05(spark: SparkSession, d: str) -> DataFrame:
    wide = align.aligned(T.bins(spark, d).where("tag in ('view', 'click')"), ["asset", "t"], ["view", "click"])
    a = Window.partitionBy("asset")
    return wide.select("asset", "t", r6(C.safe_divide(F.col("click"), F.col("view"))).alias("ratio"), r6(F.col("click") - F.col("view") / F.avg("view").over(a) * F.avg("click").over(a)).alias("residual"))


@query("e06_spectral_bands", f"""with {T.READINGS}, n as (select *, row_number() over w as k, list(value) over (partition by asset, tag order by t rows between 15 preceding and current row) as x from readings window w as (partition by asset, tag order by t)), s as (select asset, tag, t, x from n where k >= 16 and (k - 16) % 8 = 0),
    e as (select *, list_transform(range(0, 9), lambda k: power(list_sum(list_transform(range(0, 16), lambda i: x[i + 1] * cos(2 * pi() * k * i / 16))), 2) + power(list_sum(list_transform(range(0, 16), lambda i: x[i + 1] * sin(2 * pi() * k * i / 16))), 2)) as p from s)
    select asset, tag, t, round(list_sum(p[1:3]), 3) as low, round(list_sum(p[4:6]), 3) as mid, round(list_sum(p[7:9]), 3) as high, list_position(p[2:9], list_max(p[2:9])) as dominant from e""")
def e06(spark: SparkSession, d: str) -> DataFrame:
    out = rolling.spectral_bands(T.readings(spark, d), 16, 8)
    return out.select("asset", "tag", "t", *(F.round(c, 3).alias(c) for c in ("low", "mid", "high")), "dominant")


@query("e07_multiscale", f"""with {T.READINGS} select asset, tag, t, round(case when count(*) over a >= 4 then stddev_samp(value) over a end, 6) as s12, round(case when count(*) over b >= 16 then stddev_samp(value) over b end, 6) as s48, round(value - lag(value, 12) over o, 6) as d12 from readings
    window o as (partition by asset, tag order by t), a as (partition by asset, tag order by t rows between 11 preceding and current row), b as (partition by asset, tag order by t rows between 47 preceding and current row)""")
def e07(spark: SparkSession, d: str) -> DataFrame:
    std = lambda n: r6(F.when(F.count("value").over(rolling.back(n)) >= n // 3, F.stddev_samp("value").over(rolling.back(n))))
    return T.readings(spark, d).select("asset", "tag", "t", std(12).alias("s12"), std(48).alias("s48"), r6(F.col("value") - F.lag("value", 12).over(W())).alias("d12"))


@query("e09_central_gradient", f"""with {T.READINGS} select asset, tag, t, round(case when lag(value) over w is null then lead(value) over w - value when lead(value) over w is null then value - lag(value) over w else (lead(value) over w - lag(value) over w) / 2 end, 6) as g from readings window w as (partition by asset, tag order by t)""")
def e09(spark: SparkSession, d: str) -> DataFrame:
    a, b, v = F.lag("value").over(W()), F.lead("value").over(W()), F.col("value")
    return T.readings(spark, d).select("asset", "tag", "t", r6(F.coalesce((b - a) / 2, b - v, v - a)).alias("g"))


@query("e10_rolling_percentile_threshold", f"""with {T.READINGS}, g as (select asset, tag, quantile_cont(value, 0.9) as g from readings group by all), x as (select *, count(*) over w as n, quantile_cont(value, 0.9) over w as q from readings window w as (partition by asset, tag order by t range between 432000000000 preceding and 1 preceding))
    select asset, tag, t, round(case when n >= 30 then q else g end, 6) as thr from x join g using (asset, tag)""")
def e10(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d)
    overall = rows.groupBy(*KEYS).agg(F.percentile("value", 0.9).alias("g"))
    wide = rolling.order_statistics(rows, KEYS, 5 * DAY, -1, 10 * DAY, 0.9)
    return wide.join(overall, KEYS).select("asset", "tag", "t", r6(F.when(F.col("n") >= 30, F.col("quantile")).otherwise(F.col("g"))).alias("thr"))


@query("e11_rolling_rank", f"""with {T.READINGS} select a.asset, a.tag, a.t, round((2 * count(*) filter (where b.value < a.value) + count(*) filter (where b.value = a.value) + 1) / (2.0 * count(*)), 6) as rank_pct from readings a join readings b on b.asset = a.asset and b.tag = a.tag and b.t <= a.t and b.t > a.t - 432000000000 group by all""")
def e11(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rolling_rank(T.readings(spark, d), KEYS, 5 * DAY).withColumn("rank_pct", r6("rank_pct"))


@query("e12_rank_percent", f"""with {T.READINGS} select asset, tag, t, round((2 * rank() over (partition by asset, tag order by value) + count(*) over (partition by asset, tag, value) - 1) / (2.0 * count(*) over (partition by asset, tag)), 6) as rank_pct from readings""")
def e12(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rank_percent(T.readings(spark, d), KEYS).select("asset", "tag", "t", r6("rank_pct").alias("rank_pct"))


@query("e13_relative_baseline", f"""with {T.READINGS}, q as (select *, quantile_cont(value, 0.5) over w as m, (quantile_cont(value, 0.75) over w - quantile_cont(value, 0.25) over w) / 1.349 as s, count(*) over w as n from readings window w as (partition by asset, tag order by t rows between 60 preceding and 1 preceding)) select asset, tag, t, round(case when n >= 3 and s <> 0 then (value - m) / s end, 6) as z from q""")
def e13(spark: SparkSession, d: str) -> DataFrame:
    return T.readings(spark, d).select("asset", "tag", "t", r6(rolling.robust_z("value", W().rowsBetween(-60, -1))).alias("z"))


@query("e14_common_mode_z", f"""with {T.BINS}, g as (select asset, t, avg(value) as m from bins group by all), q as (select *, quantile_cont(m, 0.5) over w as md, (quantile_cont(m, 0.75) over w - quantile_cont(m, 0.25) over w) / 1.349 as s, count(*) over w as n from g window w as (partition by asset order by t rows between 48 preceding and 1 preceding)) select asset, t, round(case when n >= 3 and s <> 0 then (m - md) / s end, 6) as z from q""")
def e14(spark: SparkSession, d: str) -> DataFrame:
    g = T.bins(spark, d).groupBy("asset", "t").agg(F.avg("value").alias("m"))
    return g.select("asset", "t", r6(rolling.robust_z("m", Window.partitionBy("asset").orderBy("t").rowsBetween(-48, -1))).alias("z"))


@query("e15_class_spread", f"""with {T.BINS}, c as (select *, abs(value - quantile_cont(value, 0.5) over (partition by asset, t)) as dev from bins), z as (select *, quantile_cont(dev, 0.5) over (partition by asset, tag order by t rows between 48 preceding and 1 preceding) as mad from c) select asset, t, round(max(dev / nullif(mad, 0)), 6) as z from z group by all""")
def e15(spark: SparkSession, d: str) -> DataFrame:
    rows = T.bins(spark, d).withColumn("dev", F.abs(F.col("value") - F.percentile("value", 0.5).over(Window.partitionBy("asset", "t"))))
    mad = F.percentile("dev", 0.5).over(W().rowsBetween(-48, -1))
    return rows.withColumn("z", F.when(mad != 0, F.col("dev") / mad)).groupBy("asset", "t").agg(r6(F.max("z")).alias("z"))


@query("e16_load_stratified_z", f"""with {T.BINS}, x as (select b.asset, b.tag, b.t, b.value, case when v.value < 20 then 0 when v.value < 50 then 1 else 2 end as band from bins b join bins v on v.asset = b.asset and v.t = b.t and v.tag = 'view' where b.tag <> 'view'),
    q as (select *, quantile_cont(value, 0.5) over w as m, (quantile_cont(value, 0.75) over w - quantile_cont(value, 0.25) over w) / 1.349 as s, count(*) over w as n from x window w as (partition by asset, tag, band order by t rows between 40 preceding and 4 preceding)) select asset, tag, t, band, round(case when n >= 5 and s <> 0 then (value - m) / s end, 6) as z from q""")
def e16(spark: SparkSession, d: str) -> DataFrame:
    b = T.bins(spark, d)
    load = b.where("tag = 'view'").select("asset", "t", F.when(F.col("value") < 20, 0).when(F.col("value") < 50, 1).otherwise(2).alias("band"))
    w = Window.partitionBy("asset", "tag", "band").orderBy("t").rowsBetween(-40, -4)
    return b.where("tag <> 'view'").join(load, ["asset", "t"]).select("asset", "tag", "t", "band", r6(rolling.robust_z("value", w, 5)).alias("z"))


@query("e17_runs", f"""with {_RUNS} select asset, run, any_value("on") as "on", min(t) as start, max(t) as "end", count(*) as rows from rr group by all""")
def e17(spark: SparkSession, d: str) -> DataFrame:
    g = runs(T.running(spark, d), ["asset"], "on").groupBy("asset", "run")
    return g.agg(F.any_value("on").alias("on"), F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("rows"))


@query("e19_campaign_reference", f"""with {T.RUNNING}, s as (select *, case when "on" and not coalesce(lag("on") over (partition by asset order by t), false) then 1 else 0 end as st from running), c as (select *, sum(st) over (partition by asset order by t rows unbounded preceding) as campaign from s),
    x as (select c.asset, campaign, b.value, row_number() over (partition by c.asset, campaign order by c.t) as k from c join bins b on b.asset = c.asset and b.t = c.t and b.tag = 'click' where "on") select asset, campaign, count(*) as n, round(quantile_cont(value, 0.5) filter (where k <= 3), 6) as reference from x group by all""")
def e19(spark: SparkSession, d: str) -> DataFrame:
    s = clean.starts(T.running(spark, d), ["asset"])
    s = s.withColumn("campaign", F.sum(F.col("start").cast("int")).over(Window.partitionBy("asset").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    rows = s.where("on").join(T.bins(spark, d).where("tag = 'click'").drop("tag"), ["asset", "t"])
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("asset", "campaign").orderBy("t")))
    return rows.groupBy("asset", "campaign").agg(F.count("*").alias("n"), r6(F.percentile(F.when(F.col("k") <= 3, F.col("value")), 0.5)).alias("reference"))


@query("e20_blackout_after_start", f"""with {T.RUNNING}, s as (select *, case when "on" and not coalesce(lag("on") over (partition by asset order by t), false) then 1 else 0 end as st from running) select asset, t, "on" and max(st) over (partition by asset order by t rows between 5 preceding and current row) = 0 as watched from s""")
def e20(spark: SparkSession, d: str) -> DataFrame:
    s = clean.starts(T.running(spark, d), ["asset"])
    recent = F.max(F.col("start").cast("int")).over(Window.partitionBy("asset").orderBy("t").rowsBetween(-5, 0))
    return s.select("asset", "t", (F.col("on") & (recent == 0)).alias("watched"))


@query("e22_rolling_pair_correlation", f"""with {T.BINS}, x as (select a.asset, a.t, a.value as x, c.value as y from bins a join bins c using (asset, t) where a.tag = 'click' and c.tag = 'view') select asset, t, round(case when count(*) over w >= 12 then corr(x, y) over w end, 6) as r, round(sqrt(x * x + y * y), 6) as magnitude, round(atan2(y, x), 6) as angle, round(ln(x / y), 6) as log_ratio from x window w as (partition by asset order by t rows between 23 preceding and current row)""")
def e22(spark: SparkSession, d: str) -> DataFrame:
    wide = align.aligned(T.bins(spark, d).where("tag in ('view', 'click')"), ["asset", "t"], ["view", "click"])
    w, x, y = Window.partitionBy("asset").orderBy("t").rowsBetween(-23, 0), F.col("click"), F.col("view")
    return wide.select("asset", "t", r6(F.when(F.count("*").over(w) >= 12, F.corr(x, y).over(w))).alias("r"), r6(F.sqrt(x * x + y * y)).alias("magnitude"), r6(F.atan2(y, x)).alias("angle"), r6(F.log(x / y)).alias("log_ratio"))


@query("e24_volatility_index", f"""with {T.READINGS}, s as (select *, stddev_samp(value) {_BACK} as sd from readings) select asset, t // 86400000000 as day, round(avg(sd), 6) as volatility from s group by all""")
def e24(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d).withColumn("sd", F.stddev_samp("value").over(rolling.back(12)))
    return rows.groupBy("asset", F.floor(F.col("t") / DAY).alias("day")).agg(r6(F.avg("sd")).alias("volatility"))


@query("e25_forward_running_fraction", f"""with {T.RUNNING} select asset, t, round(avg(case when "on" then 1.0 else 0 end) over (partition by asset order by t rows between current row and 5 following), 6) as ahead from running""")
def e25(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("asset").orderBy("t").rowsBetween(0, 5)
    return T.running(spark, d).select("asset", "t", r6(F.avg(F.col("on").cast("double")).over(w)).alias("ahead"))


@query("e28_guarded_causal_z", f"""with {T.READINGS}, m as (select *, quantile_cont(value, 0.5) over w as m from readings window w as (partition by asset, tag order by t rows between 44 preceding and 5 preceding)), q as (select *, quantile_cont(abs(value - m), 0.5) over (partition by asset, tag order by t rows between 44 preceding and 5 preceding) as mad from m) select asset, tag, t, round((value - m) / nullif(1.4826 * mad, 0), 6) as z from q""")
def e28(spark: SparkSession, d: str) -> DataFrame:
    w = W().rowsBetween(-44, -5)
    rows = T.readings(spark, d).withColumn("m", F.percentile("value", 0.5).over(w))
    mad = 1.4826 * F.percentile(F.abs(F.col("value") - F.col("m")), 0.5).over(w)
    return rows.select("asset", "tag", "t", r6(F.when(mad != 0, (F.col("value") - F.col("m")) / mad)).alias("z"))


@query("f07_top_contributions", f"""with {T.READINGS} select asset, tag, t, value from readings order by value desc, t limit 25""")
def f07(spark: SparkSession, d: str) -> DataFrame:
    return T.readings(spark, d).orderBy(F.desc("value"), "t").limit(25).select("asset", "tag", "t", "value")


@query("f08_last_rows_before_cut", f"""with {T.READINGS}, w as (select unnest(generate_series(1, 4)) * 604800000000 + 1704067200000000 as cut), x as (select cut, asset, tag, value, row_number() over (partition by cut, asset, tag order by t desc) as k from readings join w on t < cut and t >= cut - 1209600000000) select cut, asset, tag, count(*) as n, round(quantile_cont(value, 0.5), 6) as mid from x where k <= 40 group by all""")
def f08(spark: SparkSession, d: str) -> DataFrame:
    week, first = 7 * DAY, 1_704_067_200_000_000
    rows = T.readings(spark, d).withColumn("cut", F.explode(F.expr(f"array(floor((t - {first}) / {week}) + 1, floor((t - {first}) / {week}) + 2)"))).where("cut between 1 and 4").withColumn("cut", F.col("cut") * week + first)
    k = F.row_number().over(Window.partitionBy("cut", "asset", "tag").orderBy(F.desc("t")))
    return rows.withColumn("k", k).where("k <= 40").groupBy("cut", "asset", "tag").agg(F.count("*").alias("n"), r6(F.percentile("value", 0.5)).alias("mid"))


@query("g02_index_union_intersection", f"""with {T.BINS}, c as (select asset, t from bins where tag = 'click'), v as (select asset, t from bins where tag = 'view') select 'union' as kind, asset, count(*) as n from (select * from c union select * from v) group by asset union all select 'both', asset, count(*) from (select * from c intersect select * from v) group by asset union all select 'lost', asset, count(*) from (select * from c except select * from v) group by asset""")
def g02(spark: SparkSession, d: str) -> DataFrame:
    b = T.bins(spark, d)
    c, v = (b.where(F.col("tag") == x).select("asset", "t") for x in ("click", "view"))
    out = [x.groupBy("asset").agg(F.count("*").alias("n")).withColumn("kind", F.lit(k)) for k, x in (("union", c.union(v).distinct()), ("both", c.intersect(v)), ("lost", c.exceptAll(v).distinct()))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("g03_or_and_confirmed", f"""with {T.READINGS}, a as (select asset, t, tag from readings where value > 60 and tag in ('click', 'view')) select x.asset, x.t, exists (select 1 from a y where y.asset = x.asset and y.tag = 'view' and y.t between x.t - 7200000000 and x.t + 7200000000) as confirmed from a x where x.tag = 'click'""")
def g03(spark: SparkSession, d: str) -> DataFrame:
    a = T.readings(spark, d).where("value > 60")
    found = clean.near_events(a.where("tag = 'click'").select("asset", "t"), a.where("tag = 'view'").select("asset", "t"), ["asset"], 2 * HOUR, 2 * HOUR, "confirmed")
    return found


@query("h01_text_functions", """select event_id, upper(event_type) as up, regexp_extract(props, '([0-9]+)', 1) as k, starts_with(event_type, 'c') as c, translate(event_type || 'áéçÕ', 'áéçÕ', 'aecO') as folded from events""")
def h01(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    return e.select("event_id", F.upper("event_type").alias("up"), F.regexp_extract("props", "([0-9]+)", 1).alias("k"), F.startswith("event_type", F.lit("c")).alias("c"), C.fold_accents(F.concat("event_type", F.lit("áéçÕ"))).alias("folded"))


@query("h05_margin_used", f"""with {T.READINGS}, p as (select asset, tag, quantile_cont(value, 0.5) as typical from readings group by all) select asset, t, round(max(greatest(0, (value - typical) / (case when tag = 'error' then 150 else 100 end - typical))), 6) as margin from readings join p using (asset, tag) where tag in ('error', 'click') group by all""")
def h05(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d).where("tag in ('error', 'click')")
    typical = rows.groupBy(*KEYS).agg(F.percentile("value", 0.5).alias("typical"))
    rows = rows.join(typical, KEYS).withColumn("hh", F.when(F.col("tag") == "error", 150.0)).withColumn("h", F.lit(100.0))
    return rows.groupBy("asset", "t").agg(r6(F.max(C.margin_used(F.col("value"), F.col("typical"), F.col("h"), F.col("hh")))).alias("margin"))


@query("h08_json_fields", """select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events""")
def h08(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").select("event_id", F.from_json("props", "map<string,bigint>")["k"].alias("k"))
