"""Queries: sources, time, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantwatch.functions import columns as C
from plantwatch.functions.columns import HOUR
from plantwatch.operators import blocks, clean
from plantwatch.operators.align import aligned, leave_one_out
from plantwatch.operators.blocks import rolling
from plantwatch.plans import tables as T
from plantwatch.plans.registry import query

r6 = lambda c: F.round(c, 6)


@query("a09_tag_discovery", f"""with {T.READINGS}, {T.ALARMS} select tag, count(*) as n, cast(min(t) as bigint) as first_t, cast(max(t) as bigint) as last_t
    from readings where regexp_matches(tag, '^[a-z]') and tag not in ('signup') group by tag""")
def a09(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d).where(F.col("tag").rlike("^[a-z]") & ~F.col("tag").isin("signup"))
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("a16_long_to_wide", f"""with {T.BINS} select asset, t, max(value) filter (where tag = 'click') as click, max(value) filter (where tag = 'view') as "view",
    max(value) filter (where tag = 'error') as error from bins group by asset, t having count(distinct tag) filter (where tag in ('click', 'view', 'error')) > 0""")
def a16(spark: SparkSession, d: str) -> DataFrame:
    rows = T.bins(spark, d).where("tag in ('click', 'view', 'error')")
    return aligned(rows, ["asset", "t"], ["click", "view", "error"], whole=False)


@query("a15_expanded_alarm_log", f"""with {T.INCIDENTS} select asset, t, x.tag, case when t % 2 = 0 then 'HIHI' else 'HI' end as condition from incidents, (values ('T0'), ('T1'), ('T2')) x(tag)""")
def a15(spark: SparkSession, d: str) -> DataFrame:
    tags = spark.createDataFrame([("T0",), ("T1",), ("T2",)], "tag string")
    condition = F.when(F.col("t") % 2 == 0, "HIHI").otherwise("HI").alias("condition")
    return T.incidents(spark, d).crossJoin(F.broadcast(tags)).select("asset", "t", "tag", condition)


@query("b01_mixed_time_formats", """with x as (select event_id, case when event_id % 3 = 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') when event_id % 3 = 1 then strftime(ts, '%d/%m/%Y %H:%M:%S') else 'no data' end as s from events)
    select event_id, case when event_id % 3 < 2 then cast(epoch_us(date_trunc('second', ts)) as bigint) end as t from events""")
def b01(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).otherwise("no data")
    rows = e.select("event_id", text.alias("s"))
    slashed = F.col("s").rlike(r"^\d{1,2}/\d{1,2}/\d{4}")
    day = rows.where(slashed).agg((F.avg((F.split("s", "/")[0].cast("int") > 12).cast("int")) > 0).alias("day_first"))
    return rows.crossJoin(F.broadcast(day)).select("event_id", C.micros(C.parse_time(F.col("s"), F.col("day_first"))).alias("t"))


@query("b02_zone_shift", "select event_id, cast(epoch_us(ts) + 10800000000 as bigint) as t from events")
def b02(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    return e.select("event_id", C.micros(C.to_utc(F.col("ts").cast("timestamp"), "America/Sao_Paulo")).alias("t"))


@query("b04_time_integrity", f"""with {T.READINGS} select asset, tag, count(*) as n, count(*) - count(distinct t) as duplicates, min(t) as first_t, max(t) as last_t from readings group by all""")
def b04(spark: SparkSession, d: str) -> DataFrame:
    g = T.readings(spark, d).groupBy("asset", "tag")
    return g.agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("t")).alias("duplicates"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("b06_numeric_coercion", """select event_id, case when event_id % 7 = 0 then null else value end as value from events""")
def b06(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_id") % 7 == 0, "No Data").otherwise(F.col("value").cast("string"))
    return T.table(spark, d, "events").select("event_id", C.number(text).alias("value"))


@query("b08_first_row_per_time", f"""select asset, tag, t, value from (select user_id % 8 as asset, event_type as tag, epoch_us(ts) // 86400000000 * 86400000000 as t, value,
    row_number() over (partition by user_id % 8, event_type, epoch_us(ts) // 86400000000 order by event_id) as k from events) where k = 1""")
def b08(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select((F.col("user_id") % 8).alias("asset"), F.col("event_type").alias("tag"), C.floor_to(C.micros(F.col("ts")), C.DAY).alias("t"), "value", "event_id")
    return clean.first_by_time(e, order="event_id").drop("event_id")


@query("b09_family_limits", f"""with {T.READINGS}, l(tag, low, high) as (values ('click', 5.0, 200.0), ('view', 0.0, 100.0), ('error', 10.0, 300.0))
    select asset, tag, t, case when low is null or value between low and high then value end as value from readings left join l using (tag)""")
def b09(spark: SparkSession, d: str) -> DataFrame:
    limits = spark.createDataFrame([("click", 5.0, 200.0), ("view", 0.0, 100.0), ("error", 10.0, 300.0)], "tag string, low double, high double")
    return clean.mask_by_limits(T.readings(spark, d), F.broadcast(limits)).select("asset", "tag", "t", "value")


@query("b10_sentinel_mask", f"""with {T.READINGS} select tag, count(*) as n, count(*) filter (where not value between 2 and 250) as masked, round(avg(value) filter (where value between 2 and 250), 6) as mean from readings group by tag""")
def b10(spark: SparkSession, d: str) -> DataFrame:
    rows = clean.mask_range(T.readings(spark, d), 2.0, 250.0)
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.count_if("masked").alias("masked"), r6(F.avg("value")).alias("mean"))


@query("b11_fabricated_gaps", f"""with {T.READINGS}, d as (select *, abs(value - 2 * lag(value) over w + lag(value, 2) over w) as d2 from readings window w as (partition by asset, tag order by t)),
    m as (select asset, tag, quantile_cont(d2, 0.5) as md from d group by all), f as (select d.*, coalesce(d2 < 0.5 * md, false) as flat from d join m using (asset, tag)),
    g as (select *, sum(case when flat is distinct from p then 1 else 0 end) over (partition by asset, tag order by t rows unbounded preceding) as run from (select *, lag(flat) over (partition by asset, tag order by t) as p from f))
    select asset, tag, t, flat and count(*) over (partition by asset, tag, run) >= 3 as fabricated from g""")
def b11(spark: SparkSession, d: str) -> DataFrame:
    return clean.fabricated(T.readings(spark, d), 3, 0.5).select("asset", "tag", "t", "fabricated")


@query("b12_long_gaps", f"""with {T.GRID}, g as (select *, sum(case when n is distinct from p then 1 else 0 end) over (partition by asset, tag order by t rows unbounded preceding) as run
    from (select *, value is null as n, lag(value is null) over (partition by asset, tag order by t) as p from grid))
    select asset, tag, t, n and count(*) over (partition by asset, tag, run) > 3 as long_gap from g""")
def b12(spark: SparkSession, d: str) -> DataFrame:
    return clean.long_gaps(T.grid(spark, d), 3).select("asset", "tag", "t", "long_gap")


@query("b13_limited_interpolation", f"""with {T.GRID}, n as (select *, row_number() over (partition by asset, tag order by t) as k from grid),
    s as (select *, max(case when value is not null then k end) over (partition by asset, tag order by k rows unbounded preceding) as a,
        min(case when value is not null then k end) over (partition by asset, tag order by k rows between current row and unbounded following) as b from n)
    select s.asset, s.tag, s.t, round(case when s.value is not null then s.value when least(s.k - a, b - s.k) <= 2 then x.value + (y.value - x.value) * (s.k - a) / (b - a) end, 6) as filled
    from s left join n x on x.asset = s.asset and x.tag = s.tag and x.k = a left join n y on y.asset = s.asset and y.tag = s.tag and y.k = b""")
def b13(spark: SparkSession, d: str) -> DataFrame:
    return clean.interpolate(T.grid(spark, d), 2).select("asset", "tag", "t", r6("filled").alias("filled"))


@query("b15_common_mode", f"""with {T.BINS} select asset, tag, t, round(case when n > 2 then value - (s - value) / (n - 1) end, 6) as residual
    from (select *, sum(value) over w as s, count(value) over w as n from bins window w as (partition by asset, t))""")
def b15(spark: SparkSession, d: str) -> DataFrame:
    return leave_one_out(T.bins(spark, d), ["asset", "t"], 2).select("asset", "tag", "t", r6("residual").alias("residual"))


@query("b16_zero_filled_residual", f"""with {T.BINS}, m as (select asset, tag, t, case when value between 5 and 100 then value end as value from bins)
    select asset, tag, t, round(coalesce(case when n > 3 then value - (s - value) / (n - 1) end, 0), 6) as residual from (select *, sum(value) over w as s, count(value) over w as n from m window w as (partition by asset, t))""")
def b16(spark: SparkSession, d: str) -> DataFrame:
    rows = clean.mask_range(T.bins(spark, d), 5.0, 100.0)
    return leave_one_out(rows, ["asset", "t"], 3, otherwise=F.lit(0.0)).select("asset", "tag", "t", r6("residual").alias("residual"))


_ROUNDED = "select asset, tag, t, floor(value / 25) as value from bins"


@query("b17_constant_runs", f"""with {T.BINS}, v as ({_ROUNDED}), g as (select *, sum(case when value = p then 0 else 1 end) over (partition by asset, tag order by t rows unbounded preceding) as run
    from (select *, lag(value) over (partition by asset, tag order by t) as p from v)) select asset, tag, t, count(*) over (partition by asset, tag, run) >= 3 as constant from g""")
def b17(spark: SparkSession, d: str) -> DataFrame:
    rows = T.bins(spark, d).withColumn("value", F.floor(F.col("value") / 25).cast("double"))
    return clean.constant_runs(rows, 3).select("asset", "tag", "t", "constant")


@query("b18_any_sensor_flag", f"""with {T.BINS}, v as ({_ROUNDED}), g as (select *, sum(case when value = p then 0 else 1 end) over (partition by asset, tag order by t rows unbounded preceding) as run
    from (select *, lag(value) over (partition by asset, tag order by t) as p from v)), c as (select asset, t, count(*) over (partition by asset, tag, run) >= 3 as constant from g) select asset, t, bool_or(constant) as any_constant from c group by all""")
def b18(spark: SparkSession, d: str) -> DataFrame:
    rows = T.bins(spark, d).withColumn("value", F.floor(F.col("value") / 25).cast("double"))
    return clean.constant_runs(rows, 3).groupBy("asset", "t").agg(F.bool_or("constant").alias("any_constant"))


@query("b19_hampel", f"""with {T.READINGS}, m as (select *, quantile_cont(value, 0.5) over w as m from readings window w as (partition by asset, tag order by t rows between 2 preceding and 2 following)),
    x as (select *, abs(value - m) as dev, quantile_cont(abs(value - m), 0.5) over (partition by asset, tag order by t rows between 2 preceding and 2 following) as mad from m)
    select asset, tag, t, round(case when dev > 3 * 1.4826 * mad then m else value end, 6) as cleaned from x""")
def b19(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks.by_rows(T.readings(spark, d), ("asset", "tag"), 4, lambda x, keys: clean.hampel(x, 2, keys=keys), ahead=4)
    return rows.select("asset", "tag", "t", r6("cleaned").alias("cleaned"))


@query("b20_clip_mad", f"""with {T.READINGS}, m as (select asset, tag, quantile_cont(value, 0.5) as m from readings group by all),
    b as (select asset, tag, m, quantile_cont(abs(value - m), 0.5) as mad from readings join m using (asset, tag) group by all)
    select asset, tag, t, round(greatest(least(value, m + 3 * mad), m - 3 * mad), 6) as value from readings join b using (asset, tag)""")
def b20(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d)
    return clean.clip(rows, clean.clip_bounds(rows, "mad", k=3.0)).select("asset", "tag", "t", r6("value").alias("value"))


_CUT = 1_705_276_800_000_000  # 2024-01-15


@query("b21_clip_fit_apply", f"""with {T.READINGS}, b as (select asset, tag, quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi from readings where t < {_CUT} group by all)
    select asset, tag, t, round(coalesce(greatest(least(value, hi), lo), value), 6) as value from readings left join b using (asset, tag)""")
def b21(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d)
    bounds = clean.clip_bounds(rows.where(F.col("t") < _CUT))
    return clean.clip(rows, bounds).select("asset", "tag", "t", r6("value").alias("value"))


@query("b22_normalize_on_training_rows", f"""with {T.READINGS}, p as (select asset, tag, quantile_cont(value, 0.5) as c, coalesce(nullif(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 0), 1) as s from readings where t < {_CUT} group by all)
    select asset, tag, t, round((value - c) / s, 6) as z from readings join p using (asset, tag)""")
def b22(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d)
    return clean.normalize(rows, clean.scales(rows.where(F.col("t") < _CUT))).select("asset", "tag", "t", r6("z").alias("z"))


@query("b23_stable_gradient", f"""with {T.READINGS}, d as (select *, abs(value - lag(value) over (partition by asset, tag order by t)) as dv from readings), e as (select asset, tag, quantile_cont(dv, 0.6) as q from d group by all)
    select asset, tag, t, coalesce(dv <= q, false) as stable from d join e using (asset, tag)""")
def b23(spark: SparkSession, d: str) -> DataFrame:
    return clean.stable(T.readings(spark, d), 0.6).select("asset", "tag", "t", "stable")


@query("b24_alarm_exclusion", f"""with {T.READINGS}, {T.INCIDENTS} select asset, tag, t, exists (select 1 from incidents i where i.asset = r.asset and r.t between i.t - 7200000000 and i.t + 3600000000) as excluded from readings r""")
def b24(spark: SparkSession, d: str) -> DataFrame:
    found = clean.near_events(T.readings(spark, d), T.incidents(spark, d), ["asset"], 2 * HOUR, HOUR)
    return found.select("asset", "tag", "t", "excluded")


@query("b25_startup_exclusion", f"""with {T.RUNNING}, s as (select *, "on" and not coalesce(lag("on") over (partition by asset order by t), false) as start from running),
    k as (select *, max(case when start then t end) over (partition by asset order by t rows unbounded preceding) as last from s)
    select asset, t, coalesce(t - last <= 10800000000, false) as startup from k""")
def b25(spark: SparkSession, d: str) -> DataFrame:
    rows = clean.since_start(T.running(spark, d), ["asset"])
    return rows.select("asset", "t", F.coalesce(F.col("since") <= 3 * HOUR, F.lit(False)).alias("startup"))


@query("b26_gradient_spikes", f"""with {T.READINGS}, g as (select *, abs(value - lag(value) over (partition by asset, tag order by t)) as dv from readings), p as (select asset, tag, avg(dv) as mu, stddev_samp(dv) as sd, count(dv) as n from g group by all),
    s as (select g.*, coalesce(n >= 10 and sd > 0 and dv > mu + 2 * sd, false) as spike from g join p using (asset, tag))
    select asset, tag, t, bool_or(spike) over (partition by asset, tag order by t range between 1800000000 preceding and 1800000000 following) as suppressed from s""")
def b26(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d)
    rows = rows.withColumn("dv", F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("asset", "tag").orderBy("t"))))
    params = rows.groupBy("asset", "tag").agg(F.avg("dv").alias("mu"), F.stddev_samp("dv").alias("sd"), F.count("dv").alias("k"))
    spike = F.coalesce((F.col("k") >= 10) & (F.col("sd") > 0) & (F.col("dv") > F.col("mu") + 2 * F.col("sd")), F.lit(False))
    rows = rows.join(params, ["asset", "tag"]).withColumn("spike", spike)
    wide = rolling(rows, ["asset", "tag"], HOUR // 2, {"suppressed": lambda w: F.max("spike").over(w)}, ahead=HOUR // 2, block=24 * HOUR)
    return wide.select("asset", "tag", "t", "suppressed")


@query("b28_skip_rules", f"""with {T.READINGS} select asset, tag, count(*) as n, case when stddev_samp(value) < 5 then 'flat' when count(*) < 260 then 'short' else 'ok' end as reason from readings group by all""")
def b28(spark: SparkSession, d: str) -> DataFrame:
    g = T.readings(spark, d).groupBy("asset", "tag").agg(F.count("*").alias("n"), F.stddev_samp("value").alias("s"))
    return g.select("asset", "tag", "n", F.when(F.col("s") < 5, "flat").when(F.col("n") < 260, "short").otherwise("ok").alias("reason"))


@query("b29_condition_filter", f"""with {T.ALARMS} select asset, condition, count(*) as n from alarms where upper(condition) not in ('CFN') group by all""")
def b29(spark: SparkSession, d: str) -> DataFrame:
    return T.alarms(spark, d).where(~F.upper("condition").isin("CFN")).groupBy("asset", "condition").agg(F.count("*").alias("n"))


@query("b30_zones", f"""with {T.INCIDENTS}, {T.RUNNING}, k as (select *, max(case when "on" and not coalesce(p, false) then t end) over (partition by asset order by t rows unbounded preceding) as last
    from (select *, lag("on") over (partition by asset order by t) as p from running))
    select asset, t, case when not "on" then 'off' when exists (select 1 from incidents i where i.asset = k.asset and k.t between i.t - 7200000000 and i.t + 7200000000) then 'alarm'
        when t - last <= 10800000000 then 'startup' else 'normal' end as zone from k""")
def b30(spark: SparkSession, d: str) -> DataFrame:
    rows = clean.near_events(clean.since_start(T.running(spark, d), ["asset"]), T.incidents(spark, d), ["asset"], 2 * HOUR, 2 * HOUR)
    zone = F.when(~F.col("on"), "off").when(F.col("excluded"), "alarm").when(F.col("since") <= 3 * HOUR, "startup").otherwise("normal")
    return rows.select("asset", "t", zone.alias("zone"))


@query("b31_gradient_per_minute", f"""with {T.READINGS}, g as (select *, abs(value - lag(value) over w) / ((t - lag(t) over w) / 60000000.0) as g from readings window w as (partition by asset, tag order by t)), q as (select tag, quantile_cont(g, 0.999) as top from g group by tag)
    select tag, count(g) as n, round(avg(least(g, top)), 6) as mean, round(max(least(g, top)), 6) as top from g join q using (tag) where g is not null group by tag""")
def b31(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("asset", "tag").orderBy("t")
    rows = T.readings(spark, d).withColumn("g", F.abs(F.col("value") - F.lag("value").over(w)) / ((F.col("t") - F.lag("t").over(w)) / float(C.MINUTE)))
    top = rows.groupBy("tag").agg(F.percentile("g", 0.999).alias("q"))
    least = F.least("g", "q")
    rows = rows.join(F.broadcast(top), "tag").where("g is not null")
    return rows.groupBy("tag").agg(F.count("g").alias("n"), r6(F.avg(least)).alias("mean"), r6(F.max(least)).alias("top"))
