"""Queries: further rows of each family, most of them compositions of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantwatch.functions import columns as C
from plantwatch.functions.columns import DAY, HOUR
from plantwatch.operators import align, blocks, clean, evaluate, models, rolling, state
from plantwatch.plans import tables as T
from plantwatch.plans.q_clean import r6
from plantwatch.plans.q_eval import _ALERTS, _CURVE, _LABEL, _LOAD, alerts, curve, labelled, loaded
from plantwatch.plans.q_series import _EPISODES, KEYS, W, alert_episodes
from plantwatch.plans.q_state import _P, _Z, z_scores
from plantwatch.plans.registry import QUERIES, SQL, query

_TAIL = lambda x: x.removeprefix(T.READINGS + ", ")


@query("a02_wide_to_long", "select o_orderkey as asset, epoch_us(o_orderdate) as t, unnest(['price', 'customer']) as tag, unnest([o_totalprice, cast(o_custkey as double)]) as value from orders")
def a02(spark: SparkSession, d: str) -> DataFrame:
    from plantwatch.sources.sensors import to_long

    wide = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("asset"), C.micros(F.col("o_orderdate")).alias("t"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"))
    return to_long(wide, ["price", "customer"])


@query("a05_monthly_files_union", f"""with {T.READINGS} select asset, tag, t, value from readings""")
def a05(spark: SparkSession, d: str) -> DataFrame:
    from plantwatch.sources.sensors import consolidate

    rows, cut = T.readings(spark, d), 1_705_276_800_000_000
    late = rows.withColumn("t", F.col("t") - 3 * HOUR)  # an era whose clock is three hours behind
    return consolidate([(rows, 0, None, cut), (late, 3 * HOUR, cut, None)])


@query("a03_alarm_header_aliases", f"""with {T.ALARMS} select tag, condition, count(*) as n from alarms group by all""")
def a03(spark: SparkSession, d: str) -> DataFrame:
    from plantwatch.sources.sensors import alarm_log

    raw = T.alarms(spark, d).select(F.col("t").cast("string").alias("Data da Ocorrência"), F.col("tag").alias("Tag Alarme"), F.lower("condition").alias("Condição do Alarme"), F.col("status").alias("Status"))
    return alarm_log(raw).groupBy("tag", "condition").agg(F.count("*").alias("n"))


@query("b03_clock_offset", f"""with {T.INCIDENTS}, {T.RUNNING}, stops as (select asset, t from (select *, not "on" and lag("on") over (partition by asset order by t) as stop from running) where stop), o as (select unnest(generate_series(-3, 3)) as h)
    select h, count(*) filter (where exists (select 1 from incidents i where i.asset = s.asset and i.t + h * 3600000000 between s.t - 3600000000 and s.t + 1800000000)) as matched from stops s cross join o group by h""")
def b03(spark: SparkSession, d: str) -> DataFrame:
    r = T.running(spark, d)
    before = F.lag("on").over(Window.partitionBy("asset").orderBy("t"))
    stops = r.withColumn("p", before).where("not on and p").select("asset", "t")
    shift = T.incidents(spark, d).withColumn("h", F.explode(F.sequence(F.lit(-3), F.lit(3))))
    moved = shift.select("asset", "h", (F.col("t") + F.col("h") * HOUR).alias("u"))
    probe = stops.withColumn("h", F.explode(F.sequence(F.lit(-3), F.lit(3))))
    hit = align.range_join(probe, moved, ["asset", "h"], HOUR, HOUR // 2).select("h", "asset", "t").distinct().groupBy("h").agg(F.count("*").alias("m"))
    hours = probe.select("h").distinct()  # without stops no rows, as nothing is there to be matched
    return hours.join(hit, "h", "left").select("h", F.coalesce("m", F.lit(0).cast("long")).alias("matched"))


@query("b05_first_converted_times", "select event_id, epoch_us(ts) as before_t, epoch_us(ts) + 10800000000 as after_t from events order by event_id limit 20")
def b05(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").orderBy("event_id").limit(20)
    return e.select("event_id", C.micros(F.col("ts")).alias("before_t"), C.micros(C.to_utc(F.col("ts").cast("timestamp"), "America/Sao_Paulo")).alias("after_t"))


@query("b07_tag_names", r"""select p_partkey, regexp_replace(trim(p_brand), '[^A-Za-z0-9_]+', '_', 'g') as tag from part""")
def b07(spark: SparkSession, d: str) -> DataFrame:
    named = F.concat(F.lit("\\\\server\\"), F.col("p_brand"))
    return T.table(spark, d, "part").select("p_partkey", C.clean_tag(named).alias("tag"))


@query("b14_context_fill", f"""with {T.GRID} select asset, tag, t, coalesce(value, last_value(value ignore nulls) over ({_P}), 0) as filled from grid""")
def b14(spark: SparkSession, d: str) -> DataFrame:
    carried = F.last("value", ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, 0))
    return T.grid(spark, d).select(*KEYS, "t", F.coalesce("value", carried, F.lit(0.0)).alias("filled"))


@query("b27_training_range", f"""with {T.READINGS} select asset, tag, count(*) as n, round(avg(value), 6) as mean from readings where t >= 1704499200000000 and t < 1705276800000000 group by all""")
def b27(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d).where("t >= 1704499200000000 and t < 1705276800000000")
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query("d05_window_length", f"""with {T.READINGS}, x as (select asset, tag, quantile_cont(t - p, 0.5) as dt from (select *, lag(t) over ({_P}) as p from readings) where t > p group by all) select asset, tag, cast(round(28800000000 / dt) as bigint) as steps, abs(round(28800000000 / dt) * dt / 28800000000 - 1) <= 0.1 as ok from x""")
def d05(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d).withColumn("dt", F.col("t") - F.lag("t").over(W())).where("dt > 0")
    x = rows.groupBy(*KEYS).agg(F.percentile("dt", 0.5).alias("dt"))
    steps = F.round(8 * HOUR / F.col("dt"))
    return x.select(*KEYS, steps.cast("long").alias("steps"), (F.abs(steps * F.col("dt") / (8 * HOUR) - 1) <= 0.1).alias("ok"))


@query("d09_adaptive_period_threshold", f"""with {_LABEL}, w as (select asset, tag, t // 604800000000 as week, count(*) as n, quantile_cont(value, 0.95) as q from lab where not bad group by all), g as (select asset, tag, quantile_cont(value, 0.95) as g from lab where not bad group by all)
    select l.asset, l.tag, l.t, l.value > case when n >= 30 then q else g end as is_anom from lab l join g using (asset, tag) left join w on w.asset = l.asset and w.tag = l.tag and w.week = l.t // 604800000000""")
def d09(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).withColumn("week", F.floor(F.col("t") / (7 * DAY)))
    ok = rows.where("not bad")
    own = ok.groupBy(*KEYS, "week").agg(F.count("*").alias("n"), F.percentile("value", 0.95).alias("q"))
    overall = ok.groupBy(*KEYS).agg(F.percentile("value", 0.95).alias("g"))
    out = rows.join(overall, KEYS).join(own, [*KEYS, "week"], "left")
    return out.select(*KEYS, "t", (F.col("value") > F.when(F.col("n") >= 30, F.col("q")).otherwise(F.col("g"))).alias("is_anom"))


@query("d11_observed_duration", f"""with {T.READINGS}, x as (select asset, tag, count(*) as n, quantile_cont(t - p, 0.5) filter (where t > p) as dt from (select *, lag(t) over ({_P}) as p from readings) group by all) select asset, tag, round(n * dt / 86400000000.0, 6) as days from x""")
def d11(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d).withColumn("dt", F.col("t") - F.lag("t").over(W()))
    return rows.groupBy(*KEYS).agg(r6(F.count("*") * F.percentile("dt", 0.5) / float(DAY)).alias("days"))


@query("e08_centred_shape", f"""with {T.BINS}, c as (select *, value - quantile_cont(value, 0.5) over ({_P} rows between 23 preceding and current row) as x from bins) select asset, tag, t, round(avg(x) over w, 6) as mean, round(coalesce(stddev_samp(x) over w, 0), 6) as std, round(coalesce(max(abs(x)) over w / nullif(sqrt(avg(x * x) over w), 0), 0), 6) as crest from c window w as ({_P} rows between 11 preceding and current row)""")
def e08(spark: SparkSession, d: str) -> DataFrame:
    rows = T.bins(spark, d).withColumn("x", F.col("value") - F.percentile("value", 0.5).over(rolling.back(24)))
    out = rolling.shape_features(rows, 12, value="x").withColumn("mean", F.avg("x").over(rolling.back(12)))
    return out.select(*KEYS, "t", r6("mean").alias("mean"), r6("std").alias("std"), r6("crest").alias("crest"))


@query("e18_hours_since_start", f"""with {T.RUNNING}, s as (select *, "on" and not coalesce(lag("on") over (partition by asset order by t), false) as st from running) select asset, t, round((t - max(case when st then t end) over (partition by asset order by t rows unbounded preceding)) / 3600000000.0, 6) as hours from s""")
def e18(spark: SparkSession, d: str) -> DataFrame:
    return clean.since_start(T.running(spark, d), ["asset"]).select("asset", "t", r6(F.col("since") / float(HOUR)).alias("hours"))


@query("e21_expanding_daily_median", f"""with {T.READINGS}, d as (select asset, tag, t // 86400000000 as day, quantile_cont(value, 0.5) as m from readings group by all) select asset, tag, day, round(case when count(*) over w >= 7 then quantile_cont(m, 0.5) over w end, 6) as typical from d window w as (partition by asset, tag order by day rows between unbounded preceding and 1 preceding)""")
def e21(spark: SparkSession, d: str) -> DataFrame:
    days = T.readings(spark, d).groupBy(*KEYS, F.floor(F.col("t") / DAY).alias("day")).agg(F.percentile("value", 0.5).alias("m"))
    w = Window.partitionBy(*KEYS).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return days.select(*KEYS, "day", r6(F.when(F.count("*").over(w) >= 7, F.percentile("m", 0.5).over(w))).alias("typical"))


@query("e23_load_ramp", f"""with {T.BINS}, v as (select asset, t, last(value order by t) as v from (select asset, t // 21600000000 * 21600000000 as t, value from bins where tag = 'view') group by all), r as (select asset, t, abs(v - lag(v) over w) / ((t - lag(t) over w) / 3600000000.0) as ramp from v window w as (partition by asset order by t))
    select count(*) as n, count(ramp) as ramps from r""")
def e23(spark: SparkSession, d: str) -> DataFrame:
    v = T.bins(spark, d).where("tag = 'view'").groupBy("asset", C.floor_to(F.col("t"), 6 * HOUR).alias("b")).agg(F.max_by("value", "t").alias("v"))
    w = Window.partitionBy("asset").orderBy("b")
    r = v.withColumn("ramp", F.abs(F.col("v") - F.lag("v").over(w)) / ((F.col("b") - F.lag("b").over(w)) / float(HOUR)))
    return r.agg(F.count("*").alias("n"), F.count("ramp").alias("ramps"))


@query("e26_trend_channel", f"""with {T.BINS}, g as (select asset, t, avg(value) as m from bins group by all), d as (select *, m - lag(m, 24) over (partition by asset order by t) as ch from g), q as (select asset, quantile_cont(ch, 0.5) as c, quantile_cont(ch, 0.75) - quantile_cont(ch, 0.25) as s from d group by asset) select asset, t, round(abs(ch - c) / (s / 1.349), 6) as z from d join q using (asset) where ch is not null""")
def e26(spark: SparkSession, d: str) -> DataFrame:
    g = T.bins(spark, d).groupBy("asset", "t").agg(F.avg("value").alias("m"))
    g = g.withColumn("ch", F.col("m") - F.lag("m", 24).over(Window.partitionBy("asset").orderBy("t"))).where("ch is not null")
    q = clean.scales(g, keys=["asset"], value="ch")
    return g.join(q, "asset").select("asset", "t", r6(F.abs(F.col("ch") - F.col("center")) / (F.col("scale") / 1.349)).alias("z"))


@query("e27_delta_channel", f"""with {T.READINGS}, d as (select *, avg(value) over ({_P} rows between 5 preceding and current row) - quantile_cont(value, 0.5) over ({_P} rows between 30 preceding and 6 preceding) as dl from readings) select asset, tag, t, round(dl, 6) as delta from d""")
def e27(spark: SparkSession, d: str) -> DataFrame:
    delta = F.avg("value").over(W().rowsBetween(-5, 0)) - F.percentile("value", 0.5).over(W().rowsBetween(-30, -6))
    return T.readings(spark, d).select(*KEYS, "t", r6(delta).alias("delta"))


@query("e29_difference_channel", f"""with {T.BINS}, x as (select a.asset, a.t, a.value as x, c.value as y from bins a join bins c using (asset, t) where a.tag = 'click' and c.tag = 'view') select asset, t, round(case when x between 5 and 200 and y between 5 and 200 then x - y - 10 end, 6) as diff from x""")
def e29(spark: SparkSession, d: str) -> DataFrame:
    x = loaded(spark, d)
    ok = F.col("y").between(5, 200) & F.col("load").between(5, 200)
    return x.select("asset", "t", r6(F.when(ok, F.col("y") - F.col("load") - 10)).alias("diff"))


@query("f03_least_duty_that_keeps_recall", f"with {_CURVE} select y, round(recall, 6) as recall from curve order by (recall >= 0.5 * (select max(recall) from curve)) desc, false_per_day, y limit 1")
def f03(spark: SparkSession, d: str) -> DataFrame:
    c = curve(spark, d).withColumn("top", F.max("recall").over(Window.partitionBy(F.lit(1))))
    k = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc((F.col("recall") >= 0.5 * F.col("top")).cast("int")), "false_per_day", "y"))
    return c.withColumn("k", k).where("k = 1").select(F.col("y").cast("long").alias("y"), r6("recall").alias("recall"))


@query("f04_non_degenerate_point", f"with {_CURVE} select y from curve order by (false_per_day between 0.3 and 6 and episodes >= 100) desc, recall desc, y limit 1")
def f04(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("false_per_day").between(0.3, 6) & (F.col("episodes") >= 100)
    k = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(ok.cast("int")), F.desc("recall"), "y"))
    return curve(spark, d).withColumn("k", k).where("k = 1").select(F.col("y").cast("long").alias("y"))


@query("g04_lost_events", f"""with {_ALERTS} select i.asset, i.t from incidents i where not exists (select 1 from a where a.asset = i.asset and a.t between i.t - 28800000000 and i.t)""")
def g04(spark: SparkSession, d: str) -> DataFrame:
    a = alerts(spark, d).select("asset", F.col("t").alias("u"))
    return align.range_join(T.incidents(spark, d), a, ["asset"], 8 * HOUR, 0, "left_anti").select("asset", "t")


@query("h02_protection_level", """select event_id, case when event_type = 'error' then 'trip' when event_type = 'view' then 'very high' end as level from events""")
def h02(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "TRIP por vibração").when(F.col("event_type") == "view", "Temperatura MUITO ALTA").otherwise(F.col("event_type"))
    return T.table(spark, d, "events").select("event_id", C.protection_level(text).alias("level"))


@query("h03_date_functions", """select event_id, strftime(ts, '%Y-%m') as month, (epoch_us(ts) - 1704067200000000) // 21600000000 as block from events""")
def h03(spark: SparkSession, d: str) -> DataFrame:
    t = C.micros(F.col("ts"))
    return T.table(spark, d, "events").select("event_id", C.month_of(t).alias("month"), F.floor((t - 1_704_067_200_000_000) / (6 * HOUR)).alias("block"))


@query("h04_math_functions", """select event_id, round(sqrt(value), 6) as r, round(ln(value), 6) as l, sign(value - 30)::bigint as s, least(greatest(value, 5), 100) as c, floor(value / 25)::bigint as bin from events where value > 0""")
def h04(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return T.table(spark, d, "events").where("value > 0").select("event_id", r6(F.sqrt(v)).alias("r"), r6(F.log(v)).alias("l"), F.signum(v - 30).cast("long").alias("s"), F.least(F.greatest(v, F.lit(5.0)), F.lit(100.0)).alias("c"), F.floor(v / 25).alias("bin"))


@query("h06_channel_score_forms", f"""with {T.BINS}, x as (select asset, t, max(value) filter (where tag = 'click') as a, max(value) filter (where tag = 'view') as b, max(value) filter (where tag = 'error') as c from bins group by all having count(distinct tag) filter (where tag in ('click', 'view', 'error')) = 3)
    select asset, t, round(a + b + c, 6) as total, round(a * a + b * b + c * c, 4) as squares, round(sqrt(a) + sqrt(b) + sqrt(c), 6) as roots, round(sqrt((power(greatest(a - 50, 0), 2) + power(greatest(b - 50, 0), 2) + power(greatest(c - 50, 0), 2)) / 3), 6) as excess from x""")
def h06(spark: SparkSession, d: str) -> DataFrame:
    x = align.aligned(T.bins(spark, d).where("tag in ('click', 'view', 'error')"), ["asset", "t"], ["click", "view", "error"])
    v = [F.col(c) for c in ("click", "view", "error")]
    over = [F.greatest(c - 50, F.lit(0.0)) for c in v]
    return x.select("asset", "t", r6(v[0] + v[1] + v[2]).alias("total"), F.round(v[0] * v[0] + v[1] * v[1] + v[2] * v[2], 4).alias("squares"), r6(F.sqrt(v[0]) + F.sqrt(v[1]) + F.sqrt(v[2])).alias("roots"), r6(F.sqrt((over[0] * over[0] + over[1] * over[1] + over[2] * over[2]) / 3)).alias("excess"))


@query("i06_forgetting_cusum", f"""with {_Z} select a.asset, a.tag, a.t, round(sum(b.z * power(0.5, (a.k - b.k) / 10.0)), 6) as leaky from (select *, row_number() over ({_P}) as k from zs) a join (select *, row_number() over ({_P}) as k from zs) b on a.asset = b.asset and a.tag = b.tag and b.k <= a.k group by all""")
def i06(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks.row_numbers(z_scores(spark, d), KEYS, 10 * DAY)
    return blocks.decayed_sums(rows, KEYS, "n", 10.0, {"leaky": F.col("z")}).select(*KEYS, "t", r6("leaky").alias("leaky"))


@query("i10_two_regime_sustain", f"""with {_Z}, s as (select *, sum(case when z > 0 then 1 else 0 end) over ({_P} rows between 1 preceding and current row) = 2 as a, sum(case when z > 0 then 1 else 0 end) over ({_P} rows between 4 preceding and current row) = 5 as b from zs) select asset, tag, t, case when t % 86400000000 < 21600000000 then b else a end as on_rule from s""")
def i10(spark: SparkSession, d: str) -> DataFrame:
    up = F.col("z") > 0
    rule = F.when(F.col("t") % DAY < 6 * HOUR, state.sustained(up, 5)).otherwise(state.sustained(up, 2))
    return z_scores(spark, d).select(*KEYS, "t", rule.alias("on_rule"))


@query("i25_step_or_cusum_trigger", f"""with {_Z}, c as (select *, sum(least(greatest(z, -20), 20) - 0.5) over ({_P} rows unbounded preceding) as c, sum(case when z > 1 then 1 else 0 end) over ({_P} rows between 2 preceding and current row) = 3 as step from zs), k as (select *, c - least(0, min(c) over ({_P} rows unbounded preceding)) as s from c) select asset, tag, t, step or s >= 5 as lit from k""")
def i25(spark: SparkSession, d: str) -> DataFrame:
    rows = z_scores(spark, d).withColumn("x", F.least(F.greatest(F.col("z"), F.lit(-20.0)), F.lit(20.0)))
    rows = state.cusum(rows, 0.5, z="x").withColumn("step", state.sustained(F.col("z") > 1, 3))
    return rows.select(*KEYS, "t", (F.col("step") | (F.col("cusum") >= 5)).alias("lit"))


@query("i32_mask_by_state", f"""with {_Z}, {_TAIL(T.RUNNING)} select z.asset, z.tag, z.t, z.z > 2 and coalesce(r."on", true) as kept from zs z left join running r on r.asset = z.asset and r.t = z.t // 3600000000 * 3600000000""")
def i32(spark: SparkSession, d: str) -> DataFrame:
    z = z_scores(spark, d).withColumn("hour", C.floor_to(F.col("t"), HOUR))
    r = T.running(spark, d).withColumnRenamed("t", "hour")
    return z.join(r, ["asset", "hour"], "left").select(*KEYS, "t", ((F.col("z") > 2) & F.coalesce("on", F.lit(True))).alias("kept"))


@query("i37_load_gate", f"""with {_LOAD} select asset, t, y > 40 and (load < 80 or y > 60) as kept from x""")
def i37(spark: SparkSession, d: str) -> DataFrame:
    return loaded(spark, d).select("asset", "t", ((F.col("y") > 40) & ((F.col("load") < 80) | (F.col("y") > 1.5 * 40))).alias("kept"))


@query("i41_single_signal_escape", f"""with {_Z}, s as (select *, sum(case when z > 1.2 then 1 else 0 end) over ({_P} rows between 1 preceding and current row) = 2 as up from zs) select asset, t // 3600000000 as hour, bool_or(up) as escape, count(*) filter (where z > 0) >= 2 as vote from s group by all""")
def i41(spark: SparkSession, d: str) -> DataFrame:
    rows = z_scores(spark, d).withColumn("up", state.sustained(F.col("z") > 1.2, 2))
    return rows.groupBy("asset", F.floor(F.col("t") / HOUR).alias("hour")).agg(F.bool_or("up").alias("escape"), (F.count_if(F.col("z") > 0) >= 2).alias("vote"))


@query("i45_stage_funnel", f"""with {_EPISODES}, {T.INCIDENTS}, f as (select i.asset, i.t, bool_or(e.start is not null) as raw, coalesce(bool_or(e.points >= 2), false) as two_points, coalesce(bool_or(e."end" - e.start >= 3600000000), false) as long from incidents i left join ep e on e.asset = i.asset and e.start between i.t - 86400000000 and i.t group by i.asset, i.t)
    select count(*) as incidents, count(*) filter (where raw) as raw, count(*) filter (where two_points) as two_points, count(*) filter (where long) as long from f""")
def i45(spark: SparkSession, d: str) -> DataFrame:
    i = T.incidents(spark, d)
    ep = alert_episodes(spark, d).select("asset", F.col("start").alias("u"), "points", (F.col("end") - F.col("start")).alias("span"))
    g = align.range_join(i, ep, ["asset"], DAY, 0).groupBy("asset", "t").agg(F.lit(True).alias("raw"), F.bool_or(F.col("points") >= 2).alias("two"), F.bool_or(F.col("span") >= HOUR).alias("long"))
    return i.join(g, ["asset", "t"], "left").agg(F.count("*").alias("incidents"), F.count_if("raw").alias("raw"), F.count_if("two").alias("two_points"), F.count_if("long").alias("long"))


@query("i46_essential_channel", f"""with {_EPISODES}, v as (select e.asset, e.start, array_to_string(list_sort(list_distinct(list(r.tag))), ',') as voters, count(distinct r.tag) as k from ep e join readings r on r.asset = e.asset and r.value > 60 and r.t between e.start and e.start + 21600000000 group by e.asset, e.start) select asset, start, voters, k = 2 as fragile from v""")
def i46(spark: SparkSession, d: str) -> DataFrame:
    heads = alert_episodes(spark, d).select("asset", F.col("start").alias("t"))
    r = T.readings(spark, d).where("value > 60").select("asset", "tag", F.col("t").alias("u"))
    g = align.range_join(heads, r, ["asset"], 0, 6 * HOUR).groupBy("asset", F.col("t").alias("start"))
    return g.agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("voters"), (F.count_distinct("tag") == 2).alias("fragile"))


@query("j08_max_error_with_floor", f"""with {_Z}, q as (select asset, tag, quantile_cont(abs(z), 0.99) as p from zs group by all), fl as (select asset, 0.1 * quantile_cont(p, 0.5) as f from q group by asset), b as (select zs.asset, t // 21600000000 as bin, max(abs(z) / greatest(p, f)) as e from zs join q using (asset, tag) join fl on fl.asset = zs.asset group by all) select asset, bin, round(e, 6) as e from b""")
def j08(spark: SparkSession, d: str) -> DataFrame:
    z = z_scores(spark, d)
    q = z.groupBy(*KEYS).agg(F.percentile(F.abs("z"), 0.99).alias("p"))
    floor = q.groupBy("asset").agg((0.1 * F.percentile("p", 0.5)).alias("f"))
    rows = z.join(q, KEYS).join(floor, "asset")
    return rows.groupBy("asset", F.floor(F.col("t") / (6 * HOUR)).alias("bin")).agg(r6(F.max(F.abs("z") / F.greatest("p", "f"))).alias("e"))


@query("j11_channel_specs", f"""with {_Z}, {_TAIL(T.BINS)}, w as (select asset, t // 604800000000 as week, 'zmax' as spec, max(abs(z)) as v from zs group by all union all select asset, t // 604800000000, 'spread', max(s) from (select asset, t, max(value) - min(value) as s from bins group by all) group by all) select asset, week, spec, round(v, 6) as v from w""")
def j11(spark: SparkSession, d: str) -> DataFrame:
    week = F.floor(F.col("t") / (7 * DAY)).alias("week")
    z = z_scores(spark, d).groupBy("asset", week).agg(r6(F.max(F.abs("z"))).alias("v")).withColumn("spec", F.lit("zmax"))
    s = T.bins(spark, d).groupBy("asset", "t").agg((F.max("value") - F.min("value")).alias("s")).groupBy("asset", week).agg(r6(F.max("s")).alias("v")).withColumn("spec", F.lit("spread"))
    return z.unionByName(s)


@query("j15_causal_z_without_incidents", f"""with {_LABEL}, ok as (select * from lab where not bad), m as (select l.asset, l.tag, l.week, quantile_cont(o.value, 0.5) as m, count(*) as n from (select distinct asset, tag, t // 604800000000 as week from lab) l join ok o on o.asset = l.asset and o.tag = l.tag and o.t < l.week * 604800000000 and o.t >= l.week * 604800000000 - 1209600000000 group by all)
    select l.asset, l.tag, l.t, round(case when n >= 20 then l.value - m end, 6) as dev from lab l left join m on m.asset = l.asset and m.tag = l.tag and m.week = l.t // 604800000000""")
def j15(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).withColumn("week", F.floor(F.col("t") / (7 * DAY)))
    ok = rows.where("not bad").select(*KEYS, F.col("value").alias("x"), F.explode(F.array(F.col("week") + 1, F.col("week") + 2)).alias("week"))
    m = ok.groupBy(*KEYS, "week").agg(F.percentile("x", 0.5).alias("m"), F.count("*").alias("n"))
    return rows.join(m, [*KEYS, "week"], "left").select(*KEYS, "t", r6(F.when(F.col("n") >= 20, F.col("value") - F.col("m"))).alias("dev"))


@query("j16_rolling_z_with_guard", f"""with {T.READINGS}, b as (select distinct asset, tag, t // 21600000000 as block from readings), tr as (select b.asset, b.tag, b.block, r.value as x from b join readings r on r.asset = b.asset and r.tag = b.tag and r.t < b.block * 21600000000 - 86400000000 and r.t >= b.block * 21600000000 - 518400000000), m as (select asset, tag, block, quantile_cont(x, 0.5) as m, count(*) as n from tr group by all),
    s as (select m.asset, m.tag, m.block, m, n, quantile_cont(abs(x - m), 0.5) as mad from m join tr using (asset, tag, block) group by all) select r.asset, r.tag, r.t, round(case when n >= 10 and mad > 0 then (value - m) / (1.4826 * mad) end, 6) as z from readings r left join s on s.asset = r.asset and s.tag = r.tag and s.block = r.t // 21600000000""")
def j16(spark: SparkSession, d: str) -> DataFrame:
    return models.guarded_z(T.readings(spark, d), 6 * HOUR, DAY, 6 * DAY, 10).select(*KEYS, "t", r6("z").alias("z"))


@query("k11_censored_lead", f"""with {_EPISODES}, {T.INCIDENTS}, x as (select i.asset, i.t, max(e.start) as s from incidents i join ep e on e.asset = i.asset and e.start <= i.t and e."end" >= i.t - 28800000000 group by i.asset, i.t) select asset, t, round((t - s) / 3600000000.0, 6) as lead_h, t - s > 28800000000 as censored from x""")
def k11(spark: SparkSession, d: str) -> DataFrame:
    i = T.incidents(spark, d).select("asset", (F.col("t") - 8 * HOUR).alias("a"), F.col("t").alias("b"))
    x = align.overlaps(alert_episodes(spark, d), i, ["asset"], DAY).where("start <= b").groupBy("asset", F.col("b").alias("t")).agg(F.max("start").alias("s"))
    return x.select("asset", "t", r6((F.col("t") - F.col("s")) / float(HOUR)).alias("lead_h"), (F.col("t") - F.col("s") > 8 * HOUR).alias("censored"))


@query("k14_sibling_divergence", f"""with {T.BINS}, s as (select *, sum(value) over w as s, count(value) over w as n from bins window w as (partition by asset, t)), r as (select asset, tag, t, value - (s - value) / (n - 1) as r from s where n > 2), m as (select asset, tag, quantile_cont(r, 0.5) as m from r group by all), q as (select r.asset, r.tag, m, quantile_cont(abs(r - m), 0.5) as mad from r join m using (asset, tag) group by all),
    z as (select r.asset, r.tag, r.t, abs(r - m) / (1.4826 * mad) > 3 as up from r join q using (asset, tag)) select asset, tag, count(*) filter (where up) as diverged, count(*) as n from z group by all""")
def k14(spark: SparkSession, d: str) -> DataFrame:
    r = align.leave_one_out(T.bins(spark, d), ["asset", "t"], 2).where("residual is not null")
    m = r.groupBy(*KEYS).agg(F.percentile("residual", 0.5).alias("m"))
    q = r.join(m, KEYS).groupBy(*KEYS, "m").agg(F.percentile(F.abs(F.col("residual") - F.col("m")), 0.5).alias("mad"))
    z = r.join(q, KEYS).withColumn("up", F.abs(F.col("residual") - F.col("m")) / (1.4826 * F.col("mad")) > 3)
    return z.groupBy(*KEYS).agg(F.count_if("up").alias("diverged"), F.count("*").alias("n"))


@query("k20_parameter_grid", f"""with {T.INCIDENTS}, {T.READINGS}, cfg as (select y, n from (select unnest([40, 60]) as y) cross join (select unnest([1, 2, 3]) as n)), s as (select y, asset, t, row_number() over w as k, case when value > y then 0 else row_number() over w end as lastoff from readings cross join (select unnest([40, 60]) as y) where tag = 'purchase' window w as (partition by y, asset order by t)),
    u as (select y, asset, t, k - max(lastoff) over (partition by y, asset order by t rows unbounded preceding) as run from s), a as (select cfg.y, cfg.n, u.asset, u.t from u join cfg on cfg.y = u.y and u.run >= cfg.n)
    select c.y, c.n, count(*) filter (where exists (select 1 from a where a.y = c.y and a.n = c.n and a.asset = i.asset and a.t between i.t - 28800000000 and i.t)) as hits from cfg c cross join incidents i group by all""")
def k20(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d).where("tag = 'purchase'").withColumn("y", F.explode(F.array(F.lit(40), F.lit(60)))).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    keys = ["y", "n", "asset"]
    k = F.row_number().over(Window.partitionBy(*keys).orderBy("t"))
    rows = rows.withColumn("k", k).withColumn("off", F.when(F.col("value") > F.col("y"), 0).otherwise(F.col("k")))
    run = F.col("k") - F.max("off").over(Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    on = rows.withColumn("run", run).where("run >= n").select("y", "n", "asset", "t")
    m = evaluate.match(on, T.incidents(spark, d), ["asset"], 8 * HOUR, 0, ["y", "n"])
    return m.groupBy("y", "n").agg(F.count("first").alias("hits"))


@query("k23_past_only_validation", f"""with {_CURVE}, s as (select y, t < 1705276800000000 as past, avg(case when first is not null then 1.0 else 0 end) as recall from mm group by all), best as (select y from s where past order by recall desc, y limit 1) select y, past, round(recall, 6) as recall from s join best using (y)""")
def k23(spark: SparkSession, d: str) -> DataFrame:
    from plantwatch.plans.q_eval import _grid_alerts

    m = evaluate.match(_grid_alerts(spark, d), T.incidents(spark, d), ["asset"], 8 * HOUR, 0, ["y"])
    s = m.groupBy("y", (F.col("t") < 1_705_276_800_000_000).alias("past")).agg(F.avg(F.col("first").isNotNull().cast("double")).alias("recall"))
    best = s.where("past").agg(F.max_by("y", F.struct("recall", -F.col("y"))).alias("y"))
    return s.join(F.broadcast(best), "y").select(F.col("y").cast("long").alias("y"), "past", r6("recall").alias("recall"))


@query("k24_window_metric", f"""with {_LABEL} select asset, round(avg(case when value > 60 then 1.0 else 0 end) filter (where bad), 6) as before_failure, round(avg(case when value > 60 then 1.0 else 0 end) filter (where not bad), 6) as normal from lab group by asset""")
def k24(spark: SparkSession, d: str) -> DataFrame:
    up = (F.col("value") > 60).cast("double")
    return labelled(spark, d).groupBy("asset").agg(r6(F.avg(F.when(F.col("bad"), up))).alias("before_failure"), r6(F.avg(F.when(~F.col("bad"), up))).alias("normal"))


@query("k26_window_against_before", f"""with {T.INCIDENTS}, {T.READINGS}, x as (select i.asset, i.t as s, r.value, r.t < i.t as before from incidents i join readings r on r.asset = i.asset and r.t >= i.t - 43200000000 and r.t < i.t + 21600000000), m as (select asset, s, quantile_cont(value, 0.5) filter (where before) as m, max(value) filter (where not before) as top from x group by all) select asset, s, round(top - m, 6) as rise from m""")
def k26(spark: SparkSession, d: str) -> DataFrame:
    x = evaluate.buckets_between(T.readings(spark, d), T.incidents(spark, d), ["asset"], 12 * HOUR, 6 * HOUR)
    m = x.groupBy("asset", "s").agg(F.percentile(F.when(F.col("phase") == "before", F.col("value")), 0.5).alias("m"), F.max(F.when(F.col("phase") == "window", F.col("value"))).alias("top"))
    return m.select("asset", "s", r6(F.col("top") - F.col("m")).alias("rise"))


@query("k28_episode_features", f"""with {_EPISODES} select e.asset, e.start, any_value(e.points) as points, round(quantile_cont(r.value, 0.5), 6) as mid, max(r.value) as peak, round(stddev_samp(r.value), 6) as sd from ep e join readings r on r.asset = e.asset and r.t between e.start - 10800000000 and e.start + 10800000000 group by e.asset, e.start""")
def k28(spark: SparkSession, d: str) -> DataFrame:
    heads = alert_episodes(spark, d).select("asset", F.col("start").alias("t"), "points")
    r = T.readings(spark, d).select("asset", F.col("t").alias("u"), "value")
    g = align.range_join(heads, r, ["asset"], 3 * HOUR, 3 * HOUR).groupBy("asset", F.col("t").alias("start"))
    return g.agg(F.any_value("points").alias("points"), r6(F.percentile("value", 0.5)).alias("mid"), F.max("value").alias("peak"), r6(F.stddev_samp("value")).alias("sd"))


@query("k29_signal_attribution", f"""with {T.INCIDENTS}, {T.READINGS}, x as (select i.asset, i.t, r.tag, max(r.value) as peak, count(*) as n, min(r.t) filter (where r.value > 60) as first from incidents i join readings r on r.asset = i.asset and r.t between i.t - 28800000000 and i.t group by all) select asset, t, arg_min(tag, [first, ascii(tag)]) filter (where first is not null) as first_signal, count(*) filter (where peak > 60) as signals from x group by asset, t""")
def k29(spark: SparkSession, d: str) -> DataFrame:
    r = T.readings(spark, d).select("asset", "tag", F.col("t").alias("u"), "value")
    x = align.range_join(T.incidents(spark, d), r, ["asset"], 8 * HOUR, 0).groupBy("asset", "t", "tag").agg(F.max("value").alias("peak"), F.min(F.when(F.col("value") > 60, F.col("u"))).alias("first"))
    return x.groupBy("asset", "t").agg(F.min_by("tag", F.when(F.col("first").isNotNull(), F.struct("first", F.ascii("tag")))).alias("first_signal"), F.count_if(F.col("peak") > 60).alias("signals"))


@query("k32_robust_selection", f"""with {_CURVE}, n as (select y, recall, min(recall) over w as worst, count(*) filter (where recall >= 0.2) over w as plateau from curve window w as (order by y range between 20 preceding and 20 following)) select y, round(worst, 6) as worst, plateau from n order by worst desc, plateau desc, y limit 1""")
def k32(spark: SparkSession, d: str) -> DataFrame:
    c = curve(spark, d).withColumn("all", F.lit(1)).withColumn("step", ((F.col("y") - 30) / 20).cast("int"))
    c = evaluate.neighbour_worst(c, ["all"], "step", "recall").withColumn("plateau", F.count_if(F.col("recall") >= 0.2).over(Window.partitionBy("all").orderBy("step").rangeBetween(-1, 1)))
    k = F.row_number().over(Window.partitionBy("all").orderBy(F.desc("worst"), F.desc("plateau"), "y"))
    return c.withColumn("k", k).where("k = 1").select(F.col("y").cast("long").alias("y"), r6("worst").alias("worst"), "plateau")


@query("daily_brand_drift", """with s as (select p_brand as tag, l_shipdate::date as day, sum(l_extendedprice) as v from lineitem join part on p_partkey = l_partkey group by all), m as (select tag, quantile_cont(v, 0.5) as m from s group by tag) select s.tag, year(day)::bigint as y, count(*) as days, round(quantile_cont(v, 0.5) / any_value(m), 6) as ratio from s join m using (tag) group by all""")
def daily_brand_drift(spark: SparkSession, d: str) -> DataFrame:
    part = T.table(spark, d, "part").select("p_partkey", "p_brand")
    s = T.table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("tag"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_extendedprice").alias("v"))
    m = s.groupBy("tag").agg(F.percentile("v", 0.5).alias("m"))
    g = s.join(F.broadcast(m), "tag").groupBy("tag", F.year("day").cast("long").alias("y"))
    return g.agg(F.count("*").alias("days"), r6(F.percentile("v", 0.5) / F.any_value("m")).alias("ratio"))


#: Other names of these queries, from when they left out rows.
for _name in ("a02_wide_to_long", "i06_forgetting_cusum"):
    query(f"{_name}_all", SQL[_name])(QUERIES[_name])
