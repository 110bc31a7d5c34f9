"""Queries: stateful rules and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantwatch.functions.columns import DAY, HOUR
from plantwatch.operators import align, blocks, clean, episodes, rolling, state
from plantwatch.plans import tables as T
from plantwatch.plans.q_clean import r6
from plantwatch.plans.q_series import _EPISODES, KEYS, W, alert_episodes
from plantwatch.plans.registry import QUERIES, SQL, query

_P = "partition by asset, tag order by t"
_Z = f"""{T.READINGS}, p as (select asset, tag, avg(value) as mu, stddev_pop(value) as sd from readings group by all), zs as (select asset, tag, t, value, (value - mu) / sd as z from readings join p using (asset, tag))"""


def z_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d)
    p = rows.groupBy(*KEYS).agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    return rows.join(p, KEYS).select(*KEYS, "t", "value", ((F.col("value") - F.col("mu")) / F.col("sd")).alias("z"))


@query("i01_ewma_points", f"""with {T.GRID}, n as (select *, row_number() over ({_P}) as k from grid)
    select a.asset, a.tag, a.t, round(sum(b.value * power(0.5, (a.k - b.k) / 12.0)) / sum(case when b.value is not null then power(0.5, (a.k - b.k) / 12.0) end), 6) as ewma from n a join n b on a.asset = b.asset and a.tag = b.tag and b.k <= a.k group by all""")
def i01(spark: SparkSession, d: str) -> DataFrame:
    return state.ewma_points(T.grid(spark, d), 12.0).select(*KEYS, "t", r6("ewma").alias("ewma"))


@query("i02_ewma_time", f"""with {T.READINGS} select a.asset, a.tag, a.t, round(sum(b.value * power(0.5, (a.t - b.t) / 43200000000.0)) / sum(power(0.5, (a.t - b.t) / 43200000000.0)), 6) as ewma from readings a join readings b on a.asset = b.asset and a.tag = b.tag and b.t <= a.t group by all""")
def i02(spark: SparkSession, d: str) -> DataFrame:
    return state.ewma_time(T.readings(spark, d), 12 * HOUR).select(*KEYS, "t", r6("ewma").alias("ewma"))


@query("i03_health_ewma", f"""with recursive {T.READINGS}, n as (select *, row_number() over ({_P}) as k from readings), r as (select asset, tag, t, k, value as s from n where k = 1 union all select n.asset, n.tag, n.t, n.k, (1 - power(0.5, 1 / 8.0)) * n.value + power(0.5, 1 / 8.0) * r.s from r join n on n.asset = r.asset and n.tag = r.tag and n.k = r.k + 1)
    select asset, tag, t, round(s, 6) as health from r""")
def i03(spark: SparkSession, d: str) -> DataFrame:
    return state.ewma_recursive(T.readings(spark, d), 8.0, into="health").select(*KEYS, "t", r6("health").alias("health"))


@query("i04_cusum", f"""with recursive {_Z}, n as (select *, row_number() over ({_P}) as k from zs), r as (select asset, tag, t, k, greatest(0, z - 0.5) as s from n where k = 1 union all select n.asset, n.tag, n.t, n.k, greatest(0, r.s + n.z - 0.5) from r join n on n.asset = r.asset and n.tag = r.tag and n.k = r.k + 1)
    select asset, tag, t, round(s, 6) as cusum, s >= 4 as alarm from r""")
def i04(spark: SparkSession, d: str) -> DataFrame:
    return state.cusum(z_scores(spark, d), 0.5).select(*KEYS, "t", r6("cusum").alias("cusum"), (F.col("cusum") >= 4).alias("alarm"))


@query("i05_cusum_with_reset", f"""with recursive {_Z}, n as (select *, t // 86400000000 <> lag(t // 86400000000) over ({_P}) as reset, row_number() over ({_P}) as k from zs), r as (select asset, tag, t, k, greatest(0, z - 0.2) as s from n where k = 1 union all select n.asset, n.tag, n.t, n.k, greatest(0, r.s * case when n.reset then 0.25 else 1 end + n.z - 0.2) from r join n on n.asset = r.asset and n.tag = r.tag and n.k = r.k + 1)
    select asset, tag, t, round(s, 6) as cusum from r""")
def i05(spark: SparkSession, d: str) -> DataFrame:
    rows = z_scores(spark, d)
    day = F.floor(F.col("t") / DAY)
    rows = rows.withColumn("_day", day).withColumn("reset", F.col("_day") != F.lag("_day").over(W()))
    return state.cusum_segments(rows, 0.2, "reset", 0.25).select(*KEYS, "t", r6("cusum").alias("cusum"))


@query("i07_multiscale_glr", f"""with {_Z}, c as (select *, sum(z) over ({_P} rows unbounded preceding) as c, row_number() over ({_P}) as k from zs) select asset, tag, t, round(greatest(0, case when k > 4 then (c - lag(c, 4) over ({_P})) / 2 when k = 4 then c / 2 else 0 end, case when k > 16 then (c - lag(c, 16) over ({_P})) / 4 when k = 16 then c / 4 else 0 end), 6) as glr from c""")
def i07(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks.by_rows(z_scores(spark, d), KEYS, 17, lambda x, keys: state.glr(x, [4, 16], keys))
    return rows.select(*KEYS, "t", r6("glr").alias("glr"))


@query("i08_sustained_step", f"""with {_Z} select asset, tag, t, sum(case when z > 0 then 1 else 0 end) over ({_P} rows between 2 preceding and current row) = 3 as sustained from zs""")
def i08(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks.by_rows(z_scores(spark, d), KEYS, 3, lambda x, keys: x.withColumn("sustained", state.sustained(F.col("z") > 0, 3, keys)))
    return rows.select(*KEYS, "t", "sustained")


@query("i09_frozen_sensor", f"""with {T.BINS}, v as (select asset, tag, t, floor(value / 40) as value from bins), s as (select *, value - lag(value) over ({_P}) as dv from v) select asset, tag, t, count(dv) over ({_P} rows between 2 preceding and current row) = 3 and count(*) filter (where dv <> 0) over ({_P} rows between 2 preceding and current row) = 0 as frozen from s""")
def i09(spark: SparkSession, d: str) -> DataFrame:
    rows = T.bins(spark, d).withColumn("value", F.floor(F.col("value") / 40))
    return state.frozen_flag(rows, 3).select(*KEYS, "t", "frozen")


@query("i11_k_of_n", f"""with {_Z} select asset, tag, t, sum(case when z > 0 then 1 else 0 end) over ({_P} rows between 7 preceding and current row) >= 5 as dense, round(avg(case when z > 0 then 1.0 else 0 end) over ({_P} range between 43200000000 preceding and current row), 6) as density from zs""")
def i11(spark: SparkSession, d: str) -> DataFrame:
    up = F.col("z") > 0
    rows = rolling.means(z_scores(spark, d), KEYS, 12 * HOUR, {"density": F.coalesce(up, F.lit(False)).cast("double")}, 36 * HOUR)
    return rows.select(*KEYS, "t", state.k_of_n(up, 5, 8).alias("dense"), r6("density").alias("density"))


@query("i12_short_run_removal", f"""with {_Z}, f as (select *, z > 0 as up, lag(z > 0) over ({_P}) as p from zs), g as (select *, sum(case when up is distinct from p then 1 else 0 end) over ({_P} rows unbounded preceding) as run from f) select asset, tag, t, up and count(*) over (partition by asset, tag, run) >= 3 as up from g""")
def i12(spark: SparkSession, d: str) -> DataFrame:
    return episodes.drop_short_runs(z_scores(spark, d).withColumn("up", F.col("z") > 0), KEYS, "up", 3).select(*KEYS, "t", "up")


@query("i13_hysteresis", f"""with {_Z} select asset, tag, t, coalesce(last_value(case when z >= 1 then true when z < -0.3 then false end ignore nulls) over ({_P} rows unbounded preceding), false) as armed from zs""")
def i13(spark: SparkSession, d: str) -> DataFrame:
    return state.hysteresis(z_scores(spark, d), 1.0, -0.3).select(*KEYS, "t", "armed")


@query("i14_sticky_alert", f"""with {_Z} select asset, tag, t, bool_or(z > 2) over ({_P} range between 28800000000 preceding and current row) as sticky from zs""")
def i14(spark: SparkSession, d: str) -> DataFrame:
    return z_scores(spark, d).select(*KEYS, "t", state.sticky(F.col("z") > 2, 8 * HOUR).alias("sticky"))


@query("i15_gate_lock_and_door", f"""with {_Z}, f as (select *, z > -0.5 as up, value > 60 as ok, lag(z > -0.5) over ({_P}) as p from zs), g as (select *, sum(case when up is distinct from p then 1 else 0 end) over ({_P} rows unbounded preceding) as run from f)
    select asset, tag, t, up and bool_or(ok) over (partition by asset, tag, run order by t rows unbounded preceding) as locked, up and first_value(ok) over (partition by asset, tag, run order by t) as door from g""")
def i15(spark: SparkSession, d: str) -> DataFrame:
    rows = z_scores(spark, d).withColumn("up", F.col("z") > -0.5).withColumn("ok", F.col("value") > 60)
    lock = state.gate_runs(rows, "up", "ok", "lock").withColumnRenamed("gated", "locked")
    return state.gate_runs(lock, "up", "ok", "door").select(*KEYS, "t", "locked", F.col("gated").alias("door"))


@query("i16_non_decay_gate", f"""with {_Z} select asset, tag, t, coalesce(value >= lag(value, 6) over ({_P}) * 0.9, false) as holds from zs""")
def i16(spark: SparkSession, d: str) -> DataFrame:
    return z_scores(spark, d).select(*KEYS, "t", F.coalesce(F.col("value") >= F.lag("value", 6).over(W()) * 0.9, F.lit(False)).alias("holds"))


@query("i17_episodes_chained", f"with {_EPISODES} select asset, episode, start, \"end\", points from ep")
def i17(spark: SparkSession, d: str) -> DataFrame:
    return alert_episodes(spark, d)


@query("i18_episodes_by_sampling", f"""with {T.READINGS}, g as (select asset, 3 * quantile_cont(dt, 0.5) as gap from (select asset, t - lag(t) over (partition by asset order by t) as dt from readings) group by asset), a as (select asset, t, lag(t) over (partition by asset order by t) as p from readings where value > 50),
    e as (select a.*, sum(case when t - p < gap then 0 else 1 end) over (partition by a.asset order by t rows unbounded preceding) as e from a join g using (asset)) select asset, count(distinct e) as episodes from e group by asset""")
def i18(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d)
    w = Window.partitionBy("asset").orderBy("t")
    gap = rows.withColumn("dt", F.col("t") - F.lag("t").over(w)).groupBy("asset").agg((3 * F.percentile("dt", 0.5)).alias("gap"))
    new = F.when(F.col("t") - F.lag("t").over(w) < F.col("gap"), 0).otherwise(1)
    return rows.where("value > 50").join(F.broadcast(gap), "asset").withColumn("new", new).groupBy("asset").agg(F.sum("new").alias("episodes"))


@query("i19_incident_dedup", f"with {T.INCIDENTS} select asset, t from incidents")
def i19(spark: SparkSession, d: str) -> DataFrame:
    return T.incidents(spark, d)


@query("i20_anchored_dedup", f"""with recursive {T.ALARMS}, n as (select asset, t, row_number() over (partition by asset order by t) as k from alarms where condition in ('HI', 'HIHI')), r as (select asset, k, t, t as last, true as kept from n where k = 1 union all select n.asset, n.k, n.t, case when n.t - r.last > 21600000000 then n.t else r.last end, n.t - r.last > 21600000000 from r join n on n.asset = r.asset and n.k = r.k + 1)
    select asset, t from r where kept""")
def i20(spark: SparkSession, d: str) -> DataFrame:
    return episodes.anchored(T.alarms(spark, d).where("condition in ('HI', 'HIHI')").select("asset", "t"), ["asset"], 6 * HOUR)


@query("i21_day_merge", f"""with {T.INCIDENTS}, e as (select *, sum(case when t - p < 86400000000 then 0 else 1 end) over (partition by asset order by t rows unbounded preceding) as e from (select *, lag(t) over (partition by asset order by t) as p from incidents)) select asset, min(t) as t, count(*) as repeats from e group by asset, e""")
def i21(spark: SparkSession, d: str) -> DataFrame:
    ep = episodes.episodes(T.incidents(spark, d), ["asset"], DAY, strict=True)
    return ep.select("asset", F.col("start").alias("t"), F.col("points").alias("repeats"))


_SEG = f"""{T.ALARMS}, s as (select *, sum(case when condition = 'OK' then 1 else 0 end) over (partition by asset order by t rows unbounded preceding) - case when condition = 'OK' then 1 else 0 end as seg from alarms)"""


@query("i22_ok_aware_incidents", f"""with {_SEG} select asset, min(t) filter (where condition <> 'OK') as start, max(t) filter (where condition = 'OK') as "end" from s group by asset, seg having start is not null and ("end" is null or "end" - start >= 3600000000)""")
def i22(spark: SparkSession, d: str) -> DataFrame:
    return episodes.ok_aware(T.alarms(spark, d), ["asset"], HOUR)


@query("i23_active_intervals", f"""with {T.ALARMS}, s as (select *, sum(case when status = 'INACT' then 1 else 0 end) over (partition by asset order by t rows unbounded preceding) - case when status = 'INACT' then 1 else 0 end as seg, max(t) over (partition by asset) as last from alarms) select asset, min(t) filter (where status <> 'INACT') as start, coalesce(max(t) filter (where status = 'INACT'), max(last)) as "end" from s group by asset, seg having start is not null""")
def i23(spark: SparkSession, d: str) -> DataFrame:
    return episodes.active_intervals(T.alarms(spark, d), ["asset"])


@query("i24_alarm_channel", f"""with {T.BINS}, {T.ALARMS} select b.asset, b.tag, b.t, exists (select 1 from alarms a where a.asset = b.asset and a.tag = 'T1' and a.t between b.t - 21600000000 and b.t) as fired from bins b""")
def i24(spark: SparkSession, d: str) -> DataFrame:
    a = T.alarms(spark, d).where("tag = 'T1'").select("asset", "t")
    return clean.near_events(T.bins(spark, d), a, ["asset"], 0, 6 * HOUR, "fired").select("asset", "tag", "t", "fired")


@query("i26_two_level_vote", f"""with {_Z}, b as (select asset, t // 21600000000 as bin, tag, avg(z) as z from zs group by all), v as (select asset, bin, count(*) filter (where z > 0.3) as low, count(*) filter (where z > 0.8) as high, bool_or(tag in ('view', 'error') and z > 0.8) as gate from b group by all)
    select asset, bin, low, high, low >= 3 or (high >= 2 and gate) as alarm from v""")
def i26(spark: SparkSession, d: str) -> DataFrame:
    b = z_scores(spark, d).groupBy("asset", F.floor(F.col("t") / (6 * HOUR)).alias("bin"), "tag").agg(F.avg("z").alias("z"))
    gate = F.bool_or(F.col("tag").isin("view", "error") & (F.col("z") > 0.8))
    v = b.groupBy("asset", "bin").agg(F.count_if(F.col("z") > 0.3).alias("low"), F.count_if(F.col("z") > 0.8).alias("high"), gate.alias("gate"))
    return v.select("asset", "bin", "low", "high", ((F.col("low") >= 3) | ((F.col("high") >= 2) & F.col("gate"))).alias("alarm"))


@query("i27_corroboration_tiers", f"""with {T.BINS}, q as (select asset, tag, quantile_cont(value, 0.8) as q from bins group by all), v as (select b.asset, b.t, count(*) filter (where value > q) as k from bins b join q using (asset, tag) group by all) select asset, t, k, case when k >= 3 then 'critical' when k = 2 then 'alarm' when k = 1 then 'warn' else 'none' end as tier from v""")
def i27(spark: SparkSession, d: str) -> DataFrame:
    b = T.bins(spark, d)
    q = b.groupBy(*KEYS).agg(F.percentile("value", 0.8).alias("q"))
    v = state.vote(b.join(q, KEYS).withColumn("up", F.col("value") > F.col("q")), ["asset", "t"], "up", 2)
    return v.select("asset", "t", F.col("votes").alias("k"), F.when(F.col("votes") >= 3, "critical").when(F.col("votes") == 2, "alarm").when(F.col("votes") == 1, "warn").otherwise("none").alias("tier"))


@query("i28_ensemble_or", f"""with {T.BINS} select asset, t, bool_or(value > 60) as alert from bins group by all""")
def i28(spark: SparkSession, d: str) -> DataFrame:
    return T.bins(spark, d).groupBy("asset", "t").agg(F.bool_or(F.col("value") > 60).alias("alert"))


@query("i29_sequence_to_point", f"""with {_Z}, n as (select *, row_number() over ({_P}) as k, avg(abs(z)) over ({_P} rows between 5 preceding and current row) as score from zs), s as (select *, score > 0.9 as is_anom from n where k >= 6 and (k - 6) % 2 = 0) select asset, tag, t, sum(case when is_anom then 1 else 0 end) over ({_P} rows between 2 preceding and current row) >= 2 as point from s""")
def i29(spark: SparkSession, d: str) -> DataFrame:
    rows = z_scores(spark, d).withColumn("k", F.row_number().over(W())).withColumn("score", F.avg(F.abs("z")).over(W().rowsBetween(-5, 0)))
    seq = rows.where("k >= 6 and (k - 6) % 2 = 0").withColumn("is_anom", F.col("score") > 0.9)
    return state.sequence_to_point(seq, 2, 3).select(*KEYS, "t", "point")


@query("i31_operational_state", f"""with {T.RUNNING}, rr as (select *, sum(case when "on" is distinct from p then 1 else 0 end) over (partition by asset order by t rows unbounded preceding) as run from (select *, lag("on") over (partition by asset order by t) as p from running)), x as (select *, min(t) over (partition by asset, run) as a, max(t) over (partition by asset, run) as b from rr)
    select asset, t, case when not "on" then case when b - a >= 21600000000 then 'off_long' else 'off_short' end when run > 1 and t - a <= 7200000000 then 'transient' else 'on' end as state from x""")
def i31(spark: SparkSession, d: str) -> DataFrame:
    return state.operational_state(T.running(spark, d), ["asset"], 6 * HOUR, 2 * HOUR).select("asset", "t", "state")


@query("i33_refractory", f"""with recursive {_EPISODES}, n as (select *, row_number() over (partition by asset order by start) as k from ep), r as (select asset, k, start, "end", "end" as until, true as kept from n where k = 1 union all select n.asset, n.k, n.start, n."end", case when n.start > r.until + 86400000000 then n."end" else r.until end, n.start > r.until + 86400000000 from r join n on n.asset = r.asset and n.k = r.k + 1)
    select asset, start, "end" from r where kept""")
def i33(spark: SparkSession, d: str) -> DataFrame:
    return episodes.refractory(alert_episodes(spark, d), ["asset"], DAY)


@query("i34_min_duration", f"""with {_EPISODES} select asset, start, "end" from ep where "end" - start >= 3600000000 or (points >= 2 and "end" - start >= 600000000)""")
def i34(spark: SparkSession, d: str) -> DataFrame:
    return episodes.min_duration(alert_episodes(spark, d), HOUR, strength="points", stronger=2, least_if_strong=HOUR // 6).select("asset", "start", "end")


_UP = f"""{_Z}, f as (select *, z > -0.5 as up, lag(z > -0.5) over ({_P}) as p from zs), g as (select *, sum(case when up is distinct from p then 1 else 0 end) over ({_P} rows unbounded preceding) as run from f)"""


@query("i35_age_escalation", f"""with {_UP}, h as (select *, up and t - min(t) over (partition by asset, tag, run) > 14400000000 and value >= 60 as high from g), x as (select *, case when sum(case when high then 1 else 0 end) over (partition by asset, tag, run order by t rows unbounded preceding) > 0 then 1 else 0 end as part from h) select asset, tag, t, case when up then run || '-' || part end as episode from x""")
def i35(spark: SparkSession, d: str) -> DataFrame:
    rows = z_scores(spark, d).withColumn("up", F.col("z") > -0.5)
    return state.escalate(rows, KEYS, "up", "value", 4 * HOUR, 60.0).select(*KEYS, "t", "episode")


@query("i36_decay_cut_and_rearm", f"""with {_UP}, c as (select *, value < 0.5 * max(value) over (partition by asset, tag, run order by t rows unbounded preceding) as low, row_number() over (partition by asset, tag, run order by t) - 1 as place from g) select asset, tag, t, up and not bool_or(low) over (partition by asset, tag, run order by t rows unbounded preceding) as decay, up and place % 5 < 2 as rearm from c""")
def i36(spark: SparkSession, d: str) -> DataFrame:
    rows = z_scores(spark, d).withColumn("up", F.col("z") > -0.5)
    cut = state.stabilised_cut(rows, "up", "value", 0.5).withColumnRenamed("kept", "decay")
    return state.rearmed(cut, KEYS, "up", 2, 3).select(*KEYS, "t", "decay", F.col("kept").alias("rearm"))


@query("i38_confidence_grading", f"""with {_EPISODES} select e.asset, e.start, round(avg(case when r.value > 40 then 1.0 else 0 end), 6) as density, round(regr_slope(r.value, r.t / 3600000000.0), 4) as slope, case when avg(case when r.value > 40 then 1.0 else 0 end) >= 0.5 then 'action' else 'observe' end as grade
    from ep e join readings r on r.asset = e.asset and r.tag = 'purchase' and r.t between e.start and e.start + 43200000000 group by all""")
def i38(spark: SparkSession, d: str) -> DataFrame:
    heads = alert_episodes(spark, d).select("asset", F.col("start").alias("t"))
    r = T.readings(spark, d).where("tag = 'purchase'").select("asset", F.col("t").alias("u"), "value")
    met = align.range_join(heads, r, ["asset"], 0, 12 * HOUR)
    density = F.avg((F.col("value") > 40).cast("double"))
    return met.groupBy("asset", F.col("t").alias("start")).agg(r6(density).alias("density"), F.round(F.regr_slope("value", F.col("u") / float(HOUR)), 4).alias("slope"), F.when(density >= 0.5, "action").otherwise("observe").alias("grade"))


@query("i39_channel_order", f"""with {_EPISODES}, f as (select e.asset, e.start, r.tag, min(r.t) as first_t from ep e join readings r on r.asset = e.asset and r.value > 60 and r.t between e.start - 21600000000 and e.start + 21600000000 group by all) select asset, start, string_agg(tag, '>' order by first_t, tag) as signature from f group by all""")
def i39(spark: SparkSession, d: str) -> DataFrame:
    heads = alert_episodes(spark, d).select("asset", F.col("start").alias("t"))
    r = T.readings(spark, d).where("value > 60").select("asset", "tag", F.col("t").alias("u"))
    first = align.range_join(heads, r, ["asset"], 6 * HOUR, 6 * HOUR).groupBy("asset", "t", "tag").agg(F.min("u").alias("first_t"))
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_t", "tag"))), lambda x: x["tag"]), ">")
    return first.groupBy("asset", F.col("t").alias("start")).agg(order.alias("signature"))


@query("i40_innovation", f"""with {T.READINGS}, e as (select a.asset, a.tag, a.t, any_value(a.value) as value, sum(b.value * power(0.5, (a.t - b.t) / 43200000000.0)) / sum(power(0.5, (a.t - b.t) / 43200000000.0)) as m from readings a join readings b on a.asset = b.asset and a.tag = b.tag and b.t <= a.t group by all),
    d as (select *, abs(value - m) as inn from e) select asset, tag, t, round(inn / case when quantile_cont(inn, 0.5) over ({_P} rows between 60 preceding and 1 preceding) > 1e-6 then quantile_cont(inn, 0.5) over ({_P} rows between 60 preceding and 1 preceding) end, 4) as score from d""")
def i40(spark: SparkSession, d: str) -> DataFrame:
    rows = state.ewma_time(T.readings(spark, d), 12 * HOUR).withColumn("inn", F.abs(F.col("value") - F.col("ewma")))
    typical = F.percentile("inn", 0.5).over(W().rowsBetween(-60, -1))
    return rows.select(*KEYS, "t", F.round(F.when(typical > 1e-6, F.col("inn") / typical), 4).alias("score"))


@query("i42_startup_triage", f"""with {_EPISODES}, {T.RUNNING.removeprefix(T.READINGS + ', ')}, s as (select asset, t from (select *, "on" and not coalesce(lag("on") over (partition by asset order by t), false) as st from running) where st)
    select e.asset, e.start, case when e.start - s.t <= 21600000000 then 'after start' else 'high confidence' end as layer from ep e asof left join s on s.asset = e.asset and s.t <= e.start""")
def i42(spark: SparkSession, d: str) -> DataFrame:
    s = clean.starts(T.running(spark, d), ["asset"]).where("start").select("asset", "t")
    ep = alert_episodes(spark, d).select("asset", "start", F.col("start").alias("t"))
    x = align.asof(ep, s, ["asset"], [])
    return x.select("asset", "start", F.when(F.col("start") - F.col("t_match") <= 6 * HOUR, "after start").otherwise("high confidence").alias("layer"))


@query("i43_run_start_at", f"""with {T.INCIDENTS}, {T.RUNNING}, rr as (select *, sum(case when "on" is distinct from p then 1 else 0 end) over (partition by asset order by t rows unbounded preceding) as run from (select *, lag("on") over (partition by asset order by t) as p from running)), k as (select *, min(t) over (partition by asset, run) as a from rr) select i.asset, i.t, k.a as run_start, k."on" from incidents i asof left join k on k.asset = i.asset and k.t <= i.t""")
def i43(spark: SparkSession, d: str) -> DataFrame:
    rr = episodes.runs(T.running(spark, d), ["asset"], "on")
    rr = rr.withColumn("run_start", F.min("t").over(Window.partitionBy("asset", "run"))).select("asset", "t", "on", "run_start")
    return align.asof(T.incidents(spark, d), rr, ["asset"], ["run_start", "on"]).drop("t_match")


#: Other names of these queries, from when they left out series.
for _name in ("i01_ewma_points", "i03_health_ewma", "i04_cusum", "i05_cusum_with_reset"):
    query(f"{_name}_all", SQL[_name])(QUERIES[_name])
