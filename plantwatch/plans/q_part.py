"""Queries: further forms of rows that have one already: all threshold modes, combinations, scales, bands, ramps, restarts, permutations, grids."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantwatch.functions.columns import DAY, HOUR, micros
from plantwatch.operators import clean, episodes, evaluate, models, quantiles, rolling, state
from plantwatch.plans import tables as T
from plantwatch.plans.q_clean import r6
from plantwatch.plans.q_eval import _LABEL, _LOAD, _P, loaded
from plantwatch.plans.q_rest import _curve, _curve_sql
from plantwatch.plans.q_series import KEYS, W
from plantwatch.plans.q_state import _Z, z_scores
from plantwatch.plans.registry import query


@query("b04_order_of_arrival", "with e as (select user_id % 8 as asset, event_type as tag, event_id, epoch_us(ts) as t from events), s as (select *, t < lag(t) over (partition by asset, tag order by event_id) as back from e) select asset, tag, count(*) as n, count(*) - count(distinct t) as duplicates, count(*) filter (where back) as steps_back, count(*) filter (where back) = 0 as monotonic from s group by all")
def b04(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select((F.col("user_id") % 8).alias("asset"), F.col("event_type").alias("tag"), "event_id", micros(F.col("ts")).alias("t"))
    s = e.withColumn("back", F.col("t") < F.lag("t").over(Window.partitionBy(*KEYS).orderBy("event_id")))
    back = F.count_if("back")
    return s.groupBy(*KEYS).agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("t")).alias("duplicates"), back.alias("steps_back"), (back == 0).alias("monotonic"))


@query("d07_all_threshold_modes", f"""with {T.READINGS} select asset, tag, max(value) as top, {', '.join(f"round(quantile_cont(value, {q}), 6) as {n}" for n, q in (("p95", 0.95), ("p97", 0.97), ("p99", 0.99), ("p995", 0.995), ("rate", 0.98)))}, round(avg(value) + 3 * stddev_pop(value), 6) as k_sigma from readings group by all""")
def d07(spark: SparkSession, d: str) -> DataFrame:
    q = {"p95": 0.95, "p97": 0.97, "p99": 0.99, "p995": 0.995, "rate": 0.98}
    rows = T.readings(spark, d)
    out = rows.groupBy(*KEYS).agg(F.max("value").alias("top"), r6(F.avg("value") + 3 * F.stddev_pop("value")).alias("k_sigma"))
    out = out.join(quantiles.quantiles(rows, KEYS, "value", q), list(KEYS))
    return out.select(*KEYS, "top", *(r6(n).alias(n) for n in q), "k_sigma")


_COMBOS = f"""{T.BINS}, a as (select asset, t, list(tag) as tags from bins where value > 60 group by all), e as (select *, sum(case when t - p <= 21600000000 then 0 else 1 end) over (partition by asset order by t rows unbounded preceding) as e from (select *, lag(t) over (partition by asset order by t) as p from a)),
    ep as (select asset, e, (max(t) - min(t)) / 3.6e9 as hours, array_to_string(list_sort(list_distinct(flatten(list(tags)))), '+') as combo from e group by all)"""


def _combinations(spark: SparkSession, d: str) -> DataFrame:
    """(asset, hours, combo): episodes of high hours with the tags that took part."""
    a = T.bins(spark, d).where("value > 60").groupBy("asset", "t").agg(F.collect_set("tag").alias("tags"))
    ep = episodes.episodes(a, ["asset"], 6 * HOUR, combo=F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))), "+"))
    return ep.select("asset", ((F.col("end") - F.col("start")) / 3.6e9).alias("hours"), "combo")


@query("d21_combinations_with_hours", f"""with {_COMBOS} select combo, count(*) as n, round(quantile_cont(hours, 0.5), 6) as middle_hours, case when contains(combo, '+') then null else combo end as essential from ep group by combo""")
def d21(spark: SparkSession, d: str) -> DataFrame:
    g = _combinations(spark, d).groupBy("combo").agg(F.count("*").alias("n"), r6(F.percentile("hours", 0.5)).alias("middle_hours"))
    return g.withColumn("essential", F.when(~F.col("combo").contains("+"), F.col("combo")))


@query("f07_top_combinations_and_longest", f"""with {_COMBOS}, c as (select 'combination' as kind, combo as name, cast(count(*) as double) as x from ep group by combo order by x desc, name limit 5), l as (select 'longest' as kind, asset || '/' || combo as name, round(hours, 6) as x from ep order by x desc, name limit 5) select * from c union all select * from l""")
def f07(spark: SparkSession, d: str) -> DataFrame:
    ep = _combinations(spark, d)
    c = ep.groupBy("combo").agg(F.count("*").cast("double").alias("x")).select(F.lit("combination").alias("kind"), F.col("combo").alias("name"), "x")
    long = ep.select(F.lit("longest").alias("kind"), F.concat_ws("/", "asset", "combo").alias("name"), r6("hours").alias("x"))
    top = lambda df: df.orderBy(F.desc("x"), "name").limit(5)
    return top(c).union(top(long))


@query("d22_dispersion_of_weeks", f"""with {T.INCIDENTS}, w as (select unnest(generate_series((select min(t // {7 * DAY}) from incidents), (select max(t // {7 * DAY}) from incidents))) as week), c as (select a.asset, w.week, count(i.t) as n from (select distinct asset from incidents) a cross join w left join incidents i on i.asset = a.asset and i.t // {7 * DAY} = w.week group by all),
    m as (select asset, avg(n) as mean from c group by asset) select c.asset, round(var_samp(n) / any_value(mean), 6) as dispersion, round(sum(power(n - mean, 2) / mean), 6) as chi_square, count(*) - 1 as degrees from c join m using (asset) group by c.asset""")
def d22(spark: SparkSession, d: str) -> DataFrame:
    i = T.incidents(spark, d).withColumn("week", F.floor(F.col("t") / (7 * DAY)))
    span = i.agg(F.min("week").alias("a"), F.max("week").alias("b"))  # one row
    weeks = i.select("asset").distinct().crossJoin(F.broadcast(span)).select("asset", F.explode(F.sequence("a", "b")).alias("week"))
    c = weeks.join(i.groupBy("asset", "week").agg(F.count("*").alias("n")), ["asset", "week"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mean = F.avg("n").over(Window.partitionBy("asset"))
    c = c.withColumn("mean", mean)
    return c.groupBy("asset").agg(r6(F.var_samp("n") / F.avg("n")).alias("dispersion"), r6(F.sum((F.col("n") - F.col("mean")) ** 2 / F.col("mean"))).alias("chi_square"), (F.count("*") - 1).alias("degrees"))


@query("e03_slope_with_nulls_as_nought", f"""with {T.GRID}, n as (select *, row_number() over ({_P}) as k, coalesce(value, 0) as v from grid) select asset, tag, t, round(case when count(*) over w = 12 and count(value) over w > 0.8 * 12 then (sum(v * k) over w - avg(k) over w * sum(v) over w) / 143 else 0 end, 6) as slope from n window w as (partition by asset, tag order by t rows between 11 preceding and current row)""")
def e03(spark: SparkSession, d: str) -> DataFrame:
    n = T.grid(spark, d).withColumn("k", F.row_number().over(W()).cast("double")).withColumn("v", F.coalesce("value", F.lit(0.0)))
    w = rolling.back(12)
    x = (F.sum(F.col("v") * F.col("k")).over(w) - F.avg("k").over(w) * F.sum("v").over(w)) / 143.0
    ok = (F.count("*").over(w) == 12) & (F.count("value").over(w) > 0.8 * 12)
    return n.select(*KEYS, "t", r6(F.when(ok, x).otherwise(0.0)).alias("slope"))


_SCALES = (4, 16, 48)
_MOMENTS = lambda n: ", ".join(f"avg(power(c, {k})) over (partition by asset, tag order by t rows between {n - 1} preceding and current row) as m{k}_{n}" for k in (1, 2, 3, 4))


@query("e08_shape_at_three_scales", f"""with {T.BINS}, c as (select asset, tag, t, value - quantile_cont(value, 0.5) over ({_P} range between 86400000000 preceding and current row) as c from bins), m as (select *, {', '.join(map(_MOMENTS, _SCALES))}, {', '.join(f"max(abs(c)) over ({_P} rows between {n - 1} preceding and current row) as a_{n}" for n in _SCALES)} from c)
    select asset, tag, t, {', '.join(f"round(m1_{n} + 1e-7, 4) as mean_{n}, round(sqrt(greatest(m2_{n} - m1_{n} * m1_{n}, 0)), 4) as std_{n}, round(case when m2_{n} - m1_{n} * m1_{n} > 1e-6 then (m3_{n} - 3 * m1_{n} * m2_{n} + 2 * power(m1_{n}, 3)) / power(m2_{n} - m1_{n} * m1_{n}, 1.5) end, 3) as skew_{n}, round(case when m2_{n} - m1_{n} * m1_{n} > 1e-6 then (m4_{n} - 4 * m1_{n} * m3_{n} + 6 * m1_{n} * m1_{n} * m2_{n} - 3 * power(m1_{n}, 4)) / power(m2_{n} - m1_{n} * m1_{n}, 2) - 3 end, 3) as kurt_{n}, round(a_{n} / nullif(sqrt(m2_{n}), 0), 4) as crest_{n}" for n in _SCALES)} from m""")
def e08(spark: SparkSession, d: str) -> DataFrame:
    centre = F.percentile("value", 0.5).over(W().rangeBetween(-DAY, 0))
    c = T.bins(spark, d).withColumn("c", F.col("value") - centre)
    out = {}
    for n in _SCALES:
        w = rolling.back(n)
        m1, m2, m3, m4 = (F.avg(F.pow("c", F.lit(float(k)))).over(w) for k in (1, 2, 3, 4))
        var = m2 - m1 * m1
        out |= {f"mean_{n}": F.round(m1 + 1e-7, 4), f"std_{n}": F.round(F.sqrt(F.greatest(var, F.lit(0.0))), 4)}
        out[f"skew_{n}"] = F.round(F.when(var > 1e-6, (m3 - 3 * m1 * m2 + 2 * F.pow(m1, F.lit(3.0))) / F.pow(var, F.lit(1.5))), 3)
        out[f"kurt_{n}"] = F.round(F.when(var > 1e-6, (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * F.pow(m1, F.lit(4.0))) / F.pow(var, F.lit(2.0)) - 3), 3)
        out[f"crest_{n}"] = F.round(F.when(m2 > 0, F.max(F.abs("c")).over(w) / F.sqrt(m2)), 4)
    return c.select(*KEYS, "t", *(x.alias(k) for k, x in out.items()))


@query("e09_rolling_deviation", f"""with {T.READINGS} select asset, tag, t, round(stddev_samp(value) over ({_P} rows between 59 preceding and current row), 6) as std from readings""")
def e09(spark: SparkSession, d: str) -> DataFrame:
    return T.readings(spark, d).select(*KEYS, "t", r6(F.stddev_samp("value").over(rolling.back(60))).alias("std"))


_BANDS = f"{_LOAD}, q as (select asset, quantile_cont(load, 0.33) as a, quantile_cont(load, 0.66) as b from x group by asset), c as (select x.*, case when load < a then 0 when load < b then 1 else 2 end as band from x join q using (asset))"


def _banded(spark: SparkSession, d: str) -> DataFrame:
    x = loaded(spark, d)
    q = quantiles.cut_points(x, ["asset"], "load", {"a": 0.33, "b": 0.66})
    return x.join(q, "asset").withColumn("band", F.when(F.col("load") < F.col("a"), 0).when(F.col("load") < F.col("b"), 1).otherwise(2))


@query("e12_rank_in_load_bands", f"""with {_BANDS} select asset, t, band, round((2 * rank() over (partition by asset, band order by y) + count(*) over (partition by asset, band, y) - 1) / (2.0 * count(*) over (partition by asset, band)), 6) as rank_pct from c""")
def e12(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rank_percent(_banded(spark, d), ["asset", "band"], "y").select("asset", "t", "band", r6("rank_pct").alias("rank_pct"))


@query("k31_load_and_period_residual", f"""with {_BANDS}, m as (select asset, band, quantile_cont(y, 0.5) as expected from c group by all), r as (select c.*, y - expected as residual from c join m using (asset, band)) select asset, t // {7 * DAY} as week, count(*) as n, round(avg(residual), 6) as residual, round(quantile_cont(residual, 0.5), 6) as middle, round((select corr(y, load) from c c2 where c2.asset = r.asset), 6) as load_corr from r group by asset, week""")
def k31(spark: SparkSession, d: str) -> DataFrame:
    c = _banded(spark, d)
    m = c.groupBy("asset", "band").agg(F.percentile("y", 0.5).alias("expected"))
    r = c.join(m, ["asset", "band"]).withColumn("residual", F.col("y") - F.col("expected")).withColumn("week", F.floor(F.col("t") / (7 * DAY)))
    whole = c.groupBy("asset").agg(r6(F.corr("y", "load")).alias("load_corr"))
    return r.groupBy("asset", "week").agg(F.count("*").alias("n"), r6(F.avg("residual")).alias("residual"), r6(F.percentile("residual", 0.5)).alias("middle")).join(whole, "asset")


@query("e23_ramp_in_two_forms", f"""with {T.BINS}, v as (select asset, t, value from bins where tag = 'view'), e as (select a.asset, a.t, any_value(a.value) as value, sum(b.value * power(0.5, (a.t - b.t) / 7200000000.0)) / sum(power(0.5, (a.t - b.t) / 7200000000.0)) as e from v a join v b on a.asset = b.asset and b.t <= a.t group by all),
    s as (select *, (t - lag(t) over w) / 3.6e9 as h, abs(e - lag(e) over w) as de, abs(value - lag(value) over w) as dv from e window w as (partition by asset order by t)) select asset, t, round(de / h, 6) as smooth_ramp, round(max(dv / h) over (partition by asset order by t range between 21600000000 preceding and current row), 6) as top_ramp from s""")
def e23(spark: SparkSession, d: str) -> DataFrame:
    v = state.ewma_time(T.bins(spark, d).where("tag = 'view'"), 2 * HOUR, into="e")
    w = Window.partitionBy("asset").orderBy("t")
    h = (F.col("t") - F.lag("t").over(w)) / 3.6e9
    s = v.withColumn("smooth", F.abs(F.col("e") - F.lag("e").over(w)) / h).withColumn("ramp", F.abs(F.col("value") - F.lag("value").over(w)) / h)
    return s.select("asset", "t", r6("smooth").alias("smooth_ramp"), r6(F.max("ramp").over(w.rangeBetween(-6 * HOUR, 0))).alias("top_ramp"))


@query("e27_channel_forms", f"""with {T.READINGS}, s as (select asset, tag, t, stddev_samp(value) over ({_P} rows between 11 preceding and current row) as vol, value - avg(value) over ({_P} rows between 12 preceding and 1 preceding) as delta from readings), q as (select asset, tag, quantile_cont(vol, 0.5) as vm, (quantile_cont(vol, 0.75) - quantile_cont(vol, 0.25)) / 1.349 as vs, quantile_cont(delta, 0.5) as dm, (quantile_cont(delta, 0.75) - quantile_cont(delta, 0.25)) / 1.349 as ds from s group by all)
    select asset, tag, t, round((vol - vm) / nullif(vs, 0), 5) as volatility_z, round((delta - dm) / nullif(ds, 0), 5) as delta_z from s join q using (asset, tag)""")
def e27(spark: SparkSession, d: str) -> DataFrame:
    s = T.readings(spark, d).withColumn("vol", F.stddev_samp("value").over(rolling.back(12))).withColumn("delta", F.col("value") - F.avg("value").over(W().rowsBetween(-12, -1)))
    scale = lambda c: (F.percentile(c, 0.75) - F.percentile(c, 0.25)) / 1.349
    q = s.groupBy(*KEYS).agg(F.percentile("vol", 0.5).alias("vm"), scale("vol").alias("vs"), F.percentile("delta", 0.5).alias("dm"), scale("delta").alias("ds"))
    z = lambda x, m, sd: F.round(F.when(F.col(sd) != 0, (F.col(x) - F.col(m)) / F.col(sd)), 5)
    return s.join(q, KEYS).select(*KEYS, "t", z("vol", "vm", "vs").alias("volatility_z"), z("delta", "dm", "ds").alias("delta_z"))


_RESTART = lambda after, cap: f"""with recursive {_Z}, n as (select *, row_number() over ({_P}) as k from zs), r as (select asset, tag, t, k, {cap('greatest(0, z - 0.5)')} as s from n where k = 1 union all select n.asset, n.tag, n.t, n.k, {cap(f"greatest(0, case when r.s >= 4 then {after} else r.s end + n.z - 0.5)")} from r join n on n.asset = r.asset and n.tag = r.tag and n.k = r.k + 1) select asset, tag, t, round(s, 6) as cusum, s >= 4 as signal from r"""


def _restarted(spark: SparkSession, d: str, after: float | None, most: float | None) -> DataFrame:
    rows = state.cusum_with_signals(z_scores(spark, d), 0.5, 4.0, after, most)
    return rows.select(*KEYS, "t", r6("cusum").alias("cusum"), (F.col("cusum") >= 4).alias("signal"))


@query("i06_cusum_from_nought_after_signal", _RESTART("0.0", lambda x: x))
def i06_zero(spark: SparkSession, d: str) -> DataFrame:
    return _restarted(spark, d, 0.0, None)


@query("i06_cusum_with_head_start", _RESTART("2.0", lambda x: x))
def i06_head(spark: SparkSession, d: str) -> DataFrame:
    return _restarted(spark, d, 2.0, None)


@query("i06_cusum_with_ceiling", _RESTART("r.s", lambda x: f"least(6.0, {x})"))
def i06_ceiling(spark: SparkSession, d: str) -> DataFrame:
    return _restarted(spark, d, None, 6.0)


@query("j16_guard_band_without_incidents", f"""with {_LABEL}, b as (select distinct asset, tag, t // 21600000000 as block from lab), tr as (select b.asset, b.tag, b.block, r.value as x from b join lab r on r.asset = b.asset and r.tag = b.tag and r.t < b.block * 21600000000 - 86400000000 and r.t >= b.block * 21600000000 - 518400000000 where not r.bad), m as (select asset, tag, block, quantile_cont(x, 0.5) as m, count(*) as n from tr group by all),
    s as (select m.asset, m.tag, m.block, m, n, quantile_cont(abs(x - m), 0.5) as mad from m join tr using (asset, tag, block) group by all) select r.asset, r.tag, r.t, round(case when n >= 10 and mad > 0 then (value - m) / (1.4826 * mad) end, 6) as z from lab r left join s on s.asset = r.asset and s.tag = r.tag and s.block = r.t // 21600000000""")
def j16(spark: SparkSession, d: str) -> DataFrame:
    rows = clean.near_events(T.readings(spark, d), T.incidents(spark, d), ["asset"], 6 * HOUR, 0, "bad").withColumn("ok", ~F.col("bad"))
    return models.guarded_z(rows, 6 * HOUR, DAY, 6 * DAY, 10, usable="ok").select(*KEYS, "t", r6("z").alias("z"))


_PERMS = [list(p) for p in permutations(range(1, 6))]


@query("k19_trend_with_exact_p", f"""with {T.READINGS}, m as (select asset, tag, t // {6 * DAY} as period, quantile_cont(value, 0.5) as v from readings group by all), w as (select asset, tag, list(v order by period) as v from (select *, row_number() over (partition by asset, tag order by period) as k from m) where k <= 5 group by all having count(*) = 5), r as (select asset, tag, list_transform(v, lambda x: len(list_filter(v, lambda y: y < x)) + (len(list_filter(v, lambda y: y = x)) + 1) / 2.0) as r from w),
    p as (select unnest({_PERMS}) as p), s as (select asset, tag, abs(list_sum(list_transform(range(1, 6), lambda i: r[i] * i)) - 45) as seen, abs(list_sum(list_transform(range(1, 6), lambda i: r[i] * p[i])) - 45) as other from r cross join p) select asset, tag, round(avg(case when other >= seen - 1e-9 then 1.0 else 0 end), 6) as p from s group by all""")
def k19(spark: SparkSession, d: str) -> DataFrame:
    m = T.readings(spark, d).groupBy(*KEYS, F.floor(F.col("t") / (6 * DAY)).alias("period")).agg(F.percentile("value", 0.5).alias("v"))
    w = Window.partitionBy(*KEYS).orderBy("period")
    v = m.withColumn("k", F.row_number().over(w)).where("k <= 5").groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("period", "v"))), lambda x: x["v"]).alias("v")).where("size(v) = 5")
    ranks = F.transform("v", lambda x: F.size(F.filter("v", lambda y: y < x)) + (F.size(F.filter("v", lambda y: y == x)) + 1) / 2.0)
    orders = F.array(*(F.array(*map(F.lit, p)) for p in _PERMS))  # the 120 orders of five periods
    apart = lambda o: F.abs(F.aggregate(F.zip_with("r", o, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) - 45)
    seen = apart(F.array(*map(F.lit, range(1, 6))))
    share = F.aggregate(F.transform(orders, lambda o: (apart(o) >= seen - 1e-9).cast("double")), F.lit(0.0), lambda a, b: a + b) / len(_PERMS)
    return v.withColumn("r", ranks).select(*KEYS, r6(share).alias("p"))


_SHIFTS = [(k * 7919 % 1_000_003 * 48_271 + 12_345) % 1009 for k in range(1, 21)]


@query("k25_twenty_circular_shifts", f"""with {T.READINGS}, b as (select asset, t, value, value < 100 as gate, value > 60 as alert, row_number() over (partition by asset order by t) - 1 as n, count(*) over (partition by asset) as c from readings where tag = 'purchase'), s as (select unnest({_SHIFTS}) as shift)
    select x.asset, s.shift, count(*) filter (where not g.gate) as removed from b x cross join s join b g on g.asset = x.asset and (g.n + s.shift) % g.c = x.n where x.alert group by all""")
def k25(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d).where("tag = 'purchase'").withColumn("gate", F.col("value") < 100).withColumn("alert", F.col("value") > 60)
    return evaluate.shifted_overlap(rows, ["asset"], "gate", "alert", _SHIFTS)


@query("k20_grid_with_all_metrics", f"""with {T.INCIDENTS}, {T.READINGS}, s as (select r.*, y, steps, {" + ".join(f"case when steps > {k} and coalesce(lag(value, {k}) over (partition by asset, y, steps order by t) > y, false) then 1 else 0 end" for k in range(1, 4))} + case when value > y then 1 else 0 end as up from (select * from readings where tag = 'purchase') r cross join (select unnest(generate_series(20, 120, 20)) as y) cross join (select unnest([1, 2, 3, 4]) as steps)),
    {_curve_sql("select y, steps, asset, t from s where up = steps", "y, steps")} select y, steps, round(recall, 6) as recall, round(lead_h, 6) as lead_h, episodes, round(false_per_day, 6) as false_per_day from curve""")
def k20(spark: SparkSession, d: str) -> DataFrame:
    grid = F.explode(F.array(*(F.struct(F.lit(y).cast("long").alias("y"), F.lit(n).alias("steps")) for y in range(20, 121, 20) for n in (1, 2, 3, 4))))
    rows = T.readings(spark, d).where("tag = 'purchase'").withColumn("g", grid).select("g.*", "asset", "t", "value")
    own = ["y", "steps", "asset"]
    up = [F.col("value") > F.col("y")] + [(F.col("steps") <= k) | F.coalesce(F.lag("value", k).over(Window.partitionBy(*own).orderBy("t")) > F.col("y"), F.lit(False)) for k in (1, 2, 3)]
    said = rows.withColumn("up", up[0] & up[1] & up[2] & up[3]).where("up").select(*own, "t")
    c = _curve(spark, d, said, ["y", "steps"])
    return c.select("y", "steps", r6("recall").alias("recall"), r6("lead_h").alias("lead_h"), "episodes", r6("false_per_day").alias("false_per_day"))


_RUNS_UP = f"""{_Z}, u as (select *, z > -0.5 as up from zs), g as (select *, sum(case when up is distinct from p then 1 else 0 end) over ({_P} rows unbounded preceding) as run from (select *, lag(up) over ({_P}) as p from u))"""


def _up(spark: SparkSession, d: str) -> DataFrame:
    return z_scores(spark, d).withColumn("up", F.col("z") > -0.5)


@query("i36_truncated_calm_and_absolute", f"""with {_RUNS_UP}, c as (select *, t - min(t) over r as age, max(value) over (partition by asset, tag, run order by t rows unbounded preceding) as top, coalesce(up and value > 60 and lag(value) over r <= 60, false) as rise from g window r as (partition by asset, tag, run order by t)),
    k as (select *, coalesce(top <= lag(top, 4) over r * 1.05, false) as calm from c window r as (partition by asset, tag, run order by t)) select asset, tag, t, up and age <= 86400000000 and not bool_or(calm) over (partition by asset, tag, run order by t rows unbounded preceding) as kept, cast(sum(case when rise then 1 else 0 end) over (partition by asset, tag, run order by t rows unbounded preceding) as bigint) as part from k""")
def i36_native(spark: SparkSession, d: str) -> DataFrame:
    return state.cut_runs(_up(spark, d), "up", span=DAY, calm=4, gain=0.05, level=60.0).select(*KEYS, "t", "kept", "part")


@query("i36_magnitude_and_ceiling", f"""with recursive {_Z}, n as (select *, z > -0.5 as up, row_number() over ({_P}) as k from zs), r(asset, tag, t, k, up, floor, part, had, off, kept) as (select asset, tag, t, k, up, value, cast(0 as bigint), case when up then 1 else 0 end, case when up then 0 else 4 end, up from n where k = 1
    union all select n.asset, n.tag, n.t, n.k, n.up, case when not n.up or not r.up or (r.floor > 0 and n.value > 3 * r.floor) then n.value else least(r.floor, n.value) end, case when not n.up or not r.up then 0 when r.floor > 0 and n.value > 3 * r.floor then r.part + 1 else r.part end,
    case when n.up then least(r.had + 1, 6) when r.off + 1 >= 3 then 0 else r.had end, case when n.up then 0 else r.off + 1 end, n.up and r.had < 6 from r join n on n.asset = r.asset and n.tag = r.tag and n.k = r.k + 1) select asset, tag, t, part, kept from r""")
def i36_fold(spark: SparkSession, d: str) -> DataFrame:
    return state.cut_by_fold(_up(spark, d), "up", 3.0, 6, 3).select(*KEYS, "t", "part", "kept")


@query("k26_random_windows", f"""with {T.INCIDENTS}, {T.RUNNING}, pool as (select asset, t, row_number() over (partition by asset order by t) - 1 as i, count(*) over (partition by asset) as n from running g where "on" and not exists (select 1 from incidents i where i.asset = g.asset and i.t between g.t - 10800000000 and g.t + 10800000000)),
    dr as (select asset, any_value(n) as n, unnest(generate_series(1, 30)) as draw from pool group by asset), st as (select d.asset, d.draw, p.t as s from dr d join pool p on p.asset = d.asset and p.i = ((d.draw * 7919) % 1000003 * 48271 + 12345) % d.n),
    m as (select st.asset, draw, s, tag, r.t as u, value from st join readings r on r.asset = st.asset and r.t >= s - 216000000000 and r.t < s + 43200000000), b as (select asset, draw, s, tag, quantile_cont(value, 0.5) as m from m where u < s - 43200000000 group by all having count(*) >= 10),
    q as (select asset, draw, s, tag, b.m, 1.4826 * quantile_cont(abs(value - b.m), 0.5) as sd from m join b using (asset, draw, s, tag) where u < s - 43200000000 group by all), p as (select asset, draw, s, tag, max(abs(value - q.m) / sd) as p from m join q using (asset, draw, s, tag) where u >= s and sd > 1e-9 group by all),
    g as (select asset, draw, s as start, count(*) filter (where p >= 3) as ge3, count(*) filter (where p >= 10) as ge10 from p group by all) select asset, cast(draw as integer) as draw, start, ge3, ge10, case when ge10 >= 2 then 'strong' when ge3 >= 2 then 'moderate' when ge3 >= 1 then 'edge' else 'weak' end as grade from g""")
def k26(spark: SparkSession, d: str) -> DataFrame:
    far = clean.near_events(T.running(spark, d).where("on"), T.incidents(spark, d), ["asset"], 3 * HOUR, 3 * HOUR, "near").where("not near")
    return evaluate.random_windows(T.readings(spark, d), far, ["asset"], "tag", 30, 12 * HOUR, 12 * HOUR, 48 * HOUR, 10)
