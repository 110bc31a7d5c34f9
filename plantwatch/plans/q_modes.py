"""Queries: failures that alarms announce, their modes and signals, tables of cells, robust selection, long references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantwatch.functions.columns import DAY, HOUR
from plantwatch.operators import align, clean, episodes, evaluate, models, scans
from plantwatch.plans import tables as T
from plantwatch.plans.q_clean import r6
from plantwatch.plans.q_series import KEYS
from plantwatch.plans.q_state import _P
from plantwatch.plans.registry import query

MINUTE = 60_000_000
_OFFSETS = [h * HOUR for h in (-3, -2, -1, 0, 1, 2, 3)]
_MODES = [("T0", "bearing"), ("T1", "seal"), ("T2", "oil")]
#: Of each signal, what it is in alarm above.
_LIMITS = {"click": 60.0, "error": 80.0, "purchase": 70.0, "signup": 60.0, "view": 90.0}

_FAILURES = f"""{T.RUNNING}, {T.ALARMS}, rr as (select *, sum(case when "on" is distinct from p then 1 else 0 end) over (partition by asset order by t rows unbounded preceding) as run from (select *, lag("on") over (partition by asset order by t) as p from running)),
    st as (select asset, min(t) as s, (max(t) - min(t)) / 3600000000.0 as hours from rr where not "on" and run > 1 group by asset, run having max(t) - min(t) >= 7200000000), o as (select i - 1 as i, (i - 4) * 3600000000 as o from range(1, 8) x(i)),
    told as (select i, o, st.asset, s, hours, tag, min(a.t + o) as first from st join alarms a on a.asset = st.asset and a.condition in ('HI', 'HIHI') join o on a.t + o between s - 3600000000 and s + 1800000000 group by all),
    trip as (select i, o, asset, s, hours, array_to_string(list(tag order by first, tag)[1:3], ' | ') as texts from told group by all), best as (select i from trip group by i order by count(*) desc, i limit 1),
    ch as (select *, sum(case when s - p < 86400000000 then 0 else 1 end) over (partition by asset order by s rows unbounded preceding) as e from (select *, lag(s) over (partition by asset order by s) as p from trip where i = (select i from best))),
    fail as (select asset, min(s) as event, max(hours) as hours, count(*) - 1 as repeats, arg_min(texts, s) as texts, o // 3600000000 as offset_h from ch group by asset, e, o)"""


def failures(spark: SparkSession, d: str) -> DataFrame:
    """(asset, event, hours, repeats, texts, offset_h): stops of two hours or more that level alarms announce."""
    r = episodes.runs(T.running(spark, d), ["asset"], "on")
    stops = r.where("not on").groupBy("asset", "run").agg(F.min("t").alias("start"), ((F.max("t") - F.min("t")) / float(HOUR)).alias("hours"))
    first = r.groupBy("asset").agg(F.min("run").alias("_r"))
    stops = stops.where("hours >= 2").join(first, "asset").where("run > _r").select("asset", "start", "hours")  # what a series begins with has no start
    level = T.alarms(spark, d).where("condition in ('HI', 'HIHI')").withColumnRenamed("tag", "text")
    f = evaluate.failures(stops, level, ["asset"], _OFFSETS, HOUR, 30 * MINUTE, DAY)
    return f.select("asset", "event", "hours", "repeats", F.concat_ws(" | ", "texts").alias("texts"), (F.col("offset") / HOUR).cast("long").alias("offset_h"))


@query("k13_announced_failures", f"""with {_FAILURES} select asset, event, round(hours, 6) as hours, repeats, texts, offset_h from fail""")
def k13(spark: SparkSession, d: str) -> DataFrame:
    return failures(spark, d).withColumn("hours", r6("hours"))


_SIGNALS = f"""{_FAILURES}, f as (select asset, event as t, texts, case when contains(texts, 'T0') then 'bearing' when contains(texts, 'T1') then 'seal' when contains(texts, 'T2') then 'oil' else '?' end as mode from fail),
    lim as (select unnest([{', '.join(f"'{k}'" for k in _LIMITS)}]) as tag, unnest([{', '.join(map(str, _LIMITS.values()))}]) as lim), u as (select r.*, lim, value > lim as up from readings r join lim using (tag)),
    h as (select *, up and coalesce(lag(up) over ({_P}), false) as held from u),
    sig as (select f.asset, f.t, f.mode, h.tag, count(value) as points, max(value / lim) as peak, bool_or(held) as sustained, min(h.t) filter (where held) as first from f join h on h.asset = f.asset and h.t between f.t - {2 * DAY} and f.t group by all)"""


def _attributed(spark: SparkSession, d: str) -> DataFrame:
    limit = F.create_map(*(F.lit(x) for k in _LIMITS.items() for x in k))
    rows = T.readings(spark, d).withColumn("limit", F.try_element_at(limit, "tag")).where("limit is not null").withColumn("up", F.col("value") > F.col("limit"))
    rows = scans.scan(rows, KEYS, {"_p": scans.known(F.col("up"))}, inclusive=False).withColumn("held", F.col("up") & F.coalesce("_p", F.lit(False)))
    events = failures(spark, d).select("asset", F.col("event").alias("t"), evaluate.text_mode(F.col("texts"), _MODES).alias("mode"))
    return evaluate.signal_attribution(rows, events, ["asset"], "tag", 2 * DAY)


@query("k29_signals_per_failure", f"""with {_SIGNALS} select asset, t, mode, tag, points, round(peak, 6) as peak, sustained, first from sig""")
def k29(spark: SparkSession, d: str) -> DataFrame:
    return _attributed(spark, d).withColumn("peak", r6("peak"))


@query("k29_failure_modes", f"""with {_SIGNALS}, e as (select asset, t, mode, min(first) as first, arg_min(tag, [first, ascii(tag)]) filter (where first is not null) as head from sig group by all), n as (select mode, head, count(*) as n from e where head is not null group by all)
    select mode, count(*) as events, count(first) as detected, round(quantile_cont((t - first) / 3.6e9, 0.5), 6) as lead_h, (select head from n where n.mode = e.mode order by n desc, head limit 1) as first_signal from e group by mode""")
def k29_modes(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.modes(_attributed(spark, d), ["asset"], "mode", "tag").withColumn("lead_h", r6("lead_h"))


_FIT_END = 1705708800000000

_CELLS = f"""{T.INCIDENTS}, {T.BINS}, x as (select a.asset, a.t, a.value as y, b.value as load, c.value as oil, a.t < {_FIT_END} and not exists (select 1 from incidents i where i.asset = a.asset and i.t between a.t and a.t + 21600000000) as fit from bins a join bins b using (asset, t) join bins c using (asset, t) where a.tag = 'click' and b.tag = 'view' and c.tag = 'purchase'),
    q as (select asset, [{', '.join(f'quantile_cont(load, {i}/4.0)' for i in (1, 2, 3))}] as ql, [{', '.join(f'quantile_cont(oil, {i}/3.0)' for i in (1, 2))}] as qo, quantile_cont(y, 0.5) as whole from x where fit group by asset),
    c as (select x.*, whole, len(list_filter(ql, lambda e: e <= load)) as i, len(list_filter(qo, lambda e: e <= oil)) as j from x left join q using (asset)),
    m as (select asset, i, j, quantile_cont(y, 0.5) as own from c where fit group by all), r as (select c.*, coalesce(own, whole) as expected, y - coalesce(own, whole) as residual from c left join m using (asset, i, j))"""


def _celled(spark: SparkSession, d: str) -> DataFrame:
    b = T.bins(spark, d)
    one = lambda tag, name: b.where(F.col("tag") == tag).select("asset", "t", F.col("value").alias(name))
    x = one("click", "y").join(one("view", "load"), ["asset", "t"]).join(one("purchase", "oil"), ["asset", "t"])
    x = clean.near_events(x, T.incidents(spark, d), ["asset"], 6 * HOUR, 0, "bad").withColumn("fit", (F.col("t") < _FIT_END) & ~F.col("bad"))
    return models.cell_residual(x, ["asset"], {"load": 4, "oil": 3}, "y", "fit")


@query("k31_cells_of_two_axes", f"""with {_CELLS} select asset, t, i, j, round(expected, 6) as expected, round(residual, 6) as residual from r""")
def k31(spark: SparkSession, d: str) -> DataFrame:
    r = _celled(spark, d)
    return r.select("asset", "t", F.get("cell", F.lit(0)).cast("long").alias("i"), F.get("cell", F.lit(1)).cast("long").alias("j"), r6("expected").alias("expected"), r6("residual").alias("residual"))


@query("k31_cell_residual_by_period", f"""with {_CELLS} select asset, t // {5 * DAY} as period, count(*) as n, round(quantile_cont(residual, 0.5), 6) as residual, round(stddev_samp(residual), 6) as sd, round(quantile_cont(y, 0.5), 6) as plain from r group by asset, period""")
def k31_periods(spark: SparkSession, d: str) -> DataFrame:
    g = _celled(spark, d).groupBy("asset", F.floor(F.col("t") / (5 * DAY)).cast("long").alias("period"))
    return g.agg(F.count("*").alias("n"), r6(F.percentile("residual", 0.5)).alias("residual"), r6(F.stddev_samp("residual")).alias("sd"), r6(F.percentile("y", 0.5)).alias("plain"))


_LEVELS, _HOLDS = [30, 50, 70, 90], [1, 2, 3]
_W = 8 * HOUR

_GRID = f"""{T.INCIDENTS}, {T.READINGS}, lv as (select unnest({_LEVELS}) as y), s as (select y, asset, t, row_number() over w as k, case when value > y then 0 else row_number() over w end as off from readings cross join lv where tag = 'purchase' window w as (partition by y, asset order by t)),
    u as (select y, asset, t, k - max(off) over (partition by y, asset order by t rows unbounded preceding) as run from s), a as (select y * 10 + n as cfg, asset, t from u join (select unnest({_HOLDS}) as n) on run >= n),
    ep as (select cfg, asset, min(t) as s, max(t) as b from (select *, sum(case when t - p <= 21600000000 then 0 else 1 end) over (partition by cfg, asset order by t rows unbounded preceding) as e from (select *, lag(t) over (partition by cfg, asset order by t) as p from a)) group by cfg, asset, e),
    span as (select (max(t) - min(t)) / 8.64e10 as days from readings), cf as (select distinct cfg from ep),
    h as (select cf.cfg, i.asset, i.t, (select min(s) from ep where ep.cfg = cf.cfg and ep.asset = i.asset and s <= i.t and b >= i.t - {_W}) as s from incidents i cross join cf),
    tc as (select cfg, asset, s, (select count(*) from incidents i where i.asset = ep.asset and s <= i.t and b >= i.t - {_W}) as n, (select min(i.t) from incidents i where i.asset = ep.asset and s <= i.t and b >= i.t - {_W}) as one from ep),
    cost as (select h.cfg, h.asset, h.t, (select count(*) from tc where tc.cfg = h.cfg and (n = 0 or (n = 1 and tc.asset = h.asset and one = h.t))) as f from h),
    tb as (select cfg, h.asset || '-' || h.t as event, h.s is not null as hit, coalesce((h.t - h.s) / 3.6e9, 0) as lead, f / days as cost from h join cost using (cfg, asset, t), span)"""


def _settings(spark: SparkSession, d: str) -> DataFrame:
    """(config, event, hit, lead, cost) of levels and numbers of rows in a row, false episodes a day as cost."""
    readings, incidents = T.readings(spark, d), T.incidents(spark, d)
    rows = readings.where("tag = 'purchase'").withColumn("y", F.explode(F.array(*map(F.lit, _LEVELS)))).withColumn("up", F.col("value") > F.col("y"))
    runs = episodes.runs(rows, ["y", "asset"], "up")
    k = F.row_number().over(Window.partitionBy("y", "asset", "run").orderBy("t"))
    on = runs.where("up").withColumn("k", k).withColumn("n", F.explode(F.array(*map(F.lit, _HOLDS)))).where("k >= n").select((F.col("y") * 10 + F.col("n")).alias("config"), "asset", "t")
    ep = episodes.episodes(on, ["config", "asset"], 6 * HOUR)
    windows = incidents.select("asset", (F.col("t") - _W).alias("a"), F.col("t").alias("b"))
    hits = align.overlaps(ep, windows, ["asset"], DAY).groupBy("config", "asset", F.col("b").alias("t")).agg(F.min("start").alias("s"))
    cost = evaluate.left_out_costs(ep, incidents, ["asset"], ["config"], _W, DAY)
    days = readings.agg(((F.max("t") - F.min("t")) / 8.64e10).alias("days"))
    table = cost.join(hits, ["config", "asset", "t"], "left").join(F.broadcast(days))  # one row
    lead = F.coalesce((F.col("t") - F.col("s")) / 3.6e9, F.lit(0.0))
    return table.select("config", F.concat_ws("-", "asset", "t").alias("event"), F.col("s").isNotNull().alias("hit"), lead.alias("lead"), (F.col("false") / F.col("days")).alias("cost"))


@query("k32_five_criteria", f"""with {_GRID}, f as (select *, sum(hit::int) over (partition by cfg) - hit::int as found, (sum(lead) over (partition by cfg) - lead) / (count(*) over (partition by cfg) - 1) as ml from tb),
    nb as (select f.cfg, f.event, min(o.found) as least, count(*) filter (where o.found >= f.found) as plateau from f join f o on o.event = f.event and ((o.cfg % 10 = f.cfg % 10 and abs(o.cfg - f.cfg) = 200) or (o.cfg // 10 = f.cfg // 10 and abs(o.cfg - f.cfg) = 1)) group by all),
    g as (select f.*, least(found, coalesce(least, found)) as worst, coalesce(plateau, 0) as plateau from f left join nb using (cfg, event)),
    sc as (select event, cfg, hit, cost <= 6 as ok, unnest(['found', 'worst', 'plateau', 'found_lead', 'worst_lead']) as criterion, unnest([found * 1000.0 - cost, worst * 1000.0 - cost, found * 1000.0 + plateau * 10.0 - cost, found * 1000.0 + ml, worst * 1000.0 + ml]) as score from g),
    pick as (select * from (select *, row_number() over (partition by criterion, event order by round(score, 9) desc, cfg) as k from sc where ok) where k = 1)
    select criterion, coalesce((select count(*) from pick where pick.criterion = sc.criterion and hit), 0) as hits, count(distinct event) as events from sc group by criterion""")
def k32(spark: SparkSession, d: str) -> DataFrame:
    grid = [(y * 10 + n, z * 10 + m) for i, y in enumerate(_LEVELS) for j, n in enumerate(_HOLDS) for p, z in enumerate(_LEVELS) for q, m in enumerate(_HOLDS) if abs(i - p) + abs(j - q) == 1]
    beside = spark.createDataFrame(grid, "config int, other int")
    return evaluate.robust_selection(_settings(spark, d), beside, "config", "event", "cost", 6.0)


@query("j16_reference_of_400_hours", f"""with {T.READINGS}, b as (select distinct asset, tag, t // 21600000000 as block from readings), tr as (select b.asset, b.tag, b.block, r.value as x from b join readings r on r.asset = b.asset and r.tag = b.tag and r.value > 5 and r.t < b.block * 21600000000 - {DAY} and r.t >= b.block * 21600000000 - {424 * HOUR}),
    m as (select asset, tag, block, quantile_cont(x, 0.5) as m, count(*) as n from tr group by all), s as (select m.asset, m.tag, m.block, m, n, quantile_cont(abs(x - m), 0.5) as mad from m join tr using (asset, tag, block) group by all)
    select r.asset, r.tag, r.t, round(case when n >= 20 and mad > 0 then (value - m) / (1.4826 * mad) end, 6) as z from readings r left join s on s.asset = r.asset and s.tag = r.tag and s.block = r.t // 21600000000""")
def j16(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d).withColumn("ok", F.col("value") > 5)
    return models.guarded_z(rows, 6 * HOUR, DAY, 424 * HOUR, 20, usable="ok").select(*KEYS, "t", r6("z").alias("z"))
