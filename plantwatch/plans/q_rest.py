"""Queries: curves over every tag, the detector ruler, nulls, search cost, walk-forward variants, states of a value, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantwatch.functions.columns import DAY, HOUR, floor_to
from plantwatch.operators import align, clean, episodes, evaluate, models, quantiles, state
from plantwatch.operators.lineage import cut_lineage
from plantwatch.plans import tables as T
from plantwatch.plans.q_clean import r6
from plantwatch.plans.q_eval import _ALERTS, _CURVE, _LABEL, _LOAD, _P, _grid_alerts, alerts, curve, labelled, loaded, per_day
from plantwatch.plans.q_series import KEYS
from plantwatch.plans.registry import query

_TAIL = lambda x: x.removeprefix(T.READINGS + ", ")
_DAYS = "(select (max(t) - min(t)) / 8.64e10 from readings)"


def _curve_sql(alerts_sql: str, c: str) -> str:
    """CTEs after `incidents` and `readings`: curve(c..., recall, lead_h, episodes, false_per_day) of alerts (c..., asset, t)."""
    same = " and ".join(f"a.{x} = i.{x}" for x in c.split(", "))
    return f"""a as ({alerts_sql}), cf as (select distinct {c} from a),
    mm as (select i.*, (select min(a.t) from a where {same} and a.asset = i.asset and a.t between i.t - 28800000000 and i.t) as first from (select * from incidents cross join cf) i),
    e as (select *, sum(case when t - p <= 21600000000 then 0 else 1 end) over (partition by {c}, asset order by t rows unbounded preceding) as e from (select *, lag(t) over (partition by {c}, asset order by t) as p from a)), ep as (select {c}, asset, e, min(t) as es, max(t) as eb from e group by all),
    fl as (select {c}, count(*) as n, count(*) filter (where not exists (select 1 from incidents i where i.asset = ep.asset and ep.es <= i.t and ep.eb >= i.t - 28800000000)) as f from ep group by {c}),
    curve as (select {c}, avg(case when first is not null then 1.0 else 0 end) as recall, quantile_cont((t - first) / 3.6e9, 0.5) as lead_h, any_value(n) as episodes, any_value(f) / {_DAYS} as false_per_day from mm join fl using ({c}) group by {c})"""


def _curve(spark: SparkSession, d: str, said: DataFrame, config: list[str]) -> DataFrame:
    counted = evaluate.predictive_curve(said, T.incidents(spark, d), ["asset"], 8 * HOUR, 6 * HOUR, F.lit(1.0), config)
    return per_day(counted, T.readings(spark, d))


def _while_running(spark: SparkSession, d: str) -> DataFrame:
    """Readings of the hours in which the asset runs."""
    on = T.running(spark, d).where("on").select("asset", F.col("t").alias("hour"))
    return T.readings(spark, d).withColumn("hour", floor_to(F.col("t"), HOUR)).join(on, ["asset", "hour"], "left_semi").drop("hour")


_RUNS = f"""{T.INCIDENTS}, {T.RUNNING}, live as (select r.* from readings r join running g on g.asset = r.asset and g.t = r.t // 3600000000 * 3600000000 where g."on")"""


_PERCENTS = [float(f"{0.999 - s * 0.299 / 149:.12f}") for s in range(150)]


@query("k02_alarm_optimised_threshold", f"""with {T.INCIDENTS}, {T.READINGS}, q as (select tag, unnest(quantile_cont(value, {_PERCENTS})) as y, unnest(generate_series(0, 149)) as s from readings group by tag),
    {_curve_sql("select r.tag, s, asset, t from readings r join q on q.tag = r.tag and r.value > y", "tag, s")}, k as (select *, recall - 0.5 * least(1, false_per_day / 10) as score, recall >= 0.3 and false_per_day <= 2 as ok from curve)
    select tag, s, round(score, 6) as score from (select *, row_number() over (partition by tag order by ok desc, case when ok then s end, round(score, 9) desc, s) as k from k) where k = 1""")
def k02(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d).where("tag is not null")
    y = quantiles.sorted_points(rows, ["tag"], "value", _PERCENTS)  # a row a tag
    # ties of values put a threshold a last bit above the one before, so the thresholds are put in order; k is the place in it
    order = cut_lineage(y.select("tag", F.sort_array(F.transform("points", lambda y, s: F.struct(y.alias("y"), s.cast("long").alias("s"))), asc=False).alias("_o")))
    least = order.select("tag", F.transform("_o", lambda x: x["y"]).alias("_y"))
    said = rows.where("value is not null").join(F.broadcast(least), "tag").where(F.col("value") > F.element_at("_y", -1))
    said = said.withColumn("_l", quantiles.position("_y", len(_PERCENTS), lambda y: y >= F.col("value")))
    found = evaluate.nested_curve(said, T.incidents(spark, d), ["asset"], ["tag"], "_l", len(_PERCENTS), 8 * HOUR, 6 * HOUR)
    found = found.join(order.select("tag", F.posexplode("_o").alias("k", "_o")).select("tag", "k", "_o.s"), ["tag", "k"])
    found = per_day(found.withColumnRenamed("false", "false_per_day"), T.readings(spark, d))
    score, ok = F.col("recall") - 0.5 * F.least(F.lit(1.0), F.col("false_per_day") / 10), (F.col("recall") >= 0.3) & (F.col("false_per_day") <= 2)
    w = Window.partitionBy("tag").orderBy(F.desc(ok.cast("int")), F.when(ok, F.col("s")), F.desc(F.round(score, 9)), "s")
    return found.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("tag", "s", r6(score).alias("score"))


@query("k03_predictive_curve", f"""with {_RUNS}, p as (select tag, avg(value) as mu, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.35 as sd from live group by tag), g as (select unnest(generate_series(0, 19)) as s),
    {_curve_sql("select l.tag, s, asset, t from live l join p using (tag) cross join g where value >= mu + (0.25 + s * 0.25) * sd", "tag, s")} select tag, s, round(recall, 6) as recall, round(lead_h, 6) as lead_h, episodes, round(false_per_day, 6) as false_per_day from curve""")
def k03(spark: SparkSession, d: str) -> DataFrame:
    live = _while_running(spark, d)
    q = quantiles.quantiles(live, ["tag"], "value", {"a": 0.25, "b": 0.75}, within=T.readings(spark, d))
    p = live.groupBy("tag").agg(F.avg("value").alias("mu")).join(q, "tag").select("tag", "mu", ((F.col("b") - F.col("a")) / 1.35).alias("sd"))
    passed = F.filter(F.sequence(F.lit(0), F.lit(19)), lambda s: F.col("value") >= F.col("mu") + (0.25 + s * 0.25) * F.col("sd"))
    said = live.join(p, "tag").withColumn("s", F.explode(passed))
    c = _curve(spark, d, said.select("tag", F.col("s").cast("long").alias("s"), "asset", "t"), ["tag", "s"])
    return c.select("tag", "s", r6("recall").alias("recall"), r6("lead_h").alias("lead_h"), "episodes", r6("false_per_day").alias("false_per_day"))


@query("k04_curve_of_any_tag", f"""with {_RUNS}, p as (select asset, tag, avg(value) as mu, greatest((quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.35, 1e-9) as sd from live group by all), g as (select unnest(generate_series(0, 39)) as s),
    {_curve_sql("select distinct s, l.asset, t from live l join p using (asset, tag) cross join g where value >= mu + (0.5 + s * 4.5 / 39) * sd", "s")} select s, round(recall, 6) as recall, round(lead_h, 6) as lead_h, episodes, round(false_per_day, 6) as false_per_day from curve""")
def k04(spark: SparkSession, d: str) -> DataFrame:
    live = _while_running(spark, d)
    p = live.groupBy(*KEYS).agg(F.avg("value").alias("mu"), F.greatest((F.percentile("value", 0.75) - F.percentile("value", 0.25)) / 1.35, F.lit(1e-9)).alias("sd"))
    top = live.join(p, KEYS).withColumn("_y", (F.col("value") - F.col("mu")) / F.col("sd")).groupBy("asset", "t").agg(F.max(F.struct("_y", "value", "mu", "sd")).alias("m"))
    said = top.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(39)))).where(F.col("m.value") >= F.col("m.mu") + (0.5 + F.col("s") * 4.5 / 39) * F.col("m.sd"))
    c = _curve(spark, d, said.select(F.col("s").cast("long").alias("s"), "asset", "t"), ["s"])
    return c.select("s", r6("recall").alias("recall"), r6("lead_h").alias("lead_h"), "episodes", r6("false_per_day").alias("false_per_day"))


_RULER = f"""{_ALERTS}, {_TAIL(T.RUNNING)}, s as (select g.*, exists (select 1 from a where a.asset = g.asset and a.t between g.t - 14400000000 and g.t) as alert from running g), al as (select asset, t from s where alert),
    e as (select *, sum(case when t - p <= 21600000000 then 0 else 1 end) over (partition by asset order by t rows unbounded preceding) as e from (select *, lag(t) over (partition by asset order by t) as p from al)), ep as (select asset, e, min(t) as "start", max(t) as "end" from e group by all)"""


def _hourly_alerts(spark: SparkSession, d: str) -> DataFrame:
    """(asset, t, on, alert): the hours of each asset, and whether an alert came within four hours before."""
    return clean.near_events(T.running(spark, d), alerts(spark, d), ["asset"], 0, 4 * HOUR, "alert")


@query("k06_detector_ruler", f"""with {_RULER}, m as (select i.asset, i.t, (select min(al.t) from al where al.asset = i.asset and al.t >= i.t - 172800000000 and al.t < i.t) as first from incidents i), seen as (select asset, count(first) as found, count(*) as events, avg((t - first) / 3.6e9) as lead_mean, min((t - first) / 3.6e9) as lead_least from m group by asset),
    n as (select asset, count(*) as episodes, count(*) filter (where not exists (select 1 from incidents i where i.asset = ep.asset and ep."start" <= i.t and ep."end" >= i.t - 172800000000)) as f, sum(("end" - "start" + 3600000000) / 3.6e9) filter (where not exists (select 1 from incidents i where i.asset = ep.asset and ep."start" <= i.t and ep."end" >= i.t - 172800000000)) as h from ep group by asset),
    b as (select asset, count(*) filter (where "on") / 730.0 as months, avg(case when alert then 1.0 else 0 end) as duty from s group by asset)
    select b.asset, coalesce(found, 0) as found, coalesce(events, 0) as events, coalesce(episodes, 0) as episodes, coalesce(f, 0) as "false", round(coalesce(f, 0) / nullif(months, 0), 6) as false_per_month, round(coalesce(h, 0) / nullif(months, 0), 6) as false_hours_per_month, round(lead_mean, 6) as lead_mean, round(lead_least, 6) as lead_least, round(duty, 6) as duty from b left join seen using (asset) left join n using (asset)""")
def k06(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.ruler(_hourly_alerts(spark, d), T.incidents(spark, d), ["asset"], 48 * HOUR, 6 * HOUR, HOUR)
    return out.select("asset", "found", "events", "episodes", "false", *(r6(c).alias(c) for c in ("false_per_month", "false_hours_per_month", "lead_mean", "lead_least", "duty")))


@query("k16_resampled_episodes", f"""with {_RULER}, pool as (select asset, t, row_number() over (partition by asset order by t) - 1 as i, count(*) over (partition by asset) as n from running where "on"), eps as (select asset, row_number() over (partition by asset order by "start") as e, "end" - "start" as len from ep),
    dr as (select eps.*, unnest(generate_series(1, 20)) as draw from eps), x as (select dr.*, ((draw * 7919 + e * 104729) % 1000003 * 48271 + 12345) % (select any_value(n) from pool p where p.asset = dr.asset) as i from dr),
    h as (select x.asset, draw, (select count(*) from incidents c where c.asset = x.asset and c.t between p.t and p.t + len) as k from x join pool p on p.asset = x.asset and p.i = x.i) select asset, cast(draw as integer) as draw, count(*) filter (where k > 0) as hit, cast(sum(k) as bigint) as total from h group by all""")
def k16(spark: SparkSession, d: str) -> DataFrame:
    rows = _hourly_alerts(spark, d)
    eps = episodes.episodes(rows.where("alert").select("asset", "t"), ["asset"], 6 * HOUR)
    return evaluate.resampled_hits(eps, rows.where("on").select("asset", "t"), T.incidents(spark, d), ["asset"], 20)


@query("k22_search_cost", f"""with {_CURVE}, h as (select y, asset || '-' || t as event, first is not null as hit, false_per_day as cost from mm join curve using (y)), r as (select y, draw, row_number() over (partition by draw order by (y * 7919 + draw * 104729) % 1000003 * 48271 + 12345, y) as k from (select distinct y, unnest(generate_series(1, 12)) as draw from h)), z as (select unnest([1, 2, 3, 5, 7]) as size),
    x as (select h.*, size, draw, sum(case when hit then 1 else 0 end) over (partition by size, draw, y) - case when hit then 1 else 0 end as rest from h join r using (y) join z on k <= size), b as (select *, row_number() over (partition by size, draw, event order by rest desc, cost, y) as b from x where cost <= 8),
    f as (select size, draw, count(*) filter (where hit) as hits from b where b = 1 group by all) select size, round(avg(hits), 6) as mean, min(hits) as low, max(hits) as high from f group by size""")
def k22(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.match(_grid_alerts(spark, d), T.incidents(spark, d), ["asset"], 8 * HOUR, 0, ["y"])
    t = m.join(curve(spark, d).select("y", F.col("false_per_day").alias("cost")), "y").select(F.concat_ws("-", "asset", "t").alias("event"), F.col("y").cast("long").alias("y"), F.col("first").isNotNull().alias("hit"), "cost")
    return evaluate.search_cost(t, "y", "event", "cost", 8.0, [1, 2, 3, 5, 7], 12).select("size", r6("mean").alias("mean"), "low", "high")


@query("i30_state_of_a_value", f"""with {T.READINGS}, d as (select *, coalesce(abs(value - lag(value) over ({_P})), 0) as d, t - lag(t) over ({_P}) as dt from readings), l as (select asset, tag, quantile_cont(value, 0.05) as off, quantile_cont(d, 0.99) as jump, greatest(1, ceil(3600000000 * 8 / quantile_cont(dt, 0.5))) as long from d group by all),
    r as (select d.*, off, jump, long, value <= off as is_off from d join l using (asset, tag)), e as (select *, case when is_off <> lag(is_off) over ({_P}) then 1 else 0 end as edge, case when is_off is distinct from lag(is_off) over ({_P}) then 1 else 0 end as new from r), s as (select *, sum(new) over ({_P} rows unbounded preceding) as run, max(edge) over ({_P} range between 1800000000 preceding and 1800000000 following) = 1 as near from e)
    select asset, tag, t, case when is_off then case when count(*) over (partition by asset, tag, run) >= long then 'off_long' else 'off_short' end when near or (jump > 0 and d >= jump) then 'transient' else 'on' end as state from s""")
def i30(spark: SparkSession, d: str) -> DataFrame:
    return state.state_of_value(T.readings(spark, d), KEYS, 8 * HOUR, HOUR // 2).select(*KEYS, "t", "state")


@query("i44_physical_deviation_start", f"""with {T.INCIDENTS}, {T.READINGS}, m as (select r.asset, r.tag, i.t, r.t as u, r.value, r.t < i.t - 172800000000 as early from incidents i join readings r on r.asset = i.asset and r.t between i.t - 604800000000 and i.t), l as (select asset, tag, t, quantile_cont(value, 0.95) as lim from m where early group by all having count(*) >= 20),
    w as (select m.*, sum(case when value > lim then 1 else 0 end) over x = 3 as up, first_value(u) over x as s from m join l using (asset, tag, t) where not early window x as (partition by asset, tag, t order by u rows between 2 preceding and current row)), f as (select asset, tag, t, min(s) as s from w where up group by all)
    select k.asset, k.tag, k.t as incident, round((k.t - s) / 3.6e9, 6) as hours from (select distinct asset, tag, t from m) k left join f using (asset, tag, t)""")
def i44(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.deviation_start(T.readings(spark, d), T.incidents(spark, d), KEYS, ["asset"], 48 * HOUR, 120 * HOUR, 3, 20)
    return out.select(*KEYS, "incident", r6("hours").alias("hours"))


def _walk_sql(rows: str, value: str, period: int, anchor: int, look: int, usable: str = "true") -> str:
    """CTEs: s(asset, tag, p, m, n, mad, sd) of the baselines before each period."""
    return f"""p as (select distinct asset, tag, (t - {anchor}) // {period} as p from {rows}), tr as (select p.asset, p.tag, p.p, r.{value} as x from p join {rows} r on r.asset = p.asset and r.tag = p.tag and r.t < p.p * {period} + {anchor} and r.t >= p.p * {period} + {anchor} - {look} where {usable}),
    m as (select asset, tag, p, quantile_cont(x, 0.5) as m, count(*) as n from tr group by all), s as (select m.asset, m.tag, m.p, m, n, quantile_cont(abs(x - m), 0.5) as mad, stddev_samp(x) as sd from m join tr using (asset, tag, p) group by all)"""


_Z = "round(case when n >= 20 then (r.{value} - m) / case when mad > 0 then 1.4826 * mad else nullif(sd, 0) end end, 6) as z"


@query("j12_clean_baseline", f"""with {T.INCIDENTS}, {T.READINGS}, lab as (select r.*, exists (select 1 from incidents i where i.asset = r.asset and i.t between r.t - 7200000000 and r.t + 43200000000) as bad from readings r), {_walk_sql("lab", "value", 7 * DAY, 0, 14 * DAY, "not r.bad")}
    select r.asset, r.tag, r.t, {_Z.format(value="value")} from lab r left join s on s.asset = r.asset and s.tag = r.tag and s.p = r.t // {7 * DAY}""")
def j12_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = clean.near_events(T.readings(spark, d), T.incidents(spark, d), ["asset"], 12 * HOUR, 2 * HOUR, "bad").withColumn("ok", ~F.col("bad"))
    return models.walk_forward(rows, 7 * DAY, 14 * DAY, 20, usable="ok").select(*KEYS, "t", r6("z").alias("z"))


@query("j12_other_retrain_day", f"""with {T.READINGS}, {_walk_sql("readings", "value", 7 * DAY, 3 * DAY, 14 * DAY)} select r.asset, r.tag, r.t, {_Z.format(value="value")} from readings r left join s on s.asset = r.asset and s.tag = r.tag and s.p = (r.t - {3 * DAY}) // {7 * DAY}""")
def j12_day(spark: SparkSession, d: str) -> DataFrame:
    return models.walk_forward(T.readings(spark, d), 7 * DAY, 14 * DAY, 20, anchor=3 * DAY).select(*KEYS, "t", r6("z").alias("z"))


@query("j12_slower_cadence", f"""with {T.READINGS}, {_walk_sql("readings", "value", 14 * DAY, 0, 14 * DAY)} select r.asset, r.tag, r.t, {_Z.format(value="value")} from readings r left join s on s.asset = r.asset and s.tag = r.tag and s.p = r.t // {14 * DAY}""")
def j12_slow(spark: SparkSession, d: str) -> DataFrame:
    return models.walk_forward(T.readings(spark, d), 14 * DAY, 14 * DAY, 20).select(*KEYS, "t", r6("z").alias("z"))


@query("j12_frozen_baseline", f"""with {T.READINGS}, f as (select asset, tag, min(t) // {DAY} * {DAY} + {10 * DAY} as until from readings group by all), b as (select r.asset, r.tag, until, value as x from readings r join f using (asset, tag) where t < until), m as (select asset, tag, any_value(until) as until, quantile_cont(x, 0.5) as m from b group by all), s as (select m.asset, m.tag, m.until, m, quantile_cont(abs(x - m), 0.5) as mad from m join b using (asset, tag) group by all)
    select r.asset, r.tag, r.t, round(case when r.t >= until then (value - m) / (1.4826 * nullif(mad, 0)) end, 6) as z from readings r join s using (asset, tag)""")
def j12_frozen(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d)
    until = rows.groupBy(*KEYS).agg((floor_to(F.min("t"), DAY) + 10 * DAY).alias("until"))
    fit = rows.join(until, KEYS).where("t < until")
    mid = fit.groupBy(*KEYS, "until").agg(F.percentile("value", 0.5).alias("m"))
    mad = fit.join(mid, [*KEYS, "until"]).groupBy(*KEYS, "until", "m").agg((1.4826 * F.percentile(F.abs(F.col("value") - F.col("m")), 0.5)).alias("s"))
    z = F.when((F.col("t") >= F.col("until")) & (F.col("s") > 0), (F.col("value") - F.col("m")) / F.col("s"))
    return rows.join(mad, KEYS).select(*KEYS, "t", r6(z).alias("z"))


@query("j12_load_residual_first", f"""with {_LOAD}, f as (select asset, regr_slope(y, load) as b, regr_intercept(y, load) as a from x group by asset), res as (select x.asset, 'click' as tag, x.t, y - a - b * load as v from x join f using (asset)), {_walk_sql("res", "v", 7 * DAY, 0, 14 * DAY)}
    select r.asset, r.t, round(case when n >= 20 then (r.v - m) / case when mad > 0 then 1.4826 * mad else nullif(sd, 0) end end, 5) as z from res r left join s on s.asset = r.asset and s.p = r.t // {7 * DAY}""")
def j12_load(spark: SparkSession, d: str) -> DataFrame:
    rows = models.regression_residual(loaded(spark, d), "y", "load", ["asset"])
    return models.walk_forward(rows, 7 * DAY, 14 * DAY, 20, ["asset"], "residual").select("asset", "t", F.round("z", 5).alias("z"))


@query("j12_drift_trigger", f"""with recursive {T.READINGS}, w as (select *, t // {5 * DAY} as p from readings), m as (select asset, tag, p + 1 as b, quantile_cont(value, 0.5) as m, count(*) as n from w group by all), s as (select w.asset, w.tag, b, m, 1.4826 * quantile_cont(abs(value - m), 0.5) as s from w join m on m.asset = w.asset and m.tag = w.tag and m.b = w.p + 1 where n >= 20 group by all having quantile_cont(abs(value - m), 0.5) > 0),
    d as (select w.asset, w.tag, w.p, s.b, avg(case when abs(value - m) > 2 * s then 1.0 else 0 end) as d from w join s on s.asset = w.asset and s.tag = w.tag and s.b <= w.p and s.b > w.p - 4 group by all), o as (select *, row_number() over (partition by asset, tag order by p) as k from (select distinct asset, tag, p from d)),
    r(asset, tag, k, p, b, first, last) as (select asset, tag, cast(0 as bigint), cast(-1 as bigint), cast(null as bigint), cast(null as double), cast(null as double) from (select distinct asset, tag from o)
      union all select c.asset, c.tag, c.k, c.p, c.nb, case when c.nb is not distinct from c.b then c.first else (select d.d from d where d.asset = c.asset and d.tag = c.tag and d.p = c.p and d.b = c.nb) end, (select d.d from d where d.asset = c.asset and d.tag = c.tag and d.p = c.p and d.b = c.nb)
      from (select r.asset, r.tag, o.k, o.p, r.b, r.first, case when coalesce(r.b is null or o.p - r.b >= 4 or r.last > 1.25 * r.first, true) and exists (select 1 from d where d.asset = o.asset and d.tag = o.tag and d.p = o.p and d.b = o.p) then o.p when exists (select 1 from d where d.asset = o.asset and d.tag = o.tag and d.p = o.p and d.b = r.b) then r.b end as nb from r join o on o.asset = r.asset and o.tag = r.tag and o.k = r.k + 1) c)
    select asset, tag, p as period, b as bundle from r where k > 0""")
def j12_trigger(spark: SparkSession, d: str) -> DataFrame:
    return models.drift_trigger(T.readings(spark, d), 5 * DAY, 20, 2.0, 1.25, 4)


@query("k17_enrichment_tests", f"""with {_LABEL}, g as (select tag, count(*) filter (where bad) as near, count(*) as n from lab group by tag), x as (select tag, near, n * sum(near) over () / sum(n) over () as expected, count(*) over () as tests from g), p as (select *, case when near = 0 then 1 else greatest(0, 1 - (select sum(exp(i * ln(expected) - expected - lgamma(i + 1))) from (select unnest(generate_series(0, near - 1)) as i))) end as p from x) select tag, near, round(p, 6) as p, p * tests < 0.05 as stands_out from p""")
def k17_tests(spark: SparkSession, d: str) -> DataFrame:
    g = labelled(spark, d).groupBy("tag").agg(F.count_if("bad").alias("near"), F.count("*").alias("n"))
    whole = g.agg(F.sum("near").alias("a"), F.sum("n").alias("b"), F.count("*").alias("tests"))
    p = evaluate.poisson_tail(F.col("near"), F.col("n") * F.col("a") / F.col("b"))
    return g.crossJoin(F.broadcast(whole)).withColumn("p", p).select("tag", "near", r6("p").alias("p"), (F.col("p") * F.col("tests") < 0.05).alias("stands_out"))


@query("g03_detector_or_and", f"""with {T.BINS}, x as (select asset, t, coalesce(max(value) filter (where tag = 'click') > 60, false) as a, coalesce(max(value) filter (where tag = 'view') > 60, false) as b from bins where tag in ('click', 'view') group by all), y as (select *, max(case when b then 1 else 0 end) over (partition by asset order by t range between 10800000000 preceding and 10800000000 following) = 1 as wide from x) select asset, t, a or b as either, a and b as both, a and wide as confirmed from y""")
def g03(spark: SparkSession, d: str) -> DataFrame:
    level = lambda tag: F.coalesce(F.max(F.when(F.col("tag") == tag, F.col("value"))) > 60, F.lit(False))
    x = T.bins(spark, d).where("tag in ('click', 'view')").groupBy("asset", "t").agg(level("click").alias("a"), level("view").alias("b"))
    wide = F.max("b").over(Window.partitionBy("asset").orderBy("t").rangeBetween(-3 * HOUR, 3 * HOUR))
    return x.select("asset", "t", (F.col("a") | F.col("b")).alias("either"), (F.col("a") & F.col("b")).alias("both"), (F.col("a") & wide).alias("confirmed"))


@query("k28_episode_feature_table", f"""with {_RULER}, r as (select e.asset, e."start", e."end", r.t, r.value, r.tag from ep e join readings r on r.asset = e.asset and r.t between e."start" and e."end"), w as (select e.asset, e."start", avg(case when s."on" then 1.0 else 0 end) as running from ep e join s on s.asset = e.asset and s.t between e."start" and e."end" group by all),
    g as (select asset, "start", ("end" - "start") / 3.6e9 as hours, max(value) as peak, quantile_cont(value, 0.5) as middle, count(distinct tag) as channels, regr_slope(value, (t - "start") / 3.6e9) filter (where t <= "start" + 10800000000) as slope from r group by asset, "start", "end")
    select g.asset, g."start", round(hours, 6) as hours, round(peak, 6) as peak, round(middle, 6) as middle, channels, round(slope, 4) as slope, round(running, 6) as running, case when exists (select 1 from incidents i where i.asset = g.asset and g."start" <= i.t and g."start" + hours * 3.6e9 >= i.t - 28800000000) then 'TP' else 'FP' end as class from g join w on w.asset = g.asset and w."start" = g."start" """)
def k28_table(spark: SparkSession, d: str) -> DataFrame:
    hourly = _hourly_alerts(spark, d)
    ep = episodes.episodes(hourly.where("alert").select("asset", "t"), ["asset"], 6 * HOUR).select("asset", "start", "end")
    day = F.explode(F.sequence(floor_to(F.col("start"), DAY), floor_to(F.col("end"), DAY), F.lit(DAY)))
    own = ep.withColumn("_k", day)  # a row a day that the episode touches, so that the join is an equi-join
    inside = F.col("t").between(F.col("start"), F.col("end"))
    r = own.join(T.readings(spark, d).withColumn("_k", floor_to(F.col("t"), DAY)), ["asset", "_k"]).where(inside)
    hour = (F.col("t") - F.col("start")) / 3.6e9
    g = r.groupBy("asset", "start", "end").agg(F.max("value").alias("peak"), F.percentile("value", 0.5).alias("middle"), F.count_distinct("tag").alias("channels"), F.regr_slope(F.when(hour <= 3, F.col("value")), hour).alias("slope"))
    w = own.join(hourly.withColumn("_k", floor_to(F.col("t"), DAY)), ["asset", "_k"]).where(inside).groupBy("asset", "start").agg(F.avg(F.col("on").cast("double")).alias("running"))
    spans = T.incidents(spark, d).select("asset", (F.col("t") - 8 * HOUR).alias("a"), F.col("t").alias("b"))
    hit = align.overlaps(ep, spans, ["asset"], DAY).select("asset", "start").distinct().withColumn("tp", F.lit(True))
    out = g.join(w, ["asset", "start"]).join(hit, ["asset", "start"], "left")
    return out.select("asset", "start", r6((F.col("end") - F.col("start")) / 3.6e9).alias("hours"), r6("peak").alias("peak"), r6("middle").alias("middle"), "channels", F.round("slope", 4).alias("slope"), r6("running").alias("running"), F.when(F.col("tp"), "TP").otherwise("FP").alias("class"))
