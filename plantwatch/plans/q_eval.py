"""Queries: models, evaluation, sweeps, operating points, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantwatch.functions import columns as C
from plantwatch.functions.columns import DAY, HOUR
from plantwatch.operators import align, episodes, evaluate, models, quantiles, rolling
from plantwatch.plans import tables as T
from plantwatch.plans.q_clean import r6
from plantwatch.plans.q_series import _EPISODES, KEYS, W, alert_episodes
from plantwatch.plans.q_state import _Z, z_scores
from plantwatch.plans.registry import query

_P = "partition by asset, tag order by t"
_WIN = f"""{T.READINGS}, n as (select *, row_number() over ({_P}) - 1 as k, list(value) over ({_P} rows between current row and 15 following) as x, max(t) over ({_P} rows between current row and 15 following) as e from readings),
    win as (select asset, tag, k // 8 as seq, t as start, e as "end", x from n where len(x) = 16 and k % 8 = 0)"""


def windows(spark: SparkSession, d: str) -> DataFrame:
    return models.windows(T.readings(spark, d), 16, 8)


@query("j01_windows", f"""with {_WIN} select asset, tag, seq, start, "end", round(list_sum(x), 6) as total from win""")
def j01(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return windows(spark, d).select(*KEYS, "seq", "start", "end", r6(total).alias("total"))


@query("j02_temporal_split", f"""with {_WIN} select asset, tag, seq, row_number() over (partition by asset, tag order by seq) > count(*) over (partition by asset, tag) - floor(count(*) over (partition by asset, tag) * 0.2) as validation from win""")
def j02(spark: SparkSession, d: str) -> DataFrame:
    return models.split(windows(spark, d), 0.2).select(*KEYS, "seq", "validation")


@query("j03_window_error", f"""with {_WIN} select asset, tag, seq, round(list_avg(list_transform(x, lambda v: abs(v - list_avg(x)))) + 1e-9, 4) as mae, round(list_avg(list_transform(x, lambda v: power(v - list_avg(x), 2))) + 1e-9, 4) as mse from win""")
def j03(spark: SparkSession, d: str) -> DataFrame:
    return windows(spark, d).select(*KEYS, "seq", F.round(models.window_error(F.col("x")) + 1e-9, 4).alias("mae"), F.round(models.window_error(F.col("x"), squared=True) + 1e-9, 4).alias("mse"))


@query("j04_score_with_stored_statistics", f"""with {T.READINGS}, p as (select asset, tag, quantile_cont(value, 0.5) as c, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as s from readings where t < 1705276800000000 group by all), w as (select r.*, abs(value - c) / s as e from readings r join p using (asset, tag))
    select asset, tag, t, round(avg(e) over ({_P} rows between 5 preceding and current row), 6) as score, count(*) over ({_P} rows between 5 preceding and current row) = 6 and avg(e) over ({_P} rows between 5 preceding and current row) > 1 as is_anom from w""")
def j04(spark: SparkSession, d: str) -> DataFrame:
    from plantwatch.operators import clean

    rows = T.readings(spark, d)
    z = clean.normalize(rows, clean.scales(rows.where("t < 1705276800000000")))
    w = rolling.back(6)
    e = F.avg(F.abs("z")).over(w)
    return z.select(*KEYS, "t", r6(e).alias("score"), ((F.count("*").over(w) == 6) & (e > 1)).alias("is_anom"))


@query("j05_production_alerting", f"""with {T.RUNNING}, e as (select a.asset, a.tag, a.t, sum(b.value * power(0.5, (a.t - b.t) / 21600000000.0)) / sum(power(0.5, (a.t - b.t) / 21600000000.0)) as m from readings a join readings b on a.asset = b.asset and a.tag = b.tag and b.t <= a.t group by all),
    s as (select asset, tag, greatest(1, round(3600000000 / quantile_cont(dt, 0.5))) as need from (select *, t - lag(t) over ({_P}) as dt from readings) group by all),
    f as (select e.*, m >= 60 and coalesce(r."on", false) as up from e left join running r on r.asset = e.asset and r.t = e.t // 3600000000 * 3600000000), g as (select *, sum(case when up is distinct from p then 1 else 0 end) over ({_P} rows unbounded preceding) as run from (select *, lag(up) over ({_P}) as p from f))
    select asset, tag, t, up and count(*) over (partition by asset, tag, run) >= need as alert from g join s using (asset, tag)""")
def j05(spark: SparkSession, d: str) -> DataFrame:
    from plantwatch.functions.columns import floor_to
    from plantwatch.plans.detector import points_of, smoothed_alerts

    on = T.running(spark, d).select("asset", F.col("t").alias("hour"), ~F.col("on")).toDF("asset", "hour", "off")
    rows = points_of(T.readings(spark, d), HOUR).withColumn("hour", floor_to(F.col("t"), HOUR)).join(on, ["asset", "hour"], "left")
    return smoothed_alerts(rows, 6 * HOUR, 60.0, "points", off=F.coalesce("off", F.lit(True))).select(*KEYS, "t", "alert")


@query("j06_calibrated_threshold", f"""with {_Z} select asset, tag, round(avg(value) + 3 * stddev_pop(value), 6) as k_sigma, round(quantile_cont(value, 0.95), 6) as q95, round((quantile_cont(value, 0.95) - avg(value)) / stddev_pop(value), 6) as equivalent_k from zs where t < 1705276800000000 group by all""")
def j06(spark: SparkSession, d: str) -> DataFrame:
    g = T.readings(spark, d).where("t < 1705276800000000").groupBy(*KEYS)
    q, mu, sd = F.percentile("value", 0.95), F.avg("value"), F.stddev_pop("value")
    return g.agg(r6(mu + 3 * sd).alias("k_sigma"), r6(q).alias("q95"), r6((q - mu) / sd).alias("equivalent_k"))


@query("j07_pca_residual")
def j07(spark: SparkSession, d: str) -> DataFrame:
    return models.pca_residual_of_vectors(T.table(spark, d, "embeddings"), "embedding", 0.8).select("vec_id", r6("residual").alias("residual"))


@query("j09_mahalanobis")
def j09(spark: SparkSession, d: str) -> DataFrame:
    return models.mahalanobis_of_vectors(T.table(spark, d, "embeddings"), "embedding").select("vec_id", r6("distance").alias("distance"))


_WEEK = "604800000000"


@query("j10_walk_forward", f"""with {T.READINGS}, p as (select distinct asset, tag, t // {_WEEK} as p from readings), tr as (select p.asset, p.tag, p.p, r.value as x from p join readings r on r.asset = p.asset and r.tag = p.tag and r.t < p.p * {_WEEK} and r.t >= p.p * {_WEEK} - 1209600000000), m as (select asset, tag, p, quantile_cont(x, 0.5) as m, count(*) as n from tr group by all),
    s as (select m.asset, m.tag, m.p, m, n, quantile_cont(abs(x - m), 0.5) as mad, stddev_samp(x) as sd from m join tr on tr.asset = m.asset and tr.tag = m.tag and tr.p = m.p group by all)
    select r.asset, r.tag, r.t, round(case when n >= 20 then (value - m) / case when mad > 0 then 1.4826 * mad else nullif(sd, 0) end end, 6) as z from readings r left join s on s.asset = r.asset and s.tag = r.tag and s.p = r.t // {_WEEK}""")
def j10(spark: SparkSession, d: str) -> DataFrame:
    return models.walk_forward(T.readings(spark, d), 7 * DAY, 14 * DAY, 20).select(*KEYS, "t", r6("z").alias("z"))


@query("j13_baseline_homogeneity", f"""with {_Z}, h as (select *, ntile(2) over ({_P}) as half from zs) select asset, tag, round(quantile_cont(abs(z), 0.99) filter (where half = 2) / quantile_cont(abs(z), 0.99) filter (where half = 1), 6) as ratio from h group by all""")
def j13(spark: SparkSession, d: str) -> DataFrame:
    h = z_scores(spark, d).withColumn("half", F.ntile(2).over(W()))
    q = lambda k: F.percentile(F.when(F.col("half") == k, F.abs("z")), 0.99)
    return h.groupBy(*KEYS).agg(r6(q(2) / q(1)).alias("ratio"))


@query("j14_bearing_spread", f"""with {T.BINS}, o as (select a.asset, a.tag, a.t, any_value(a.value) - quantile_cont(b.value, 0.5) as spread from bins a join bins b on a.asset = b.asset and a.t = b.t and a.tag <> b.tag group by all), m as (select asset, tag, quantile_cont(spread, 0.5) as m from o group by all), q as (select o.asset, o.tag, m, quantile_cont(abs(spread - m), 0.5) as mad from o join m using (asset, tag) group by all) select o.asset, o.tag, o.t, round(abs((spread - m) / nullif(mad, 0)), 6) as z from o join q using (asset, tag)""")
def j14(spark: SparkSession, d: str) -> DataFrame:
    s = rolling.sibling_spread(T.bins(spark, d), ["asset", "t"], "tag")
    m = s.groupBy(*KEYS).agg(F.percentile("spread", 0.5).alias("m"))
    q = s.join(m, KEYS).groupBy(*KEYS, "m").agg(F.percentile(F.abs(F.col("spread") - F.col("m")), 0.5).alias("mad"))
    return s.join(q, KEYS).select(*KEYS, "t", r6(F.abs(F.when(F.col("mad") != 0, (F.col("spread") - F.col("m")) / F.col("mad")))).alias("z"))


@query("j17_sidak_ratio", f"""with {T.BINS}, q as (select asset, tag, quantile_cont(value, power(1 - 0.05, 1.0 / 5)) as q from bins group by all), r as (select b.*, value / q as ratio from bins b join q using (asset, tag) where q > 0) select asset, t, round(max(ratio), 6) as ratio, arg_max(tag, [ratio, -ascii(tag)]) as culprit from r group by all""")
def j17(spark: SparkSession, d: str) -> DataFrame:
    r = rolling.sidak_ratio(T.bins(spark, d), ["asset", "t"], "tag", "value", 0.05)
    return r.groupBy("asset", "t").agg(r6(F.max("ratio")).alias("ratio"), F.max_by("tag", F.struct("ratio", -F.ascii("tag"))).alias("culprit"))


_LOAD = f"""{T.BINS}, x as (select a.asset, a.t, a.value as y, c.value as load from bins a join bins c using (asset, t) where a.tag = 'click' and c.tag = 'view')"""


def loaded(spark: SparkSession, d: str) -> DataFrame:
    wide = align.aligned(T.bins(spark, d).where("tag in ('view', 'click')"), ["asset", "t"], ["view", "click"])
    return wide.select("asset", "t", F.col("click").alias("y"), F.col("view").alias("load"))


@query("j18_regression_residual", f"""with {_LOAD}, f as (select asset, regr_slope(y, load) as b, regr_intercept(y, load) as a from x group by asset) select asset, t, round(y - a - b * load, 6) as residual from x join f using (asset)""")
def j18(spark: SparkSession, d: str) -> DataFrame:
    return models.regression_residual(loaded(spark, d), "y", "load", ["asset"]).select("asset", "t", r6("residual").alias("residual"))


@query("j19_quadratic_load_residual", f"""with {_LOAD}, s as (select asset, count(*)::double as s0, sum(load) as s1, sum(load * load) as s2, sum(power(load, 3)) as s3, sum(power(load, 4)) as s4, sum(y) as m0, sum(y * load) as m1, sum(y * load * load) as m2 from x group by asset),
    w as (select *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) as d from s), b as (select asset, (m0 * (s2 * s4 - s3 * s3) - s1 * (m1 * s4 - s3 * m2) + s2 * (m1 * s3 - s2 * m2)) / d as b0, (s0 * (m1 * s4 - s3 * m2) - m0 * (s1 * s4 - s3 * s2) + s2 * (s1 * m2 - m1 * s2)) / d as b1, (s0 * (s2 * m2 - m1 * s3) - s1 * (s1 * m2 - m1 * s2) + m0 * (s1 * s3 - s2 * s2)) / d as b2 from w)
    select x.asset, x.t, round(y - b0 - b1 * load - b2 * load * load, 4) as residual from x join b using (asset)""")
def j19(spark: SparkSession, d: str) -> DataFrame:
    return models.quadratic_residual(loaded(spark, d), "y", "load", ["asset"]).select("asset", "t", F.round("residual", 4).alias("residual"))


_SPREAD = "list_sum(list_transform(x, lambda v: power(v - list_avg(x), 2)))"
_LAG = lambda k: f"round(list_sum(list_transform(range(1, {17 - k}), lambda i: (x[i] - list_avg(x)) * (x[i + {k}] - list_avg(x)))) / nullif({_SPREAD}, 0), 6) as lag{k}"
_MOMENT = lambda k: f"list_avg(list_transform(x, lambda v: power(v - list_avg(x), {k})))"


@query("j20_window_statistics", f"""with {_WIN} select asset, tag, seq, round(list_avg(x), 6) as mean, round(list_stddev_pop(x), 6) as std, list_min(x) as low, list_max(x) as top, round(list_max(x) - list_min(x), 6) as "range",
    {_LAG(1)}, {_LAG(2)}, round(list_sum(list_transform(range(1, 17), lambda i: (i - 8.5) * (x[i] - list_avg(x)))) / 340, 6) as slope, {', '.join(f"round(list_aggregate(x, 'quantile_cont', {q}), 6) as p{round(100 * q)}" for q in (0.1, 0.25, 0.75, 0.9))},
    round({_MOMENT(3)} / power(nullif({_MOMENT(2)}, 0), 1.5), 6) as skew, round({_MOMENT(4)} / power(nullif({_MOMENT(2)}, 0), 2) - 3, 6) as kurt from win""")
def j20(spark: SparkSession, d: str) -> DataFrame:
    s = models.window_statistics(F.col("x"))
    return windows(spark, d).select(*KEYS, "seq", *((c if k in ("low", "top") else r6(c)).alias(k) for k, c in s.items()))


@query("j21_isolation_forest")
def j21(spark: SparkSession, d: str) -> DataFrame:
    s = models.window_statistics(F.col("x"))
    feats = windows(spark, d).select(F.concat_ws("/", *KEYS, "seq").alias("window"), *(F.coalesce(c, F.lit(0.0)).alias(k) for k, c in s.items()))
    return models.isolation_scores(feats, list(s), "window", trees=200).select("window", r6("score").alias("score"))


@query("j22_nearest_template", """with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as x from embeddings), p as (select a.vec_id, b.vec_id as template, list_avg(list_transform(range(1, len(a.x) + 1), lambda i: power(a.x[i] - b.x[i], 2))) as dist from v a join v b on b.vec_id < 5)
    select vec_id, arg_min(template, [dist, template]) as template, round(min(dist), 6) as distance from p group by vec_id""")
def j22(spark: SparkSession, d: str) -> DataFrame:
    v = T.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    t = v.where("vec_id < 5").select(F.col("vec_id").alias("template"), F.col("x").alias("y"))
    return models.nearest_template(v, t).select("vec_id", "template", r6("distance").alias("distance"))


_LABEL = f"""{T.INCIDENTS}, {T.READINGS}, lab as (select r.asset, r.tag, r.t, r.value, exists (select 1 from incidents i where i.asset = r.asset and i.t between r.t and r.t + 21600000000) as bad from readings r)"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    from plantwatch.operators.clean import near_events

    return near_events(T.readings(spark, d), T.incidents(spark, d), ["asset"], 6 * HOUR, 0, "bad")


@query("j23_auc_per_sensor", f"""with {_LABEL}, k as (select *, rank() over (partition by tag order by value) + (count(*) over (partition by tag, value) - 1) / 2.0 as r from lab) select tag, round((sum(r) filter (where bad) - count(*) filter (where bad) * (count(*) filter (where bad) + 1) / 2.0) / (count(*) filter (where bad) * count(*) filter (where not bad)), 6) as auc from k group by tag""")
def j23(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.auc(labelled(spark, d), ["tag"], "value", "bad").withColumn("auc", r6("auc"))


@query("j23_best_f1", f"""with {_LABEL}, q as (select tag, unnest(list_distinct(quantile_cont(value, [{', '.join(f'{i}/60.0' for i in range(1, 60))}]))) as thr from lab group by tag), f as (select tag, thr, 2.0 * count(*) filter (where value > thr and bad) / (count(*) filter (where value > thr) + count(*) filter (where bad)) as f1 from lab join q using (tag) group by all)
    select tag, round(thr, 6) as threshold, round(f1, 6) as f1 from (select *, row_number() over (partition by tag order by round(f1, 12) desc, thr) as k from f) where k = 1""")
def j23b(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.best_f1(labelled(spark, d), ["tag"], "value", "bad").select("tag", r6("threshold").alias("threshold"), r6("f1").alias("f1"))


_ALERTS = f"{T.INCIDENTS}, {T.READINGS}, a as (select asset, t from readings where tag = 'purchase' and value > 60)"


def alerts(spark: SparkSession, d: str) -> DataFrame:
    return T.readings(spark, d).where("tag = 'purchase' and value > 60").select("asset", "t")


@query("k01_point_level_evaluation", f"""with {_ALERTS}, m as (select i.asset, i.t, min(a.t) as first from incidents i left join a on a.asset = i.asset and a.t between i.t - 14400000000 and i.t + 14400000000 group by all)
    select asset, count(*) as incidents, count(first) as hits, round(count(first) / count(*), 6) as recall, round(quantile_cont((t - first) / 60000000.0, 0.5), 6) as lead_min from m group by asset""")
def k01(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.match(alerts(spark, d), T.incidents(spark, d), ["asset"], 4 * HOUR, 4 * HOUR)
    return m.groupBy("asset").agg(F.count("*").alias("incidents"), F.count("first").alias("hits"), r6(F.count("first") / F.count("*")).alias("recall"), r6(F.percentile((F.col("t") - F.col("first")) / 6e7, 0.5)).alias("lead_min"))


def per_day(counted: DataFrame, rows: DataFrame) -> DataFrame:
    """`counted` with false_per_day over the days from the first to the last of `rows`, one number."""
    days = rows.agg(((F.max("t") - F.min("t")) / 8.64e10).alias("_days"))
    return counted.crossJoin(F.broadcast(days)).withColumn("false_per_day", F.col("false_per_day") / F.col("_days")).drop("_days")


def _grid_alerts(spark: SparkSession, d: str) -> DataFrame:
    y = F.explode(F.sequence(F.lit(30), F.lit(150), F.lit(20)))
    return T.readings(spark, d).where("tag = 'purchase'").withColumn("y", y).where("value > y").select("y", "asset", "t")


_CURVE = f"""{T.INCIDENTS}, {T.READINGS}, g as (select unnest(generate_series(30, 150, 20)) as y), a as (select y, asset, t from readings cross join g where tag = 'purchase' and value > y),
    m as (select y, i.asset, i.t, min(a.t) as first from (select * from incidents cross join (select distinct y from a)) i left join a using (y) where a.t is null or true group by all),
    mm as (select i.y, i.asset, i.t, (select min(a.t) from a where a.y = i.y and a.asset = i.asset and a.t between i.t - 28800000000 and i.t) as first from (select * from incidents cross join (select distinct y from a)) i),
    e as (select *, sum(case when t - p <= 21600000000 then 0 else 1 end) over (partition by y, asset order by t rows unbounded preceding) as e from (select *, lag(t) over (partition by y, asset order by t) as p from a)), ep as (select y, asset, e, min(t) as s, max(t) as b from e group by all),
    fl as (select y, count(*) as n, count(*) filter (where not exists (select 1 from incidents i where i.asset = ep.asset and ep.s <= i.t and ep.b >= i.t - 28800000000)) as f from ep group by y),
    curve as (select y, avg(case when first is not null then 1.0 else 0 end) as recall, quantile_cont((t - first) / 3.6e9, 0.5) as lead_h, any_value(n) as episodes, any_value(f) / (select (max(t) - min(t)) / 8.64e10 from readings) as false_per_day from mm join fl using (y) group by y)"""
_CURVE = _CURVE.replace("""m as (select y, i.asset, i.t, min(a.t) as first from (select * from incidents cross join (select distinct y from a)) i left join a using (y) where a.t is null or true group by all),
    """, "")


def curve(spark: SparkSession, d: str) -> DataFrame:
    return per_day(evaluate.predictive_curve(_grid_alerts(spark, d), T.incidents(spark, d), ["asset"], 8 * HOUR, 6 * HOUR, F.lit(1.0), ["y"]), T.readings(spark, d))


@query("f01_operating_point", f"with {_CURVE} select y, round(recall, 6) as recall from curve order by (false_per_day <= 2) desc, recall desc, y limit 1")
def f01(spark: SparkSession, d: str) -> DataFrame:
    c = curve(spark, d).withColumn("all", F.lit(1))
    return evaluate.operating_point(c, ["all"], 2.0, "y").select(F.col("y").cast("long").alias("y"), r6("recall").alias("recall"))


@query("f02_lead_tie_break", f"""with recursive {_CURVE}, n as (select row_number() over (order by y) as k, y, round(recall, 1) as recall, coalesce(lead_h, 0) as lead_h, false_per_day as c from curve), r as (select k, y, recall, lead_h, c from n where k = 1
    union all select n.k, case when b then n.y else r.y end, case when b then n.recall else r.recall end, case when b then n.lead_h else r.lead_h end, case when b then n.c else r.c end from (select r.*, n.k as nk, n.recall > r.recall or (n.recall = r.recall and n.lead_h > r.lead_h + 0.5) or (n.recall = r.recall and abs(n.lead_h - r.lead_h) <= 0.5 and n.c < r.c) as b from r join n on n.k = r.k + 1) r join n on n.k = r.nk)
    select y, recall, round(lead_h, 6) as lead_h from r order by k desc limit 1""")
def f02(spark: SparkSession, d: str) -> DataFrame:
    c = curve(spark, d).select(F.lit(1).alias("all"), "y", F.round("recall", 1).alias("recall"), F.coalesce("lead_h", F.lit(0.0)).alias("lead_h"), "false_per_day")
    best = evaluate.fold_best(c, ["all"], "y", "recall", "lead_h", "false_per_day", 0.5)
    return best.select(F.col("y").cast("long").alias("y"), "recall", r6("lead_h").alias("lead_h"))


@query("f05_neighbour_minimax", f"with {_CURVE} select y, round(min(recall) over (order by y range between 20 preceding and 20 following), 6) as worst from curve")
def f05(spark: SparkSession, d: str) -> DataFrame:
    c = curve(spark, d).withColumn("all", F.lit(1)).withColumn("step", ((F.col("y") - 30) / 20).cast("int"))
    return evaluate.neighbour_worst(c, ["all"], "step", "recall").select(F.col("y").cast("long").alias("y"), r6("worst").alias("worst"))


@query("f06_cost_matched", f"with {_CURVE} select arg_min(y, [abs(false_per_day - 1), y]) as y from curve")
def f06(spark: SparkSession, d: str) -> DataFrame:
    return curve(spark, d).agg(F.min_by("y", F.struct(F.abs(F.col("false_per_day") - 1), "y")).cast("long").alias("y"))


@query("f09_first_sustained", f"""with {T.INCIDENTS}, {T.READINGS}, s as (select asset, t, sum(case when value > 20 then 1 else 0 end) over (partition by asset order by t rows between 2 preceding and current row) = 3 as up from readings where tag = 'purchase') select i.asset, i.t, min(s.t) as first_t from incidents i join s on s.asset = i.asset and s.up and s.t between i.t - 86400000000 and i.t group by all""")
def f09(spark: SparkSession, d: str) -> DataFrame:
    from plantwatch.operators.state import sustained

    rows = T.readings(spark, d).where("tag = 'purchase'").withColumn("up", sustained(F.col("value") > 20, 3, ["asset"])).where("up").select("asset", F.col("t").alias("u"))
    return align.range_join(T.incidents(spark, d), rows, ["asset"], DAY, 0).groupBy("asset", "t").agg(F.min("u").alias("first_t"))


@query("k05_recall_false_duty", f"""with {_ALERTS}, {T.RUNNING.removeprefix(T.READINGS + ', ')}, s as (select g.asset, g.t, g."on", exists (select 1 from a where a.asset = g.asset and a.t between g.t - 14400000000 and g.t) as alert from running g),
    y as (select asset, avg(case when alert then 1.0 else 0 end) filter (where "on") as duty, count(*) filter (where "on") as on_rows, (max(t) - min(t)) / 8.64e10 as days from s group by asset),
    m as (select asset, avg(case when exists (select 1 from a where a.asset = i.asset and a.t between i.t - 28800000000 and i.t) then 1.0 else 0 end) as recall from incidents i group by asset),
    e as (select *, sum(case when t - p <= 21600000000 then 0 else 1 end) over (partition by asset order by t rows unbounded preceding) as e from (select *, lag(t) over (partition by asset order by t) as p from a)), ep as (select asset, e, min(t) as s, max(t) as b from e group by all),
    f as (select asset, count(*) as f from ep where not exists (select 1 from incidents i where i.asset = ep.asset and ep.s <= i.t and ep.b >= i.t - 28800000000) group by asset)
    select y.asset, round(recall, 6) as recall, round(coalesce(f, 0) / days, 6) as false_per_day, round(duty, 6) as duty, on_rows from y left join m using (asset) left join f using (asset)""")
def k05(spark: SparkSession, d: str) -> DataFrame:
    from plantwatch.operators.clean import near_events

    said, real = alerts(spark, d), T.incidents(spark, d)
    s = near_events(T.running(spark, d), said, ["asset"], 0, 4 * HOUR, "alert")
    duty = s.groupBy("asset").agg(F.avg(F.when(F.col("on"), F.col("alert").cast("double"))).alias("duty"), F.count_if("on").alias("on_rows"), ((F.max("t") - F.min("t")) / 8.64e10).alias("days"))
    hit = evaluate.match(said, real, ["asset"], 8 * HOUR).groupBy("asset").agg(F.avg(F.col("first").isNotNull().cast("double")).alias("recall"))
    false = evaluate.false_episodes(said, real, ["asset"], 6 * HOUR, 8 * HOUR).groupBy("asset").agg(F.count("*").alias("f"))
    out = duty.join(hit, "asset", "left").join(false, "asset", "left")
    return out.select("asset", r6("recall").alias("recall"), r6(F.coalesce("f", F.lit(0)) / F.col("days")).alias("false_per_day"), r6("duty").alias("duty"), "on_rows")


@query("k07_birth_rule", f"""with {_EPISODES}, {T.INCIDENTS} select i.asset, i.t, coalesce(bool_or(e.start between i.t - 86400000000 and i.t), false) as born, coalesce(bool_or(e.start between i.t - 86400000000 and i.t - 7200000000), false) as actionable from incidents i left join ep e on e.asset = i.asset and e.start between i.t - 86400000000 and i.t group by all""")
def k07(spark: SparkSession, d: str) -> DataFrame:
    i = T.incidents(spark, d)
    met = align.range_join(i, alert_episodes(spark, d).select("asset", F.col("start").alias("u")), ["asset"], DAY, 0)
    g = met.groupBy("asset", "t").agg(F.bool_or(F.col("u") <= F.col("t") - 2 * HOUR).alias("actionable"), F.lit(True).alias("born"))
    return i.join(g, ["asset", "t"], "left").select("asset", "t", F.coalesce("born", F.lit(False)).alias("born"), F.coalesce("actionable", F.lit(False)).alias("actionable"))


@query("k08_episode_classes", f"""with {_EPISODES}, {T.INCIDENTS}, {T.RUNNING.removeprefix(T.READINGS + ', ')}, rr as (select *, sum(case when "on" is distinct from p then 1 else 0 end) over (partition by asset order by t rows unbounded preceding) as run from (select *, lag("on") over (partition by asset order by t) as p from running)), stops as (select asset, run, min(t) as s from rr where not "on" group by all having max(t) - min(t) >= 7200000000)
    select asset, start, case when exists (select 1 from incidents i where i.asset = ep.asset and ep.start <= i.t and ep."end" >= i.t - 14400000000) then 'TP' when exists (select 1 from stops s where s.asset = ep.asset and s.s between ep.start and ep."end" + 14400000000) then 'NEUTRAL' else 'FP' end as class from ep""")
def k08(spark: SparkSession, d: str) -> DataFrame:
    ep = alert_episodes(spark, d)
    i = T.incidents(spark, d).select("asset", (F.col("t") - 4 * HOUR).alias("a"), F.col("t").alias("b"))
    r = episodes.runs(T.running(spark, d), ["asset"], "on").where("not on").groupBy("asset", "run").agg(F.min("t").alias("s"), F.max("t").alias("e")).where(F.col("e") - F.col("s") >= 2 * HOUR)
    stops = r.select("asset", (F.col("s") - 4 * HOUR).alias("a"), F.col("s").alias("b"))
    mark = lambda x, name: align.overlaps(ep, x, ["asset"], DAY).select("asset", "start").distinct().withColumn(name, F.lit(True))
    out = ep.join(mark(i, "tp"), ["asset", "start"], "left").join(mark(stops, "neutral"), ["asset", "start"], "left")
    return out.select("asset", "start", F.when(F.col("tp"), "TP").when(F.col("neutral"), "NEUTRAL").otherwise("FP").alias("class"))


@query("k09_predictive_or_reactive", f"""with {_ALERTS} select i.asset, i.t, case when min(a.t) <= i.t then 'predictive' when min(a.t) > i.t then 'reactive' else 'none' end as category from incidents i left join a on a.asset = i.asset and a.t between i.t - 86400000000 and i.t + 86400000000 group by i.asset, i.t""")
def k09(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.match(alerts(spark, d), T.incidents(spark, d), ["asset"], DAY, DAY)
    return m.select("asset", "t", F.when(F.col("first") <= F.col("t"), "predictive").when(F.col("first") > F.col("t"), "reactive").otherwise("none").alias("category"))


@query("k10_normal_alert_rate", f"""with {_LABEL} select tag, round(count(*) filter (where value > 60 and not bad) / count(*) filter (where not bad), 6) as rate from lab group by tag""")
def k10(spark: SparkSession, d: str) -> DataFrame:
    ok = ~F.col("bad")
    return labelled(spark, d).groupBy("tag").agg(r6(F.count_if((F.col("value") > 60) & ok) / F.count_if(ok)).alias("rate"))


@query("k12_severity_features", f"""with {_EPISODES} select e.asset, e.start, count(distinct r.tag) as channels, round(max(r.value), 6) as peak, round(sum(r.value), 6) as total, arg_max(r.t, [r.value, -r.t]) - e.start as to_peak from ep e join readings r on r.asset = e.asset and r.value > 60 and r.t between e.start and e.start + 43200000000 group by e.asset, e.start""")
def k12(spark: SparkSession, d: str) -> DataFrame:
    heads = alert_episodes(spark, d).select("asset", F.col("start").alias("t"))
    r = T.readings(spark, d).where("value > 60").select("asset", "tag", F.col("t").alias("u"), "value")
    g = align.range_join(heads, r, ["asset"], 0, 12 * HOUR).groupBy("asset", F.col("t").alias("start"))
    return g.agg(F.count_distinct("tag").alias("channels"), r6(F.max("value")).alias("peak"), r6(F.sum("value")).alias("total"), (F.max_by("u", F.struct("value", -F.col("u"))) - F.first("t")).alias("to_peak"))


@query("k13_stop_list", f"""with {T.RUNNING}, rr as (select *, sum(case when "on" is distinct from p then 1 else 0 end) over (partition by asset order by t rows unbounded preceding) as run from (select *, lag("on") over (partition by asset order by t) as p from running)) select asset, min(t) as start, round((max(t) - min(t)) / 3600000000.0, 6) as hours from rr where not "on" group by asset, run having max(t) - min(t) >= 7200000000""")
def k13(spark: SparkSession, d: str) -> DataFrame:
    r = episodes.runs(T.running(spark, d), ["asset"], "on").where("not on").groupBy("asset", "run").agg(F.min("t").alias("start"), r6((F.max("t") - F.min("t")) / float(HOUR)).alias("hours"))
    return r.where("hours >= 2").select("asset", "start", "hours")


@query("k15_coverage_null", f"""with {_ALERTS}, c as (select r.asset, r.t, exists (select 1 from a where a.asset = r.asset and a.t between r.t - 28800000000 and r.t) as c from readings r) select asset, round(avg(case when c then 1.0 else 0 end), 6) as p, round(power(avg(case when c then 1.0 else 0 end), 3), 6) as all_hit from c group by asset""")
def k15(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d).withColumn("alert", (F.col("tag") == "purchase") & (F.col("value") > 60))
    g = evaluate.coverage_null(rows, ["asset"], "alert", 8 * HOUR, 3)
    return g.select("asset", r6("p").alias("p"), r6("all_hit").alias("all_hit"))


@query("k17_tag_enrichment", f"""with {_LABEL}, g as (select tag, count(*) filter (where bad) as near, count(*) as n from lab group by tag), x as (select tag, near, n * sum(near) over () / sum(n) over () as expected from g) select tag, near, round(expected, 6) as expected, round(near / expected, 6) as ratio from x""")
def k17(spark: SparkSession, d: str) -> DataFrame:
    g = labelled(spark, d).groupBy("tag").agg(F.count_if("bad").alias("near"), F.count("*").alias("n"))
    whole = g.agg(F.sum("near").alias("a"), F.sum("n").alias("b"))
    x = g.crossJoin(F.broadcast(whole)).withColumn("expected", F.col("n") * F.col("a") / F.col("b"))
    return x.select("tag", "near", r6("expected").alias("expected"), r6(F.col("near") / F.col("expected")).alias("ratio"))


@query("k18_confidence_limits", f"""with {_LABEL}, g as (select tag, count(*) filter (where bad) as k, count(*) as n from lab group by tag) select tag, round((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 6) as low, round((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 6) as high,
    round(k * power(1 - 1 / (9.0 * k) - 1.96 / (3 * sqrt(k)), 3), 4) as rate_low, round((k + 1) * power(1 - 1 / (9.0 * (k + 1)) + 1.96 / (3 * sqrt(k + 1)), 3), 4) as rate_high from g""")
def k18(spark: SparkSession, d: str) -> DataFrame:
    g = labelled(spark, d).groupBy("tag").agg(F.count_if("bad").alias("k"), F.count("*").alias("n"))
    low, high = C.wilson(F.col("k"), F.col("n"))
    a, b = C.poisson_limits(F.col("k"))
    return g.select("tag", r6(low).alias("low"), r6(high).alias("high"), F.round(a, 4).alias("rate_low"), F.round(b, 4).alias("rate_high"))


@query("k19_period_trend", f"""with {T.READINGS}, m as (select asset, tag, t // 432000000000 as period, quantile_cont(value, 0.5) as v from readings group by all), r as (select *, rank() over (partition by asset, tag order by v) + (count(*) over (partition by asset, tag, v) - 1) / 2.0 as rv, rank() over (partition by asset, tag order by period) as rp from m) select asset, tag, round(corr(rv, rp), 6) as rho from r group by all""")
def k19(spark: SparkSession, d: str) -> DataFrame:
    m = T.readings(spark, d).groupBy(*KEYS, F.floor(F.col("t") / (5 * DAY)).alias("period")).agg(F.percentile("value", 0.5).alias("v"))
    w = Window.partitionBy(*KEYS)
    rv = F.rank().over(w.orderBy("v")) + (F.count("*").over(Window.partitionBy(*KEYS, "v")) - 1) / 2.0
    r = m.withColumn("rv", rv).withColumn("rp", F.rank().over(w.orderBy("period")))
    return r.groupBy(*KEYS).agg(r6(F.corr("rv", "rp")).alias("rho"))


@query("k21_leave_one_event_out", f"""with {_CURVE}, h as (select y, asset || '-' || t as event, first is not null as hit, false_per_day as cost from mm join curve using (y)), tot as (select y, count(*) filter (where hit) as total from h group by y), x as (select h.*, total - case when hit then 1 else 0 end as rest from h join tot using (y) where cost <= 8) select event, y, hit from (select *, row_number() over (partition by event order by rest desc, cost, y) as k from x) where k = 1""")
def k21(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.match(_grid_alerts(spark, d), T.incidents(spark, d), ["asset"], 8 * HOUR, 0, ["y"])
    t = m.join(curve(spark, d).select("y", F.col("false_per_day").alias("cost")), "y").select(F.concat_ws("-", "asset", "t").alias("event"), "y", F.col("first").isNotNull().alias("hit"), "cost")
    return evaluate.leave_one_event_out(t, "y", "event", "cost", 8.0).withColumn("y", F.col("y").cast("long"))


@query("k25_circular_shift_null", f"""with {T.READINGS}, b as (select asset, t, value, value < 100 as gate, value > 60 as alert, row_number() over (partition by asset order by t) - 1 as n, count(*) over (partition by asset) as c from readings where tag = 'purchase'), s as (select unnest([0, 7, 31]) as shift)
    select x.asset, s.shift, count(*) filter (where not g.gate) as removed from b x cross join s join b g on g.asset = x.asset and (g.n + s.shift) % g.c = x.n where x.alert group by all""")
def k25(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d).where("tag = 'purchase'").withColumn("gate", F.col("value") < 100).withColumn("alert", F.col("value") > 60)
    return evaluate.shifted_overlap(rows, ["asset"], "gate", "alert", [0, 7, 31])


_NEAR = f"""{_LABEL}, g as (select tag, count(*) filter (where bad and value > 60) as k, count(*) filter (where value > 60) as n, count(*) filter (where bad) as c, count(*) as whole from lab group by tag)"""


def _near_counts(spark: SparkSession, d: str) -> DataFrame:
    """(tag, k, n, c, whole): high readings near incidents, high readings, readings near incidents, readings."""
    high, bad = F.col("value") > 60, F.col("bad")
    return labelled(spark, d).groupBy("tag").agg(F.count_if(bad & high).alias("k"), F.count_if(high).alias("n"), F.count_if(bad).alias("c"), F.count("*").alias("whole"))


@query("k27_binomial_and_poisson_tests", f"""with {_NEAR}, b as (select tag, k, n, c / whole as p from g) select tag, k, n, round(case when k = 0 then 1 else (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))) from (select unnest(generate_series(k, n)) as i)) end, 6) as p_binomial,
    round(case when k = 0 then 1 else 1 - (select sum(exp(i * ln(n * p) - n * p - lgamma(i + 1))) from (select unnest(generate_series(0, k - 1)) as i)) end, 6) as p_poisson from b""")
def k27(spark: SparkSession, d: str) -> DataFrame:
    g = _near_counts(spark, d).withColumn("p", F.col("c") / F.col("whole"))
    poisson = evaluate.poisson_tail(F.col("k"), F.col("n") * F.col("p"))
    return g.select("tag", "k", "n", r6(evaluate.binomial_tail(F.col("k"), F.col("n"), F.col("p"))).alias("p_binomial"), r6(poisson).alias("p_poisson"))


@query("k27_fisher_exact", f"""with {_NEAR} select tag, k, round((select sum(exp(lgamma(n + 1) + lgamma(whole - n + 1) + lgamma(c + 1) + lgamma(whole - c + 1) - lgamma(whole + 1) - lgamma(i + 1) - lgamma(n - i + 1) - lgamma(c - i + 1) - lgamma(whole - n - c + i + 1))) from (select unnest(generate_series(k, least(n, c))) as i)), 6) as p_fisher from g""")
def k27_fisher(spark: SparkSession, d: str) -> DataFrame:
    return _near_counts(spark, d).select("tag", "k", r6(evaluate.fisher_tail(F.col("k"), F.col("n"), F.col("c"), F.col("whole"))).alias("p_fisher"))


@query("k27_mann_whitney", f"""with {_LABEL}, r as (select *, rank() over (partition by tag order by value) + (count(*) over (partition by tag, value) - 1) / 2.0 as r, cast(count(*) over (partition by tag, value) as double) as c from lab), g as (select tag, sum(r) filter (where bad) as s, cast(count(*) filter (where bad) as double) as a, cast(count(*) filter (where not bad) as double) as b, sum(c * c - 1) as ties from r group by tag)
    select tag, round(s - a * (a + 1) / 2, 6) as u, round((s - a * (a + 1) / 2 - a * b / 2) / sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))), 6) as z from g""")
def k27_mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.mann_whitney(labelled(spark, d), ["tag"], "value", "bad").select("tag", r6("u").alias("u"), r6("z").alias("z"))


@query("k30_campaign_duty", f"""with {T.RUNNING}, s as (select *, case when "on" and not coalesce(lag("on") over (partition by asset order by t), false) then 1 else 0 end as st from running), c as (select *, sum(st) over (partition by asset order by t rows unbounded preceding) as campaign from s) select c.asset, campaign, count(*) as hours, count(b.value) filter (where b.value > 60) as alert_hours from c left join bins b on b.asset = c.asset and b.t = c.t and b.tag = 'purchase' where "on" group by all having count(*) >= 6""")
def k30(spark: SparkSession, d: str) -> DataFrame:
    from plantwatch.operators.clean import starts

    s = starts(T.running(spark, d), ["asset"]).withColumn("campaign", F.sum(F.col("start").cast("int")).over(Window.partitionBy("asset").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    x = s.where("on").join(T.bins(spark, d).where("tag = 'purchase'").drop("tag"), ["asset", "t"], "left")
    return x.groupBy("asset", "campaign").agg(F.count("*").alias("hours"), F.count_if(F.col("value") > 60).alias("alert_hours")).where("hours >= 6")


@query("k31_load_bin_residual", f"""with {_LOAD}, q as (select asset, quantile_cont(load, 0.33) as a, quantile_cont(load, 0.66) as b from x group by asset), c as (select x.*, case when load < a then 0 when load < b then 1 else 2 end as bin from x join q using (asset)), m as (select asset, bin, quantile_cont(y, 0.5) as expected, count(*) as n from c group by all) select asset, bin, n, round(expected, 6) as expected from m""")
def k31(spark: SparkSession, d: str) -> DataFrame:
    x = loaded(spark, d)
    q = quantiles.cut_points(x, ["asset"], "load", {"a": 0.33, "b": 0.66})
    c = x.join(F.broadcast(q), "asset").withColumn("bin", F.when(F.col("load") < F.col("a"), 0).when(F.col("load") < F.col("b"), 1).otherwise(2))
    return c.groupBy("asset", "bin").agg(F.count("*").alias("n"), r6(F.percentile("y", 0.5)).alias("expected"))


@query("excursions_before_incidents", f"""with {T.INCIDENTS}, {T.BINS}, e as (select a.asset, a.tag, a.t, sum(b.value * power(0.5, (a.t - b.t) / 7200000000.0)) / sum(power(0.5, (a.t - b.t) / 7200000000.0)) as m from bins a join bins b on a.asset = b.asset and a.tag = b.tag and b.t <= a.t group by all),
    q as (select tag, quantile_cont(m, 0.9) as threshold from e group by tag), s as (select tag, asset, t from (select e.*, sum(case when m > threshold then 1 else 0 end) over (partition by asset, tag order by t rows between 1 preceding and current row) = 2 as up from e join q using (tag)) where up),
    mm as (select i.tag, i.asset, i.t, (select min(s.t) from s where s.tag = i.tag and s.asset = i.asset and s.t between i.t - 43200000000 and i.t) as first from (select * from incidents cross join (select distinct tag from s)) i),
    c as (select *, sum(case when t - p <= 21600000000 then 0 else 1 end) over (partition by tag, asset order by t rows unbounded preceding) as c from (select *, lag(t) over (partition by tag, asset order by t) as p from s)), ep as (select tag, asset, c, min(t) as a, max(t) as b from c group by all),
    f as (select tag, count(*) as n, count(*) filter (where not exists (select 1 from incidents i where i.asset = ep.asset and ep.a <= i.t and ep.b >= i.t - 43200000000)) as f from ep group by tag), d as (select (max(t) - min(t)) / 8.64e10 as days from e)
    select mm.tag, round(any_value(threshold), 6) as threshold, any_value(n) as episodes, round(avg(case when first is not null then 1.0 else 0 end), 6) as recall, round(quantile_cont((t - first) / 3.6e9, 0.5), 6) as lead_h, round(any_value(f.f) / any_value(days), 6) as false_per_day from mm join f using (tag) join q using (tag) cross join d group by mm.tag""")
def excursions_before_incidents(spark: SparkSession, d: str) -> DataFrame:
    from plantwatch.plans.detector import excursions

    x = excursions(T.readings(spark, d), T.incidents(spark, d))
    return x.select("tag", r6("threshold").alias("threshold"), "episodes", r6("recall").alias("recall"), r6("lead_h").alias("lead_h"), r6("false_per_day").alias("false_per_day"))


@query("four_signal_vote")
def four_signal_vote(spark: SparkSession, d: str) -> DataFrame:
    from plantwatch.plans.detector import four_signal_vote as vote

    return vote(T.readings(spark, d))
