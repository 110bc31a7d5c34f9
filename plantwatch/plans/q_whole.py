"""Queries: rules of the inventory in their whole form, beside the shorter ones of the other modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantwatch.functions.columns import DAY, HOUR, micros, parse_by_shares, time_shares
from plantwatch.operators import align, channels, clean, episodes, evaluate, models, ranks, scans, state
from plantwatch.plans import tables as T
from plantwatch.plans.q_clean import r6
from plantwatch.plans.q_eval import _LABEL, labelled
from plantwatch.plans.q_series import _EPISODES, KEYS, alert_episodes
from plantwatch.plans.q_state import _P
from plantwatch.plans.registry import query

#: Deliveries of times as text: ISO, mostly ISO with short forms, slashed day first, slashed month first with as many ISO ones.
_TEXTS = {0: ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss"), 1: ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"), 2: ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy"), 3: ("MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss")}


@query("b01_formats_by_share", """with x as (select event_id, user_id % 4 as source, ts, event_id % 3 = 0 as short, event_id % 50 = 7 as bad from events)
    select event_id, source, case when bad then null when short and source in (1, 2) then cast(epoch_us(date_trunc('day', ts)) as bigint) else cast(epoch_us(date_trunc('second', ts)) as bigint) end as t from x""")
def b01(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select("event_id", (F.col("user_id") % 4).alias("source"), F.col("ts").cast("timestamp").alias("ts"))
    text = F.lit(None).cast("string")
    for k, (whole, short) in _TEXTS.items():
        text = F.when(F.col("source") == k, F.when(F.col("event_id") % 3 == 0, F.date_format("ts", short)).otherwise(F.date_format("ts", whole))).otherwise(text)
    rows = e.select("event_id", "source", F.when(F.col("event_id") % 50 == 7, "no data").otherwise(text).alias("s"))
    shares = rows.groupBy("source").agg(*(c.alias(k) for k, c in time_shares(F.col("s")).items()))
    at = parse_by_shares(F.col("s"), F.col("slashed"), F.col("iso"), F.col("failed"))
    return rows.join(shares, "source").select("event_id", "source", micros(at).alias("t"))


_FILLED = f"""{T.GRID}, n as (select *, row_number() over ({_P}) as k from grid),
    s as (select *, max(case when value is not null then k end) over ({_P} rows unbounded preceding) as a, min(case when value is not null then k end) over ({_P} rows between current row and unbounded following) as b from n),
    f as (select s.asset, s.tag, s.t, case when s.value is not null then s.value when least(s.k - a, b - s.k) <= 2 then case when a is null then y.value when b is null then x.value else x.value + (y.value - x.value) * (s.k - a) / (b - a) end end as v
        from s left join n x on x.asset = s.asset and x.tag = s.tag and x.k = a left join n y on y.asset = s.asset and y.tag = s.tag and y.k = b),
    h as (select *, max(case when v is not null then t end) over ({_P} rows unbounded preceding) as p, min(case when v is not null then t end) over ({_P} rows between current row and unbounded following) as q from f)"""


@query("b13_filled_to_the_end", f"""with {_FILLED} select h.asset, h.tag, h.t, round(coalesce(h.v, x.v + (y.v - x.v) * ((h.t - p) / (q - p)), x.v, y.v), 6) as filled from h left join f x on x.asset = h.asset and x.tag = h.tag and x.t = p left join f y on y.asset = h.asset and y.tag = h.tag and y.t = q""")
def b13(spark: SparkSession, d: str) -> DataFrame:
    return clean.fill_all(T.grid(spark, d), 2).select(*KEYS, "t", r6("filled").alias("filled"))


@query("b14_context_filled_both_ways", f"""with {_FILLED} select h.asset, h.tag, h.t, round(coalesce(h.v, x.v, y.v, 0), 6) as filled from h left join f x on x.asset = h.asset and x.tag = h.tag and x.t = p left join f y on y.asset = h.asset and y.tag = h.tag and y.t = q""")
def b14(spark: SparkSession, d: str) -> DataFrame:
    return clean.fill_all(T.grid(spark, d), 2, weighted=False, otherwise=0.0).select(*KEYS, "t", r6("filled").alias("filled"))


_CLIP = 1705276800000000


@query("j04_windows_with_bundle", f"""with {T.READINGS}, p as (select asset, tag, quantile_cont(value, 0.5) as c, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as s, quantile_cont(value, 0.01) as low, quantile_cont(value, 0.99) as high from readings where t < {_CLIP} group by all),
    z as (select r.*, (least(greatest(value, low), high) - c) / case when s = 0 then 1 else s end as z, row_number() over ({_P}) - 1 as k from readings r join p using (asset, tag)),
    w as (select *, min(t) over ({_P} rows between 7 preceding and current row) as start, avg(abs(z)) over ({_P} rows between 7 preceding and current row) as score from z)
    select asset, tag, (k - 7) // 3 as seq, start, t as "end", round(score, 6) as score, case when value > 5 then 'on' else 'off' end as state, value > 5 and score > 0.9 as is_anom from w where k >= 7 and (k - 7) % 3 = 0""")
def j04(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d).withColumn("on", F.col("value") > 5)
    past = rows.where(F.col("t") < _CLIP).groupBy(*KEYS)
    q = past.agg(F.percentile("value", F.array(*map(F.lit, (0.01, 0.25, 0.5, 0.75, 0.99)))).alias("q"))
    bundles = q.select(*KEYS, F.col("q")[2].alias("centre"), (F.col("q")[3] - F.col("q")[1]).alias("scale"), F.col("q")[0].alias("low"), F.col("q")[4].alias("high"), F.lit(0.9).alias("threshold"))
    return models.score_with_bundles(rows, bundles, 8, 3, on="on").select(*KEYS, "seq", "start", "end", r6("score").alias("score"), "state", "is_anom")


@query("j15_causal_z_of_running_time", f"""with {_LABEL}, u as (select *, not bad and value > 5 as hot from lab), k as (select *, sum(case when hot then least(coalesce(t - q, 3600000000), 3600000000) else 0 end) over ({_P} rows unbounded preceding) as ran from (select *, lag(t) over ({_P}) as q from u)),
    c as (select asset, tag, t // {7 * DAY} as p, max(ran) as last from k group by all), b as (select asset, tag, p, coalesce(lag(last) over (partition by asset, tag order by p), 0) as c from c),
    tr as (select b.asset, b.tag, p, value as x from b join k on k.asset = b.asset and k.tag = b.tag and hot and ran > c - {200 * HOUR} and ran <= c), m as (select asset, tag, p, quantile_cont(x, 0.5) as m, count(*) as n, stddev_samp(x) as s from tr group by all),
    e as (select m.asset, m.tag, p, m, n, s, quantile_cont(abs(x - m), 0.5) as mad from m join tr using (asset, tag, p) group by all)
    select k.asset, k.tag, k.t, round(case when n >= 20 and case when mad > 0 then mad else s end > 0 then (value - m) / case when mad > 0 then 1.4826 * mad else s end end, 6) as z from k left join e on e.asset = k.asset and e.tag = k.tag and e.p = k.t // {7 * DAY}""")
def j15(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).withColumn("hot", ~F.col("bad") & (F.col("value") > 5))
    return models.causal_z(rows, 7 * DAY, 200 * HOUR, 20, "hot", HOUR).select(*KEYS, "t", r6("z").alias("z"))


@query("k14_sustained_divergence", f"""with {T.BINS}, s as (select *, sum(value) over w as s, count(value) over w as n from bins window w as (partition by asset, t)), r as (select asset, tag, t, value > 10 as "on", value - (s - value) / (n - 1) as r from s where n > 2), m as (select asset, tag, quantile_cont(r, 0.5) as m from r group by all), q as (select r.asset, r.tag, m, quantile_cont(abs(r - m), 0.5) as mad from r join m using (asset, tag) group by all),
    z as (select r.*, (r - m) / (1.4826 * mad) as z, lag(t) over ({_P}) as pt from r join q using (asset, tag)), g as (select *, quantile_cont(z, 0.5) over ({_P} rows between 4 preceding and current row) as g from z),
    c as (select *, abs(g) > 0.8 as up, sum(case when "on" then least(coalesce(t - pt, 3600000000), 3600000000) else 0 end) over ({_P} rows unbounded preceding) as ran from g), d as (select *, coalesce(max(case when "on" and not up then ran end) over ({_P} rows unbounded preceding), 0) as since from c)
    select asset, tag, count(*) filter (where "on" and up) as diverged, count(*) filter (where "on" and up and ran - since >= 3 * 3600000000) as sustained, count(*) as n from d group by all""")
def k14(spark: SparkSession, d: str) -> DataFrame:
    r = align.leave_one_out(T.bins(spark, d).withColumn("on", F.col("value") > 10), ["asset", "t"], 2).where("residual is not null")
    m = r.groupBy(*KEYS).agg(F.percentile("residual", 0.5).alias("m"))
    mad = r.join(m, KEYS).groupBy(*KEYS, "m").agg(F.percentile(F.abs(F.col("residual") - F.col("m")), 0.5).alias("mad"))
    z = r.join(mad, KEYS).withColumn("z", (F.col("residual") - F.col("m")) / (1.4826 * F.col("mad")))
    z = state.smoothed_median(z, 5, "z", "g").withColumn("up", F.abs("g") > 0.8)
    out = state.sustained_running(z, "up", "on", 3 * HOUR, HOUR)
    return out.groupBy(*KEYS).agg(F.count_if(F.col("on") & F.col("up")).alias("diverged"), F.count_if("held").alias("sustained"), F.count("*").alias("n"))


@query("k19_trend_of_all_periods")
def k19(spark: SparkSession, d: str) -> DataFrame:
    m = T.readings(spark, d).groupBy(*KEYS, F.floor(F.col("t") / (3 * DAY)).alias("period")).agg(F.percentile("value", 0.5).alias("v"))
    return ranks.trends(m, KEYS, "period", "v").select(*KEYS, "periods", r6("rho_p").alias("rho_p"), r6("tau_p").alias("tau_p"))


_SEVERITY = f"""{_EPISODES}, inc as (select asset, min(t) as t from (select *, sum(new) over (partition by asset order by t rows unbounded preceding) as e from
    (select user_id % 8 as asset, epoch_us(ts) as t, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id % 8 order by epoch_us(ts)) <= 14400000000 then 0 else 1 end as new from events where event_type = 'error' and value > 60)) group by asset, e)"""


@query("k12_cut_and_leave_one_out", f"""with {_SEVERITY}, f as (select e.asset || '-' || e.start as event, count(distinct r.tag) as channels, max(r.value) as peak, sum(r.value) as total, arg_max(r.t, [r.value, -r.t]) - e.start as to_peak, bool_or(exists (select 1 from inc i where i.asset = e.asset and i.t between e.start and e.start + {2 * DAY})) as positive
        from ep e join readings r on r.asset = e.asset and r.value > 60 and r.t between e.start and e.start + 43200000000 group by e.asset, e.start),
    l as (select event, positive, unnest(['channels', 'peak', 'total', 'to_peak']) as feature, unnest([channels, peak, total, to_peak]::double[]) as x from f), c as (select feature, min(x) as cut, count(*) as positives from l where positive group by feature)
    select feature, round(cut, 6) as cut, positives, count(*) filter (where not positive) as negatives, count(*) filter (where not positive and x >= cut) as kept,
        count(*) filter (where positive and x >= (select min(o.x) from l o where o.feature = l.feature and o.positive and o.event <> l.event)) as left_out from l join c using (feature) group by feature, cut, positives""")
def k12(spark: SparkSession, d: str) -> DataFrame:
    heads = alert_episodes(spark, d).select("asset", F.col("start").alias("t"))
    r = T.readings(spark, d).where("value > 60").select("asset", "tag", F.col("t").alias("u"), "value")
    g = align.range_join(heads, r, ["asset"], 0, 12 * HOUR).groupBy("asset", F.col("t"))
    f = g.agg(F.count_distinct("tag").alias("channels"), F.max("value").alias("peak"), F.sum("value").alias("total"), (F.max_by("u", F.struct("value", -F.col("u"))) - F.first("t")).alias("to_peak"))
    hit = align.range_join(f.select("asset", "t"), T.incidents(spark, d).withColumnRenamed("t", "u"), ["asset"], 0, 2 * DAY).select("asset", "t").distinct().withColumn("positive", F.lit(True))
    f = f.join(hit, ["asset", "t"], "left").withColumn("positive", F.coalesce("positive", F.lit(False))).withColumn("event", F.concat_ws("-", "asset", "t"))
    names = ("channels", "peak", "total", "to_peak")
    long = f.select("event", "positive", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names))).alias("p")).select("event", "positive", "p.*")
    out = evaluate.cuts_that_keep_positives(long)
    return out.select("feature", r6("cut").alias("cut"), "positives", "negatives", "kept", "left_out")


_CAMPAIGNS = f"""{T.RUNNING}, s as (select *, sum(case when "on" and not coalesce(p, false) then 1 else 0 end) over (partition by asset order by t rows unbounded preceding) as campaign from (select *, lag("on") over (partition by asset order by t) as p from running)),
    r as (select b.asset, b.tag, b.t, b.value, s.campaign as p from bins b join s on s.asset = b.asset and s.t = b.t and s."on"), m as (select asset, tag, p, quantile_cont(value, 0.5) as m, count(*) as n from r group by all),
    f as (select m.asset, m.tag, m.p, m, 1.4826 * quantile_cont(abs(value - m), 0.5) as d from m join r using (asset, tag, p) where n >= 3 group by all)"""


def campaigns(spark: SparkSession, d: str) -> DataFrame:
    """(asset, tag, t, value, campaign): hourly values while the machine runs, with the number of its starts so far."""
    on = T.running(spark, d)
    on = scans.scan(on, ["asset"], {"_p": scans.known(F.col("on"))}, inclusive=False)
    on = scans.scan(on.withColumn("_s", (F.col("on") & ~F.coalesce("_p", F.lit(False))).cast("long")), ["asset"], {"campaign": scans.total(F.col("_s"))})
    return T.bins(spark, d).join(on.where("on").select("asset", "t", "campaign"), ["asset", "t"])


@query("j12_campaign_baseline", f"""with {_CAMPAIGNS}, l as (select r.*, (select max(f.p) from f where f.asset = r.asset and f.tag = r.tag and f.p < r.p) as q from r) select l.asset, l.tag, l.t, round(case when d > 0 then (value - m) / d end, 6) as z from l left join f on f.asset = l.asset and f.tag = l.tag and f.p = l.q""")
def j12_campaign(spark: SparkSession, d: str) -> DataFrame:
    return models.period_z(campaigns(spark, d), "campaign", 3).select(*KEYS, "t", r6("z").alias("z"))


@query("j12_smoothed_normaliser", f"""with {T.BINS}, r as (select *, t // {2 * DAY} as p from bins), m as (select asset, tag, p, quantile_cont(value, 0.5) as m, count(*) as n from r group by all), f as (select m.asset, m.tag, m.p, m, 1.4826 * quantile_cont(abs(value - m), 0.5) as d from m join r using (asset, tag, p) where n >= 10 group by all),
    k as (select *, avg(m) over w as c, avg(d) over w as s from f window w as (partition by asset, tag order by p rows between 2 preceding and current row)), l as (select r.*, (select max(k.p) from k where k.asset = r.asset and k.tag = r.tag and k.p < r.p) as q from r)
    select l.asset, l.tag, l.t, round(case when s > 0 then (value - c) / s end, 6) as z from l left join k on k.asset = l.asset and k.tag = l.tag and k.p = l.q""")
def j12_smoothed(spark: SparkSession, d: str) -> DataFrame:
    rows = T.bins(spark, d).withColumn("period", F.floor(F.col("t") / (2 * DAY)).cast("long"))
    return models.period_z(rows, "period", 10, smooth=3).select(*KEYS, "t", r6("z").alias("z"))


@query("d19_redundancy", f"""with {T.READINGS}, f as (select *, value > 60 as up, lag(value > 60) over ({_P}) as p from readings), o as (select asset, tag, t from f where up and not coalesce(p, false)),
    e as (select *, sum(case when t - q <= 3600000000 then 0 else 1 end) over (partition by asset order by t rows unbounded preceding) as c from (select *, lag(t) over (partition by asset order by t) as q from o)), k as (select asset, c, count(*) as n, count(distinct tag) as tags from e group by all)
    select asset, cast(sum(n) as bigint) as onsets, count(*) as clusters, count(*) filter (where tags > 1) as coordinated, round(sum(n) / count(*), 6) as redundancy from k group by asset""")
def d19(spark: SparkSession, d: str) -> DataFrame:
    rows = T.readings(spark, d).withColumn("up", F.col("value") > 60)
    rows = scans.scan(rows, KEYS, {"_p": scans.known(F.col("up"))}, inclusive=False)
    onsets = rows.where(F.col("up") & ~F.coalesce("_p", F.lit(False)))
    k = episodes.episodes(onsets, ["asset"], HOUR, tags=F.count_distinct("tag"))
    return k.groupBy("asset").agg(F.sum("points").alias("onsets"), F.count("*").alias("clusters"), F.count_if(F.col("tags") > 1).alias("coordinated"), r6(F.sum("points") / F.count("*")).alias("redundancy"))


@query("d17_inventory_with_coverage", f"""with {T.RUNNING}, {T.INCIDENTS}, s as (select asset, t, "on", case when "on" and not coalesce(lag("on") over (partition by asset order by t), false) then t end as st from running), g as (select asset, t, "on", max(st) over (partition by asset order by t rows unbounded preceding) as start from s),
    x as (select i.asset, i.t, g."on", g.start from incidents i asof left join g on g.asset = i.asset and g.t <= i.t), c as (select asset, tag, round(count(value) / count(*), 6) as coverage from grid group by all),
    n as (select asset, count(*) as incidents, count(*) filter (where "on") as on_incidents, round(count(*) filter (where "on" and t - start <= 21600000000) / nullif(count(*) filter (where "on"), 0), 6) as after_start from x group by asset)
    select asset, tag, incidents, on_incidents, after_start, coverage, case when coverage < 0.1 then 'none' when on_incidents >= 20 and after_start < 0.5 then 'target' when on_incidents > 0 then 'context' else 'none' end as role from c join n using (asset)""")
def d17(spark: SparkSession, d: str) -> DataFrame:
    on = scans.scan(T.running(spark, d), ["asset"], {"_p": scans.known(F.col("on"))}, inclusive=False)
    on = scans.scan(on.withColumn("_s", F.when(F.col("on") & ~F.coalesce("_p", F.lit(False)), F.col("t"))), ["asset"], {"start": scans.known(F.col("_s"))})
    x = align.asof(T.incidents(spark, d), on.select("asset", "t", "on", "start"), ["asset"], ["on", "start"])
    soon = F.col("on") & (F.col("t") - F.col("start") <= 6 * HOUR)
    n = x.groupBy("asset").agg(F.count("*").alias("incidents"), F.count_if("on").alias("on_incidents"), r6(F.try_divide(F.count_if(soon), F.count_if("on"))).alias("after_start"))
    c = T.grid(spark, d).groupBy(*KEYS).agg(r6(F.count("value") / F.count("*")).alias("coverage"))
    role = F.when(F.col("coverage") < 0.1, "none").when((F.col("on_incidents") >= 20) & (F.col("after_start") < 0.5), "target").when(F.col("on_incidents") > 0, "context").otherwise("none")
    return c.join(n, "asset").select(*KEYS, "incidents", "on_incidents", "after_start", "coverage", role.alias("role"))


@query("d18_health_index", f"""with {T.READINGS}, e as (select a.asset, a.tag, a.t, sum(b.value * power(0.5, (a.t - b.t) / {5 * DAY}.0)) / sum(power(0.5, (a.t - b.t) / {5 * DAY}.0)) as m from readings a join readings b on a.asset = b.asset and a.tag = b.tag and b.t <= a.t group by all),
    r as (select *, 100.0 * percent_rank() over (partition by asset, tag order by round(m, 9)) as h from e), p as (select asset, tag, t // {5 * DAY} as period, quantile_cont(h, 0.5) as v from r group by all), s as (select asset, tag, count(*) as periods, regr_slope(v, period) as slope, arg_max(v, period) as latest from p group by all)
    select asset, tag, periods, round(latest, 4) as latest, round(slope, 4) as slope, case when slope > 2 then 'worsening' when slope < -2 then 'improving' else 'stable' end as label from s""")
def d18(spark: SparkSession, d: str) -> DataFrame:
    e = state.ewma_time(T.readings(spark, d), 5 * DAY)
    h = 100.0 * F.percent_rank().over(Window.partitionBy(*KEYS).orderBy(F.round("ewma", 9)))
    p = e.withColumn("h", h).groupBy(*KEYS, F.floor(F.col("t") / (5 * DAY)).alias("period")).agg(F.percentile("h", 0.5).alias("v"))
    s = p.groupBy(*KEYS).agg(F.count("*").alias("periods"), F.regr_slope("v", "period").alias("slope"), F.max_by("v", "period").alias("latest"))
    label = F.when(F.col("slope") > 2, "worsening").when(F.col("slope") < -2, "improving").otherwise("stable")
    return s.select(*KEYS, "periods", F.round("latest", 4).alias("latest"), F.round("slope", 4).alias("slope"), label.alias("label"))


_SPECS = [("hot", "zmax", ["click", "purchase", "view"], None), ("trio", "spread", ["click", "purchase", "view"], None), ("target", "spread_alvo", ["click", "purchase", "view"], "purchase"), ("pair", "spread", ["error", "view"], None)]


def _period_z(spark: SparkSession, d: str, step: int = HOUR, least: int = 20) -> DataFrame:
    """Values of each `step` with z by the week before, and the number of the week."""
    z = models.walk_forward(T.bins(spark, d, step), 7 * DAY, 7 * DAY, least)
    return z.select(*KEYS, "t", "z", F.floor(F.col("t") / (7 * DAY)).cast("long").alias("period"))


def _specs(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, "channel string, kind string, tags array<string>, target string")


@query("j11_channels_of_specs", f"""with {T.BINS}, w as (select *, t // {7 * DAY} as p from bins), m as (select asset, tag, p + 1 as p, quantile_cont(value, 0.5) as m, count(*) as n, stddev_samp(value) as s from w group by all), q as (select m.asset, m.tag, m.p, m, n, s, quantile_cont(abs(value - m), 0.5) as mad from m join w on w.asset = m.asset and w.tag = m.tag and w.p + 1 = m.p group by all),
    z as (select w.asset, w.tag, w.t, (value - m) / case when mad > 0 then 1.4826 * mad else s end as z from w join q using (asset, tag, p) where n >= 20 and (mad > 0 or s > 0)),
    c(channel, kind, tags, target) as (values {', '.join(f"('{c}', '{k}', {t}, {'null' if g is None else repr(g)})" for c, k, t, g in _SPECS)}), r as (select channel, kind, target, asset, tag, t, z, sum(z) over v as s, count(*) over v as n from z join c on list_contains(tags, tag) window v as (partition by channel, asset, t))
    select channel, kind, asset, t, round(max(case when kind = 'zmax' then abs(z) else abs(z - (s - z) / (n - 1)) end), 6) as score from r where kind = 'zmax' or (n >= 2 and (kind = 'spread' or tag = target)) group by all""")
def j11(spark: SparkSession, d: str) -> DataFrame:
    return channels.channel_scores(_period_z(spark, d), _specs(spark, _SPECS)).select("channel", "kind", "asset", "t", r6("score").alias("score"))


@query("j11_pca_channels")
def j11_pca(spark: SparkSession, d: str) -> DataFrame:
    specs = [("three", "pca", ["click", "purchase", "view"], None), ("five", "pca", ["click", "error", "purchase", "signup", "view"], None), *_SPECS]
    return channels.channel_scores(_period_z(spark, d, 6 * HOUR, 10), _specs(spark, specs), share=0.7, least=10).select("channel", "kind", "asset", "t", r6("score").alias("score"))
