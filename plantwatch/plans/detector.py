"""Detectors composed of the operators: the smoothed alert of one series, and the four-signal vote of an asset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.functions.columns import HOUR, floor_to
from plantwatch.operators import episodes, evaluate, models, quantiles, state
from plantwatch.operators.align import regular_grid
from plantwatch.operators.clean import mask_range, since_start

KEYS = ("asset", "tag")


def points_of(df: DataFrame, span: int, keys: Sequence[str] = KEYS, into: str = "points") -> DataFrame:
    """`df` with the number of rows that a key has in `span` of time, by the median step of its times; one at least."""
    step = F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy("t"))
    sizes = df.withColumn("_d", step).groupBy(*keys).agg(F.greatest(F.lit(1.0), F.round(F.lit(span) / F.percentile("_d", 0.5))).alias(into))
    return df.join(sizes, list(keys))


def smoothed_alerts(df: DataFrame, half_life: int, threshold: float, least: int | str, keys: Sequence[str] = KEYS, off: Column | None = None) -> DataFrame:
    """`df` with ewma and alert: the mean is at the threshold or above, the machine isn't `off`, and so for `least` rows in a row.

    `least` is a number or a column. A run of fewer rows has no alert at all, a
    longer one has it from its first row on.
    """
    up = F.coalesce(F.col("ewma") >= threshold, F.lit(False))
    rows = state.ewma_time(df, half_life, keys).withColumn("alert", up if off is None else up & ~off)
    return episodes.drop_short_runs(rows, keys, "alert", F.col(least) if isinstance(least, str) else least)


def excursions(readings: DataFrame, incidents: DataFrame, half_life: int = 2 * HOUR, quantile: float = 0.9, sustain: int = 2, gap: int = 6 * HOUR, horizon: int = 12 * HOUR) -> DataFrame:
    """(tag, threshold, episodes, useful, recall, lead_h, false_per_day): sustained excursions of the smoothed value before incidents, per tag.

    Bins of an hour, range mask, EWMA by time, a quantile of it as threshold,
    sustained steps, chained episodes, matched to the incidents of the asset.
    """
    bins = readings.groupBy(*KEYS, floor_to(F.col("t"), HOUR).alias("t")).agg(F.percentile("value", 0.5).alias("value"))
    rows = state.ewma_time(mask_range(bins, 0.0, 1000.0), half_life)
    threshold = quantiles.quantiles(rows, ["tag"], "ewma", {"threshold": quantile}, within=readings)
    rows = rows.join(threshold, "tag")
    alerts = rows.withColumn("on", state.sustained(F.col("ewma") > F.col("threshold"), sustain)).where("on").select("tag", "asset", "t")
    days = rows.agg(((F.max("t") - F.min("t")) / 8.64e10).alias("days"))
    curve = evaluate.predictive_curve(alerts, incidents, ["asset"], horizon, gap, F.lit(1.0), ["tag"])
    return curve.join(threshold, "tag").crossJoin(F.broadcast(days)).select("tag", "threshold", "episodes", "recall", "lead_h", (F.col("false_per_day") / F.col("days")).alias("false_per_day"))


def four_signal_vote(readings: DataFrame, running_tag: str = "view", running_above: float = 15.0, step: int = HOUR, low: float = 1.5, high: float = 3.0, kappa: float = 0.5, limit: float = 5.0, gap: int = 6 * HOUR, refractory: int = 24 * HOUR, least: int = HOUR, blackout: int = 3 * HOUR) -> DataFrame:
    """(asset, start, end): alarms of each asset by a two-level vote of its tags' channels.

    Grid with holes kept; walk-forward robust z by the two weeks before each
    week; EWMA; a channel lights by two sustained steps or by CUSUM, at a low
    and a high level; alarm at three low or two high channels while the machine
    has run for `blackout`; episodes, refractory period, minimum duration.
    """
    bins = readings.groupBy(*KEYS, floor_to(F.col("t"), step).alias("t")).agg(F.percentile("value", 0.5).alias("value"))
    grid = regular_grid(bins, step)
    last = F.last("value", ignorenulls=True).over(Window.partitionBy("asset").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    on = grid.where(F.col("tag") == running_tag).select("asset", "t", F.coalesce(last > running_above, F.lit(False)).alias("on"))
    hot = since_start(on, ["asset"]).select("asset", "t", (F.col("on") & (F.col("since") >= blackout)).alias("hot"))
    z = models.walk_forward(grid.where("value is not null"), 7 * 24 * HOUR, 14 * 24 * HOUR, 20)
    z = state.ewma_time(z.withColumn("z", F.abs("z")), 2 * step, value="z", into="e")
    z = state.cusum(z.withColumn("x", F.least(F.col("e") / high, F.lit(20.0))), kappa + 0.5, z="x")
    for name, level in (("low", low), ("high", high)):
        z = z.withColumn(name, state.sustained(F.col("e") > level, 2) | ((F.col("cusum") >= limit) & F.lit(name == "low")))
    votes = z.groupBy("asset", "t").agg(F.count_if("low").alias("low"), F.count_if("high").alias("high"))
    alarm = votes.join(hot, ["asset", "t"]).where(F.col("hot") & ((F.col("low") >= 3) | (F.col("high") >= 2)))
    ep = episodes.refractory(episodes.episodes(alarm.select("asset", "t"), ["asset"], gap), ["asset"], refractory)
    return episodes.min_duration(ep, least, step)
