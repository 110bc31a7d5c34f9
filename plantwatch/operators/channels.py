"""Channels built from specs: all channels, assets and periods in one plan."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.operators.lineage import cut_lineage
from plantwatch.operators.quantiles import quantiles
from plantwatch.operators.state import ewma_time


def outside_of(n: float, sums: Sequence[float], products: Sequence[float], share: float) -> list[float] | None:
    """The projector outside the components that hold `share` of the variance, row by row; None without variance. products are those of i <= j, by i and j."""
    d = len(sums)
    mean, full = np.asarray(sums, float) / n, np.zeros((d, d))
    full[np.triu_indices(d)] = np.asarray(products, float) / n
    full = full + full.T - np.diag(np.diag(full)) - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(full)
    if values.sum() <= 0:
        return None
    order = np.argsort(values)[::-1]
    k = int(np.searchsorted(np.cumsum(values[order]) / values.sum(), share) + 1)
    rest = vectors[:, order[k:]]
    return (rest @ rest.T).ravel().tolist()


def channel_scores(z: DataFrame, specs: DataFrame, share: float = 0.95, least: int = 20, asset: str = "asset") -> DataFrame:
    """(channel, kind, asset, t, score) of rows (asset, tag, t, period, z) by `specs` (channel, kind, tags, target).

    zmax is the greatest |z| of the tags; spread the greatest distance of a tag
    from the mean of the others; spread_alvo that of the target; pca the mean
    squared part of the tags' z outside the components that held `share` of
    their variance in the period before, with `least` rows there. Null z are no
    values; spreads need two tags, pca all of them.

    The sums and products of all (channel, asset, period) are one grouped
    aggregate with partial sums; only small matrices are decomposed, in tasks,
    and their projectors are joined back. Periods are whole numbers; a period's
    basis serves the next period that the channel has.
    """
    one = specs.select("channel", "kind", F.array_sort(F.array_distinct("tags")).alias("tags"), "target")
    rows = z.where(F.col("z").isNotNull()).join(one.withColumn("tag", F.explode("tags")), "tag")
    at = ["channel", "kind", asset, "t"]
    every = F.array_sort(F.collect_list(F.struct("tag", "z")))  # a channel's tags at one time
    rows = rows.groupBy(*at).agg(every.alias("e"), F.first("tags").alias("tags"), F.first("target").alias("target"), F.first("period").alias("period"))
    v = F.transform("e", lambda x: x["z"])
    rows = rows.withColumn("v", v).withColumn("n", F.size("v")).withColumn("sum", F.aggregate("v", F.lit(0.0), lambda a, b: a + b))
    apart = lambda x: F.abs(x - (F.col("sum") - x) / (F.col("n") - 1))
    own = F.get(F.filter("e", lambda x: x["tag"] == F.col("target")), F.lit(0))["z"]

    whole = rows.where((F.col("kind") == "pca") & (F.col("n") == F.size("tags")))
    by = ["channel", asset, "period"]
    cells = F.flatten(F.transform("v", lambda a, i: F.transform("v", lambda b, j: F.struct(i.alias("i"), j.alias("j"), a.alias("a"), (a * b).alias("ab")))))
    sums = whole.select(*by, F.explode(F.filter(cells, lambda c: c["i"] <= c["j"])).alias("c")).groupBy(*by, "c.i", "c.j").agg(F.count("*").alias("n"), F.sum("c.a").alias("s"), F.sum("c.ab").alias("p"))
    fits = sums.groupBy(*by).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "j", "s", "p"))).alias("c")).where(F.col("n") >= least)

    @F.pandas_udf("array<double>")
    def projector(n: pd.Series, sums: pd.Series, products: pd.Series) -> pd.Series:
        return pd.Series([outside_of(*x, share) for x in zip(n, sums, products, strict=True)], dtype=object)

    first = F.transform(F.filter("c", lambda x: x["i"] == x["j"]), lambda x: x["s"])
    fits = fits.select(*by, F.transform(first, lambda x: x / F.col("n")).alias("mean"), projector("n", first, F.transform("c", lambda x: x["p"])).alias("out"))
    known = whole.select(*by).distinct().join(fits, by, "left").withColumn("f", F.when(F.col("out").isNotNull(), F.struct("mean", "out")))
    served = known.select(*by, F.last("f", ignorenulls=True).over(Window.partitionBy("channel", asset).orderBy("period").rowsBetween(Window.unboundedPreceding, -1)).alias("f"))
    scored = whole.join(served, by)
    centred = F.zip_with("v", F.col("f.mean"), lambda a, b: a - b)
    scored = scored.withColumn("x", centred)
    line = lambda i: F.aggregate(F.zip_with("x", F.slice(F.col("f.out"), i * F.col("n") + 1, F.col("n")), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    lost = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: line(i) * line(i)), F.lit(0.0), lambda a, b: a + b) / F.col("n")
    pca = scored.select(*at, F.when(F.col("f").isNotNull(), lost).alias("score"))

    two = F.col("n") >= 2
    kinds = F.when(F.col("kind") == "zmax", F.array_max(F.transform("v", lambda x: F.abs(x)))).when((F.col("kind") == "spread") & two, F.array_max(F.transform("v", apart))).when((F.col("kind") == "spread_alvo") & two, apart(own))
    return rows.where("kind <> 'pca'").select(*at, kinds.alias("score")).where("score is not null").union(pca.where("score is not null"))


#: The forms of a channel's movement that `movements` makes.
FORMS = ("volatility", "delta", "slope")


def movements(df: DataFrame, rows: int, half_life: int, watched: str, keys: Sequence[str] = ("asset", "tag"), value: str = "value") -> DataFrame:
    """`df` with the forms of a channel's movement, each as its distance from the median of the watched rows in robust deviations.

    volatility is the standard deviation of the last `rows` rows; delta the
    EWMA by time less the median of the `rows` EWMAs that end `rows` rows
    before; slope the least-squares slope of the EWMA over `rows` rows. A frame
    with values in fewer than half its rows, in 80 % or fewer for the slope,
    gives null. The median and the MAD come from rows where `watched` holds,
    the MAD 1e-9 at least; a series without such rows has nulls.
    """
    by = Window.partitionBy(*keys).orderBy("t")
    now, before = by.rowsBetween(1 - rows, 0), by.rowsBetween(1 - 2 * rows, -rows)
    e = ewma_time(df, half_life, keys, value, "_e").withColumn("_k", F.row_number().over(by))
    full = lambda c, w, share: F.count(c).over(w) >= share * rows
    e = e.withColumn("volatility", F.when(full(value, now, 0.5), F.stddev_samp(value).over(now)))
    e = e.withColumn("delta", F.when(full("_e", before, 0.5), F.col("_e") - F.percentile("_e", 0.5).over(before)))
    e = cut_lineage(e.withColumn("slope", F.when(F.count("_e").over(now) > 0.8 * rows, F.regr_slope("_e", "_k").over(now))).drop("_e", "_k"))
    seen, out = e.where(watched), e
    for form in FORMS:
        middle = quantiles(seen, keys, form, {"_m": 0.5})
        apart = seen.join(middle, list(keys)).withColumn("_a", F.abs(F.col(form) - F.col("_m")))
        fit = middle.join(quantiles(apart, keys, "_a", {"_d": 0.5}), list(keys))
        out = out.join(fit, list(keys), "left").withColumn(form, F.abs(F.col(form) - F.col("_m")) / F.greatest(1.4826 * F.col("_d"), F.lit(1e-9))).drop("_m", "_d")
    return out
