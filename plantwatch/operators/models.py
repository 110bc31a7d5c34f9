"""Windows, splits, reconstruction scores, PCA and regression baselines, forests and templates, fitted by distributed sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.operators.align import range_join
from plantwatch.operators.blocks import with_halo
from plantwatch.operators.frames import Frames
from plantwatch.operators.quantiles import quantiles
from plantwatch.operators.state import running_clock

KEYS = ("asset", "tag")


def windows(df: DataFrame, size: int, stride: int, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """(keys, seq, start, end, x): every `stride`-th full window of `size` rows, numbered from 0."""
    w = Window.partitionBy(*keys).orderBy("t")
    ahead = w.rowsBetween(0, size - 1)
    rows = df.select(*keys, "t", (F.row_number().over(w) - 1).alias("_k"), F.array_agg(value).over(ahead).alias("x"), F.max("t").over(ahead).alias("end"), F.count("*").over(ahead).alias("_c"))
    rows = rows.where((F.col("_c") == size) & (F.size("x") == size) & (F.col("_k") % stride == 0))
    return rows.select(*keys, F.expr(f"cast(_k div {stride} as long)").alias("seq"), F.col("t").alias("start"), "end", "x")


def split(df: DataFrame, share: float, keys: Sequence[str] = KEYS, order: str = "seq", seed: int | None = None) -> DataFrame:
    """`df` with validation: the last floor(share * n) rows of each key, or by hash order with a seed."""
    by = F.col(order) if seed is None else F.xxhash64(*keys, order, F.lit(seed))
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(by, order))
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("validation", k > n - F.floor(n * share))


def window_error(x: Column, guess: Column | None = None, squared: bool = False) -> Column:
    """Mean absolute (or squared) error of a window against a guess; None: against its own mean."""
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / n
    e = F.transform(x, lambda v: v - mean) if guess is None else F.zip_with(x, guess, lambda a, b: a - b)
    return F.aggregate(F.transform(e, lambda v: v * v if squared else F.abs(v)), F.lit(0.0), lambda a, b: a + b) / n


def window_statistics(x: Column) -> dict[str, Column]:
    """The fourteen statistics of a window: mean, std (population), least, largest, range, lag1 and lag2 (autocorrelation), slope, p10, p25, p75, p90 (linear between ranks), and the biased skew and excess kurtosis; null without spread."""
    n = F.size(x)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = total(x) / n
    var = total(F.transform(x, lambda v: (v - mean) * (v - mean)))
    pairs = lambda k: F.zip_with(F.slice(x, F.lit(1), n - k), F.slice(x, F.lit(k + 1), n - k), lambda a, b: (a - mean) * (b - mean))
    moment = lambda k: total(F.transform(x, lambda v: F.pow(v - mean, F.lit(float(k))))) / n
    ranked = F.sort_array(x)

    def quantile(q: float) -> Column:
        place = (n - 1) * q
        low = F.floor(place)
        a, b = F.get(ranked, low.cast("int")), F.get(ranked, F.least(low + 1, n - 1).cast("int"))
        return a + (b - a) * (place - low)

    mid = (n - 1) / 2.0
    slope = total(F.transform(x, lambda v, i: (i - mid) * (v - mean))) / total(F.transform(x, lambda v, i: (i - mid) * (i - mid)))
    return {"mean": mean, "std": F.sqrt(var / n), "low": F.array_min(x), "top": F.array_max(x), "range": F.array_max(x) - F.array_min(x), "lag1": F.when(var > 0, total(pairs(1)) / var), "slope": slope, "lag2": F.when(var > 0, total(pairs(2)) / var),
            **{f"p{round(100 * q)}": quantile(q) for q in (0.1, 0.25, 0.75, 0.9)}, "skew": F.when(var > 0, moment(3) / F.pow(var / n, F.lit(1.5))), "kurt": F.when(var > 0, moment(4) / (var / n) / (var / n) - 3)}


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, sums, products): counts, sums and the sums of all products of `columns`, in one aggregate with map-side sums."""
    d = len(columns)
    products = [F.sum(F.col(columns[i]) * F.col(columns[j])) for i in range(d) for j in range(i, d)]
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.count("*").alias("n"), F.array(*map(F.sum, columns)).alias("sums"), F.array(*products).alias("products"))


def covariance(n: int, sums: Sequence[float], products: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population covariance of a row of moments()."""
    d = len(sums)
    mean = np.array(sums) / n
    full = np.zeros((d, d))
    full[np.triu_indices(d)] = np.array(products) / n
    full = full + full.T - np.diag(np.diag(full))
    return mean, full - np.outer(mean, mean)


def pca_residual(df: DataFrame, columns: Sequence[str], share: float = 0.95, fit: DataFrame | None = None) -> DataFrame:
    """`df` with residual, the mean squared part of its row outside the components that hold `share` of the variance.

    The moments of `fit` (default `df`) are one distributed aggregate; only
    the small covariance matrix is decomposed on the driver.
    """
    row = moments(fit if fit is not None else df, columns).first()
    mean, cov = covariance(row["n"], row["sums"], row["products"])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    k = int(np.searchsorted(np.cumsum(values[order]) / values.sum(), share) + 1)
    rest = vectors[:, order[k:]]
    outside = rest @ rest.T
    z = [F.col(c) - float(m) for c, m in zip(columns, mean, strict=True)]
    lost = [sum((z[j] * float(outside[i, j]) for j in range(len(columns))), F.lit(0.0)) for i in range(len(columns))]
    return df.withColumn("residual", sum((x * x for x in lost), F.lit(0.0)) / len(columns))


def mahalanobis(df: DataFrame, columns: Sequence[str], shrink: float = 0.1) -> DataFrame:
    """`df` with distance under a covariance drawn by `shrink` towards its mean variance times the identity."""
    row = moments(df, columns).first()
    mean, cov = covariance(row["n"], row["sums"], row["products"])
    d = len(columns)
    inverse = np.linalg.inv((1 - shrink) * cov + shrink * np.trace(cov) / d * np.eye(d))
    z = [F.col(c) - float(m) for c, m in zip(columns, mean, strict=True)]
    q = sum((z[i] * z[j] * float(inverse[i, j]) for i in range(d) for j in range(d)), F.lit(0.0))
    return df.withColumn("distance", F.sqrt(q))


def vector_moments(df: DataFrame, vector: str, centre: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray, float]:
    """Count, sum, sum of outer products, and sum of fourth powers of the lengths of the vectors less `centre`.

    Each batch is summed in its task, each of the d * d cells over the tasks;
    d * d numbers come to the driver. Null vectors are left out; all others
    have one length.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: np.ndarray | None = None
        for b in batches:
            x = np.stack(b[vector]).astype(float) if len(b) else None
            if x is None:
                continue
            x = x if centre is None else x - centre
            own = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel(), [((x * x).sum(axis=1) ** 2).sum()]])
            total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"place": np.arange(len(total)), "x": total})

    cells = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias(vector)).mapInPandas(part, "place long, x double")
    row = np.array([r["x"] for r in cells.groupBy("place").agg(F.sum("x").alias("x")).orderBy("place").collect()])
    if not len(row):
        return 0, np.zeros(0), np.zeros((0, 0)), 0.0
    d = int(round(np.sqrt(len(row) - 1.75) - 0.5))
    return int(row[0]), row[1 : 1 + d], row[1 + d : -1].reshape(d, d), float(row[-1])


def _form(df: DataFrame, vector: str, centre: np.ndarray, matrix: np.ndarray, into: str, finish: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """`df` with the quadratic form (x - centre)' matrix (x - centre) of its vectors, in batches."""

    @F.pandas_udf("double")
    def form(x: pd.Series) -> pd.Series:
        out, some = np.full(len(x), np.nan), x.notna().to_numpy()
        if some.any():
            z = np.stack(x[some]).astype(float) - centre
            out[some] = finish(np.einsum("ni,ij,nj->n", z, matrix, z, optimize=True))
        return pd.Series(out)

    return df.withColumn(into, F.when(F.col(vector).isNotNull(), form(F.col(vector).cast("array<double>"))))


def pca_residual_of_vectors(df: DataFrame, vector: str, share: float = 0.95) -> DataFrame:
    """`df` with residual, the mean squared part of each vector outside the components that hold `share` of the variance; null vectors have null."""
    n, sums, products, _ = vector_moments(df, vector)
    mean = sums / max(n, 1)
    values, vectors = np.linalg.eigh(products / max(n, 1) - np.outer(mean, mean))
    order = np.argsort(values)[::-1]
    k = int(np.searchsorted(np.cumsum(values[order]) / values.sum(), share) + 1) if n else 0
    rest = vectors[:, order[k:]]
    return _form(df, vector, mean, rest @ rest.T, "residual", lambda x: x / max(1, len(mean)))


def scaled_pca_score(df: DataFrame, vector: str, share: float = 0.95, unit: float = 0.99, into: str = "score") -> DataFrame:
    """`df` with its mean squared PCA residual after robust scaling, over the residual's quantile `unit`.

    Each component is scaled by its median and interquartile range (1 where
    that is 0). Null vectors, and all where the quantile is 0, have null.
    """
    parts = df.where(F.col(vector).isNotNull()).select(F.posexplode(vector).alias("_k", "_x")).withColumn("_x", F.col("_x").cast("double"))
    fit = sorted(quantiles(parts, ["_k"], "_x", {"a": 0.25, "m": 0.5, "b": 0.75}).collect(), key=lambda r: r["_k"])  # a row a component
    if not fit:
        return df.withColumn(into, F.lit(None).cast("double"))
    centre, spread = ([float(x) for x in c] for c in ([r["m"] for r in fit], [(r["b"] - r["a"]) or 1.0 for r in fit]))
    scale = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(d).alias("d")) for m, d in zip(centre, spread, strict=True)))
    scaled = pca_residual_of_vectors(df.withColumn("_scaled", F.zip_with(vector, scale, lambda x, c: (x - c["m"]) / c["d"])), "_scaled", share)
    top = quantiles(scaled.select("residual"), [], "residual", {"_p": unit})  # one row
    return scaled.crossJoin(F.broadcast(top)).withColumn(into, F.when(F.col("_p") > 0, F.col("residual") / F.col("_p"))).drop("_scaled", "_p", "residual")


def mahalanobis_of_vectors(df: DataFrame, vector: str) -> DataFrame:
    """`df` with distance under the covariance that Ledoit and Wolf (2004) shrink towards its mean variance times the identity; null vectors have null."""
    n, sums, _, _ = vector_moments(df, vector)
    mean = sums / max(n, 1)
    _, _, products, fourth = vector_moments(df, vector, mean)
    d, cov = len(mean), products / max(n, 1)
    level = np.trace(cov) / max(d, 1)
    apart = ((cov - level * np.eye(d)) ** 2).sum() / max(d, 1)
    noise = min(apart, (fourth / max(n, 1) - (cov**2).sum()) / max(d * n, 1))
    shrink = noise / apart if apart > 0 else 0.0
    return _form(df, vector, mean, np.linalg.pinv((1 - shrink) * cov + shrink * level * np.eye(d)), "distance", np.sqrt)


def regression_residual(df: DataFrame, target: str, load: str, by: Sequence[str]) -> DataFrame:
    """`df` with residual of target on [1, load] per `by`, by the normal equations as one aggregate; null where load doesn't vary."""
    fit = df.groupBy(*by).agg(F.regr_slope(target, load).alias("_b"), F.regr_intercept(target, load).alias("_a"))
    return df.join(fit, list(by)).withColumn("residual", F.col(target) - F.col("_a") - F.col("_b") * F.col(load)).drop("_a", "_b")


def quadratic_residual(df: DataFrame, target: str, load: str, by: Sequence[str]) -> DataFrame:
    """`df` with residual of target on [1, L, L^2] per `by`: sums of products per group, and each group's 3 x 3 system by Cramer's rule."""
    x, y = F.col(load), F.col(target)
    s = df.groupBy(*by).agg(F.count(x).cast("double").alias("s0"), *(F.sum(F.pow(x, F.lit(float(k)))).alias(f"s{k}") for k in range(1, 5)), *(F.sum(y * F.pow(x, F.lit(float(k)))).alias(f"m{k}") for k in range(3)))
    c = {k: F.col(k) for k in ("s0", "s1", "s2", "s3", "s4", "m0", "m1", "m2")}

    def det(m: list[list[Column]]) -> Column:
        (a, b, d), (e, f, g), (h, i, j) = m
        return a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)

    rows = [[c["s0"], c["s1"], c["s2"]], [c["s1"], c["s2"], c["s3"]], [c["s2"], c["s3"], c["s4"]]]
    right = [c["m0"], c["m1"], c["m2"]]
    whole = det(rows)
    beta = [F.when(F.abs(whole) > 1e-9, det([[right[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)]) / whole) for k in range(3)]
    fit = s.select(*by, *(b.alias(f"_b{k}") for k, b in enumerate(beta)))
    return df.join(fit, list(by)).withColumn("residual", y - F.col("_b0") - F.col("_b1") * x - F.col("_b2") * x * x).drop("_b0", "_b1", "_b2")


def walk_forward(df: DataFrame, period: int, lookback: int, least: int, keys: Sequence[str] = KEYS, value: str = "value", anchor: int = 0, usable: str | None = None) -> DataFrame:
    """`df` with z by median and MAD of the rows in the `lookback` of time before the start of its period; null with fewer than `least`.

    Periods start at `anchor` and every `period` from there, so a later anchor
    is another retraining day and a longer period a slower cadence. With
    `usable` only rows with that flag are fitted to; all are scored.
    A row is copied to the periods whose look-back holds it, ceil(lookback /
    period) at most; all periods are fitted in one job.
    """
    first = F.floor((F.col("t") - anchor) / period).cast("long")
    copies = -(-lookback // period)
    fit = df if usable is None else df.where(F.col(usable))
    train = fit.select(*keys, "t", F.col(value).alias("_x"), F.explode(F.sequence(first + 1, first + copies)).alias("_p")).where(F.col("t") >= F.col("_p") * period + anchor - lookback)
    mid = train.groupBy(*keys, "_p").agg(F.percentile("_x", 0.5).alias("_m"), F.count("*").alias("_n"))
    mad = train.join(mid, [*keys, "_p"]).groupBy(*keys, "_p", "_m", "_n").agg(F.percentile(F.abs(F.col("_x") - F.col("_m")), 0.5).alias("_d"), F.stddev_samp("_x").alias("_s"))
    scale = F.when(F.col("_d") > 0, 1.4826 * F.col("_d")).otherwise(F.col("_s"))
    out = df.withColumn("_p", first).join(mad, [*keys, "_p"], "left")
    return out.withColumn("z", F.when((F.col("_n") >= least) & (scale > 0), (F.col(value) - F.col("_m")) / scale)).drop("_p", "_m", "_n", "_d", "_s")


def causal_z(df: DataFrame, period: int, span: int, least: int, usable: str, most: int, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """`df` with z by the usable rows of the last `span` of usable time before the start of its period; null with fewer than `least`.

    The clock advances only on usable rows (see state.running_clock), so the
    look-back reaches as far as it must. z is by median and MAD, by the sample
    deviation where the MAD is 0. A period finds its rows through buckets of the
    clock; `span` of usable time is all that a group holds.
    """
    clocked = running_clock(df, usable, most, keys, "_ran").withColumn("_p", F.floor(F.col("t") / period).cast("long"))
    start = clocked.groupBy(*keys, "_p").agg(F.max("_ran").alias("_last"))
    before = F.coalesce(F.lag("_last").over(Window.partitionBy(*keys).orderBy("_p")), F.lit(0))
    start = start.select(*keys, "_p", before.alias("t"))  # the clock as the period starts
    fit = clocked.where(F.col(usable) & F.col(value).isNotNull()).select(*keys, F.col("_ran").alias("u"), F.col(value).alias("_x"))
    train = range_join(start, fit, list(keys), span - 1, 0)
    mid = train.groupBy(*keys, "_p").agg(F.percentile("_x", 0.5).alias("_m"), F.count("*").alias("_n"), F.stddev_samp("_x").alias("_s"))
    mad = train.join(mid, [*keys, "_p"]).groupBy(*keys, "_p").agg(F.percentile(F.abs(F.col("_x") - F.col("_m")), 0.5).alias("_d"))
    scale = F.when(F.col("_d") > 0, 1.4826 * F.col("_d")).otherwise(F.col("_s"))
    out = clocked.join(mid.join(mad, [*keys, "_p"]), [*keys, "_p"], "left")
    return out.withColumn("z", F.when((F.col("_n") >= least) & (scale > 0), (F.col(value) - F.col("_m")) / scale)).select(*df.columns, "z")


def period_z(df: DataFrame, period: str, least: int, smooth: int = 1, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """`df` with z by the rows of the key's periods before: the means, over the last `smooth` periods with `least` rows, of their medians and of their scaled MADs; null without such a period.

    Periods are numbers in a column and may be of any length, such as campaigns.
    Each is fitted once, and what serves a period is a window over one row a
    period, so no row is copied.
    """
    fit = df.where(F.col(period).isNotNull()).groupBy(*keys, period)
    mid = fit.agg(F.percentile(value, 0.5).alias("_m"), F.count(value).alias("_n"))
    mad = df.join(mid, [*keys, period]).groupBy(*keys, period).agg((1.4826 * F.percentile(F.abs(F.col(value) - F.col("_m")), 0.5)).alias("_d"))
    good = F.col("_n") >= least
    fits = mid.join(mad, [*keys, period]).select(*keys, period, F.when(good, F.struct(F.col("_m").alias("m"), F.col("_d").alias("d"))).alias("_f"))
    # periods without enough rows leave the order, so that `smooth` rows back are `smooth` fits
    w = Window.partitionBy(*keys).orderBy(period)
    some = fits.where(F.col("_f").isNotNull()).withColumn("_own", F.array_agg("_f").over(w.rowsBetween(-(smooth - 1), 0)))
    fits = fits.join(some.select(*keys, period, "_own"), [*keys, period], "left").withColumn("_l", F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    mean = lambda part: F.aggregate("_l", F.lit(0.0), lambda a, x: a + x[part]) / F.size("_l")
    served = fits.select(*keys, period, F.when(F.size("_l") > 0, mean("m")).alias("_c"), F.when(F.size("_l") > 0, mean("d")).alias("_s"))
    out = df.join(served, [*keys, period], "left")
    return out.withColumn("z", F.when(F.col("_s") > 0, (F.col(value) - F.col("_c")) / F.col("_s"))).select(*df.columns, "z")


def score_with_bundles(df: DataFrame, bundles: DataFrame, size: int, stride: int, keys: Sequence[str] = KEYS, value: str = "value", on: str | None = None) -> DataFrame:
    """(keys, seq, start, end, score, state, is_anom): windows of new rows scored with stored statistics.

    `bundles` has a row for each key: centre, scale (0 counts as 1), threshold,
    and low and high to clip to, null for no bound. A window's score is the mean
    absolute z of its rows; it is anomalous above the threshold. With `on`, a
    window whose last row is off has state "off" and isn't anomalous. A bundle
    whose key has no row is an error that names it.
    """
    gone = bundles.select(*keys).join(df.select(*keys).distinct(), list(keys), "left_anti").orderBy(*keys).limit(20).collect()
    if gone:
        raise ValueError("no rows for " + ", ".join("/".join(map(str, r)) for r in gone))
    rows = df.join(bundles, list(keys))
    x = F.least(F.greatest(F.col(value), F.coalesce("low", F.lit(float("-inf")))), F.coalesce("high", F.lit(float("inf"))))
    scale = F.when(F.col("scale") != 0, F.col("scale")).otherwise(1.0)
    rows = rows.withColumn("_z", F.when(F.col(value).isNotNull(), (x - F.col("centre")) / scale))
    seq = windows(rows, size, stride, keys, "_z").withColumn("score", window_error(F.col("x"), F.transform("x", lambda v: F.lit(0.0)))).drop("x")
    seq = seq.join(bundles.select(*keys, "threshold"), list(keys))
    if on is None:
        return seq.select(*keys, "seq", "start", "end", "score", F.lit("on").alias("state"), (F.col("score") > F.col("threshold")).alias("is_anom"))
    seq = seq.join(df.select(*keys, F.col("t").alias("end"), F.coalesce(on, F.lit(False)).alias("_on")), [*keys, "end"])
    return seq.select(*keys, "seq", "start", "end", "score", F.when(F.col("_on"), "on").otherwise("off").alias("state"), (F.col("_on") & (F.col("score") > F.col("threshold"))).alias("is_anom"))


def guarded_z(df: DataFrame, step: int, guard: int, back: int, least: int, keys: Sequence[str] = KEYS, value: str = "value", usable: str | None = None) -> DataFrame:
    """`df` with z by median and MAD of the rows that end `guard` before its block of `step` and begin `back` before it; null with fewer than `least`.

    With `usable` only rows with that flag are fitted to; null values and NaN
    count as no rows. A key is dealt to tasks by stretches of some four times
    `back`, so a row is copied once at most; in a task the references of all
    blocks are read from one merge tree, however much they overlap.
    """
    span = step * -(-4 * (back + step) // step)
    rows = df.withColumn("_k", F.floor(F.col("t") / step))
    fits = F.lit(True) if usable is None else F.coalesce(F.col(usable), F.lit(False))
    dealt = with_halo(df.select(*keys, "t", F.when(fits, F.col(value).cast("double")).alias("_x")), span, back + step)

    def references(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t", kind="stable", ignore_index=True)
        at, x = group["t"].to_numpy(np.int64), group["_x"].to_numpy(float, na_value=np.nan)
        blocks = np.unique(at[group["_own"].to_numpy(bool)] // step)
        t, x = at[~np.isnan(x)], x[~np.isnan(x)]
        low = np.searchsorted(t, blocks * step - back, "left")
        high = np.maximum(low, np.searchsorted(t, blocks * step - guard, "left"))
        frames = Frames(x)
        mid = frames.quantile(low, high, 0.5)
        out = pd.DataFrame({"_k": blocks, "_m": mid, "_n": high - low, "_d": frames.median_distance(low, high, mid)})
        for name in keys:
            out[name] = group[name].iloc[0] if len(group) else None
        return out[[*keys, "_k", "_m", "_n", "_d"]]

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", _k long, _m double, _n long, _d double"
    fit = dealt.groupBy(*keys, "_block").applyInPandas(references, schema)
    z = F.when((F.col("_n") >= least) & (F.col("_d") > 0), (F.col(value) - F.col("_m")) / (1.4826 * F.col("_d")))
    return rows.join(fit, [*keys, "_k"], "left").withColumn("z", z).drop("_k", "_m", "_n", "_d")


def drift_trigger(df: DataFrame, period: int, least: int, level: float, factor: float, reach: int, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """(keys, period, bundle): for each period the period whose start fitted the baseline that serves it.

    A baseline is the median and MAD of the period before it. It serves until
    the share of rows with |z| above `level`, in the last period served, is
    more than `factor` times that of its first one; it may serve `reach` periods
    at most. A period's share under each baseline that may serve it is one
    grouped sum; choosing is a fold over the few periods of a key.
    """
    p = F.floor(F.col("t") / period).cast("long")
    rows = df.withColumn("_p", p)
    train = rows.select(*keys, (F.col("_p") + 1).alias("_b"), F.col(value).alias("_x"))
    mid = train.groupBy(*keys, "_b").agg(F.percentile("_x", 0.5).alias("_m"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    fit = train.join(mid, [*keys, "_b"]).groupBy(*keys, "_b", "_m").agg((1.4826 * F.percentile(F.abs(F.col("_x") - F.col("_m")), 0.5)).alias("_s")).where("_s > 0")
    pairs = rows.withColumn("_b", F.explode(F.sequence(F.col("_p") - reach + 1, F.col("_p")))).join(fit, [*keys, "_b"])
    duty = pairs.groupBy(*keys, "_p", "_b").agg(F.avg((F.abs(F.col(value) - F.col("_m")) > level * F.col("_s")).cast("double")).alias("_d"))
    served = duty.groupBy(*keys, "_p").agg(F.map_from_entries(F.collect_list(F.struct("_b", "_d"))).alias("_by"))  # `reach` entries at most
    state = F.expr("struct(cast(null as long) as b, cast(null as double) as first, cast(null as double) as last, cast(array() as array<struct<period:bigint,bundle:bigint>>) as out)")

    def step(acc: Column, x: Column) -> Column:
        stale = acc["b"].isNull() | (x["_p"] - acc["b"] >= reach) | (acc["last"] > factor * acc["first"])
        fitted = F.map_contains_key(x["_by"], x["_p"])
        b = F.when(F.coalesce(stale, F.lit(True)) & fitted, x["_p"]).when(F.map_contains_key(x["_by"], F.coalesce(acc["b"], F.lit(-1))), acc["b"])
        share = F.try_element_at(x["_by"], F.coalesce(b, F.lit(-1)))
        first = F.when(b.eqNullSafe(acc["b"]), acc["first"]).otherwise(share)
        return F.struct(b.alias("b"), first.alias("first"), share.alias("last"), F.concat(acc["out"], F.array(F.struct(x["_p"].alias("period"), b.alias("bundle")))).alias("out"))

    folded = served.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("_p", "_by")), lambda a, b: (a["_p"] - b["_p"]).cast("int")), state, step)["out"].alias("_o"))
    return folded.select(*keys, F.explode("_o").alias("_o")).select(*keys, "_o.*")


def cell_residual(df: DataFrame, keys: Sequence[str], axes: dict[str, int], target: str, fit: str) -> DataFrame:
    """`df` with cell, expected and residual of `target` by a table over several axes, fitted to the rows with the flag `fit`.

    Each axis is cut at the quantiles of its fitted values into as many bins as
    `axes` says; values outside go to the first and the last bin. expected is
    the median of the fitted rows of the cell, of the key where the cell has
    none; keys without fitted rows and rows with a null axis have nulls.
    """
    fitted = df.where(fit)
    out = df
    cell = []
    for k, (axis, n) in enumerate(axes.items()):
        edges = quantiles(fitted, keys, axis, {f"_q{i}": i / n for i in range(1, n)})
        out = out.join(edges.select(*keys, F.array(*(f"_q{i}" for i in range(1, n))).alias(f"_e{k}")), list(keys), "left")
        cell.append(F.size(F.filter(f"_e{k}", lambda e: e <= F.col(axis))))  # noqa: B023
    known = F.lit(True)
    for k, axis in enumerate(axes):
        known = known & F.col(axis).isNotNull() & F.col(f"_e{k}").isNotNull()
    out = out.withColumn("cell", F.when(known, F.array(*cell))).drop(*(f"_e{k}" for k in range(len(axes))))
    own = quantiles(out.where(F.col(fit) & F.col("cell").isNotNull()), [*keys, "cell"], target, {"_own": 0.5})
    whole = quantiles(fitted, keys, target, {"_whole": 0.5})
    out = out.join(own, [*keys, "cell"], "left").join(whole, list(keys), "left")
    out = out.withColumn("expected", F.when(F.col("cell").isNotNull(), F.coalesce("_own", "_whole"))).drop("_own", "_whole")
    return out.withColumn("residual", F.col(target) - F.col("expected"))


def nearest_template(df: DataFrame, templates: DataFrame, vector: str = "x", name: str = "template") -> DataFrame:
    """`df` with the template of least mean squared distance over its components; `templates` (name, y) is small and broadcast."""
    packed = F.broadcast(templates.agg(F.array_sort(F.collect_list(F.struct(name, "y"))).alias("_t")))
    each = F.transform("_t", lambda t: F.struct((F.aggregate(F.zip_with(F.col(vector), t["y"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b) / F.size(t["y"])).alias("distance"), t[name].alias(name)))
    return df.crossJoin(packed).withColumn("_n", F.array_min(each)).select(*df.columns, F.col(f"_n.{name}").alias(name), "_n.distance")


def isolation_scores(df: DataFrame, columns: Sequence[str], key: str, trees: int = 32, sample: int = 256, seed: int = 1) -> DataFrame:
    """(key, score): isolation-forest score, 2^(-mean path / c), of every row.

    Each tree takes the `sample` rows with the smallest hashes for it. Hashes
    are uniform over 64 bits, so only rows below a bound that twice as many are
    expected under are dealt to the tree. Trees grow in parallel, one group each, and the forest, whose size is bounded by
    trees * sample nodes, is broadcast to score all rows in batches.
    """
    rows = df.select(key, *columns)
    bound = _hash_bound(rows.count(), sample)
    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda k: F.struct(k.alias("_tree"), F.xxhash64(key, k, F.lit(seed)).alias("_h"))), lambda x: x["_h"] <= bound)
    draws = rows.withColumn("_d", F.explode(drawn)).select("*", "_d.*").drop("_d")  # a row is copied only to the trees that draw it
    names = list(columns)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values("_h")[names].to_numpy(float)[:sample]
        rng = np.random.default_rng(seed * 10_007 + int(group["_tree"].iloc[0]))
        nodes: list[list[float]] = []

        def split_node(part: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, depth + _average_path(len(part)), 0, 0])
            if depth < int(np.ceil(np.log2(max(2, sample)))) and len(part) > 1:
                spread = part.max(axis=0) - part.min(axis=0)
                if (spread > 0).any():
                    f = int(rng.choice(np.flatnonzero(spread > 0)))
                    cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
                    low = split_node(part[part[:, f] < cut], depth + 1)
                    high = split_node(part[part[:, f] >= cut], depth + 1)
                    nodes[me] = [f, cut, 0.0, low, high]
            return me

        split_node(x, 0)
        return pd.DataFrame({"tree": [int(group["_tree"].iloc[0])], "nodes": [np.array(nodes).ravel().tolist()]})

    forest = [np.array(r["nodes"]).reshape(-1, 5) for r in draws.groupBy("_tree").applyInPandas(grow, "tree int, nodes array<double>").orderBy("tree").collect()]
    shared = df.sparkSession.sparkContext.broadcast(forest)
    scale = _average_path(sample)

    def score(batches):
        for b in batches:
            x = b[names].to_numpy(float)
            total = np.zeros(len(x))
            for nodes in shared.value:
                at = np.zeros(len(x), int)
                while (inner := nodes[at, 0] >= 0).any():
                    f = nodes[at, 0].astype(int)
                    go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] < nodes[at, 1], nodes[at, 3], nodes[at, 4]).astype(int)
                    at = np.where(inner, go, at)
                total += nodes[at, 2]
            yield pd.DataFrame({key: b[key], "score": 2.0 ** (-total / len(shared.value) / scale)})

    kind = df.schema[key].dataType.simpleString()
    return rows.dropna().mapInPandas(score, f"{key} {kind}, score double")


def _hash_bound(n: int, sample: int) -> int:
    """The 64-bit value under which 2 * sample of n uniform hashes are expected, the greatest where there are no more rows than that."""
    return min(2**63 - 1, -(2**63) + 2**65 * sample // max(1, n))


def _average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n
