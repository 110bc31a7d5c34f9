"""Rolling statistics, spectral features, rolling references and ranks along a series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plantwatch.operators.blocks import with_halo
from plantwatch.operators.frames import Frames, Sums

KEYS = ("asset", "tag")


def by_time(keys: Sequence[str] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("t")


def back(rows: int, keys: Sequence[str] = KEYS) -> WindowSpec:
    """The last `rows` rows, the current one among them."""
    return by_time(keys).rowsBetween(-(rows - 1), 0)


def unbiased_kurtosis(x: Column | str, w: WindowSpec) -> Column:
    """Sample excess kurtosis G2 over a frame; 0 with fewer than four values or no spread."""
    n, k = F.count(x).over(w).cast("double"), F.kurtosis(x).over(w)
    g2 = ((n - 1) / ((n - 2) * (n - 3))) * ((n + 1) * k + 6)
    return F.coalesce(F.when((n >= 4) & ~F.isnan(k), g2), F.lit(0.0))


def shape_features(df: DataFrame, rows: int, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """`df` with rms, std, kurt, crest, d1: rolling over `rows` rows, from the first row on."""
    w = back(rows, keys)
    rms = F.sqrt(F.avg(F.col(value) * F.col(value)).over(w))
    crest = F.coalesce(F.when(rms != 0, F.max(F.abs(F.col(value))).over(w) / rms), F.lit(0.0))
    std = F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0))
    return df.withColumns({"rms": rms, "std": std, "kurt": unbiased_kurtosis(value, w), "crest": crest, "d1": F.coalesce(F.col(value) - F.lag(value).over(by_time(keys)), F.lit(0.0))})


def sibling_spread(df: DataFrame, by: Sequence[str], name: str, value: str = "value", into: str = "spread") -> DataFrame:
    """`df` with the value less the median of the other rows of the same `by`, the siblings of a machine at a time; rows alone are left out.

    The siblings of one time are few; they are an array beside each of them.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("_all", F.collect_list(F.struct(F.col(name), F.col(value))).over(Window.partitionBy(*by)))
    rows = rows.withColumn("_x", F.sort_array(F.transform(F.filter("_all", lambda s: s[name] != F.col(name)), lambda s: s[value]))).where(F.size("_x") > 0)
    n = F.size("_x")
    middle = (F.get("_x", F.floor((n - 1) / 2).cast("int")) + F.get("_x", F.floor(n / 2).cast("int"))) / 2
    return rows.withColumn(into, F.col(value) - middle).drop("_all", "_x")


def slope(value: Column | str, pos: Column | str, rows: int, keys: Sequence[str] = KEYS, coverage: float = 1.0) -> Column:
    """Least-squares slope over the last `rows` rows; 0 where fewer than `coverage` of them have values."""
    w = back(rows, keys)
    return F.when(F.count(value).over(w) >= coverage * rows, F.regr_slope(value, pos).over(w)).otherwise(0.0)


def robust_z(value: Column | str, w: WindowSpec, least: int = 3) -> Column:
    """(value - median) / (interquartile range / 1.349) of a frame; null with fewer than `least` values or no spread."""
    scale = (F.percentile(value, 0.75).over(w) - F.percentile(value, 0.25).over(w)) / 1.349
    x = F.col(value) if isinstance(value, str) else value
    return F.when((F.count(value).over(w) >= least) & (scale != 0), (x - F.percentile(value, 0.5).over(w)) / scale)


def rank_percent(df: DataFrame, keys: Sequence[str], value: str = "value", into: str = "rank_pct") -> DataFrame:
    """`df` with the value's rank over the number of values of its keys, ties averaged; null for nulls."""
    w = Window.partitionBy(*keys)
    lowest = F.rank().over(w.orderBy(F.col(value).asc_nulls_last()))
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return df.withColumn(into, F.when(F.col(value).isNotNull(), (2 * lowest + ties - 1) / (2.0 * F.count(value).over(w))))


def order_statistics(df: DataFrame, keys: Sequence[str], back: int, ahead: int, block: int, share: float = 0.5, value: str = "value") -> DataFrame:
    """`df` with n, quantile and rank_pct of the values with t in [t - back, t + ahead] of the same keys.

    quantile is the `share` quantile, linear between ranks; rank_pct the row's
    own rank over n, ties averaged. Both are null where the frame is empty, and
    rank_pct for a null value. A key is dealt to tasks by blocks of `block` of
    time with a halo; in a task all frames are answered from one merge tree.
    """
    kind = {"n": "long", "quantile": "double", "rank_pct": "double"}
    columns = df.columns

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t", kind="stable", ignore_index=True)
        t, x, own = group["t"].to_numpy(np.int64), group[value].to_numpy(float, na_value=np.nan), group["_own"].to_numpy(bool)
        known = ~np.isnan(x)
        place = np.concatenate([[0], np.cumsum(known)])
        low = place[np.searchsorted(t, t[own] - back, "left")]
        high = np.maximum(low, place[np.searchsorted(t, t[own] + ahead, "right")])
        frames, mine, n = Frames(x[known]), x[own], high - low
        made = group[own][columns].copy()
        made["n"] = n
        made["quantile"] = frames.quantile(low, high, share)
        ranked = (n > 0) & ~np.isnan(mine)
        less, to = (frames.below(low[ranked], high[ranked], mine[ranked], side) for side in ("left", "right"))
        made["rank_pct"] = np.nan
        made.loc[ranked, "rank_pct"] = (less + to + 1) / (2.0 * n[ranked])
        return made

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"{k} {v}" for k, v in kind.items()])
    made = with_halo(df, block, max(back, 0), max(ahead, 0)).groupBy(*keys, "_block").applyInPandas(run, schema)
    return made.withColumns({k: F.when(~F.isnan(k), F.col(k)) for k in ("quantile", "rank_pct")})


def means(df: DataFrame, keys: Sequence[str], back: int, columns: dict[str, Column], block: int, ahead: int = 0) -> DataFrame:
    """`df` with the mean of each of `columns` over the rows with t in [t - back, t + ahead] of the same keys; nulls don't count, a frame without values has null.

    A window over a moving range adds up every frame anew, so its cost grows
    with the square of the rows in a range. Here a key is dealt to tasks by
    blocks of `block` of time with a halo, and a block's frames are answered
    from one tree of sums. Rows without a time are a block of their own.
    """
    kept, names = df.columns, list(columns)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("t")
        own = group["_own"].to_numpy()
        if group["t"].null_count:
            low, high = np.zeros(own.sum(), np.int64), np.full(own.sum(), len(own))
        else:
            t = group["t"].to_numpy()
            low, high = np.searchsorted(t, t[own] - back, "left"), np.searchsorted(t, t[own] + ahead, "right")
        made = group.filter(group["_own"]).select(kept)
        for k, name in enumerate(names):
            x = group[f"_x{k}"]
            n = Sums(x.is_valid().to_numpy()).over(low, high)
            total = Sums(x.fill_null(0.0).to_numpy()).over(low, high)
            made = made.append_column(name, pa.array(total / np.maximum(n, 1), mask=n == 0))
        return made

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{c}` double" for c in columns])
    wide = with_halo(df.withColumns({f"_x{k}": x.cast("double") for k, x in enumerate(columns.values())}), block, back, ahead, outer=True)
    return wide.groupBy(*keys, "_block").applyInArrow(run, schema)


def rolling_rank(df: DataFrame, keys: Sequence[str], width: int, value: str = "value", block: int | None = None) -> DataFrame:
    """(keys, t, rank_pct): rank of each value among those of the last `width` of time, itself among them, ties averaged; rows without a value are left out."""
    rows = order_statistics(df.where(F.col(value).isNotNull()), keys, width - 1, 0, block or 2 * width, value=value)
    return rows.select(*keys, "t", "rank_pct")


def spectral_bands(df: DataFrame, rows: int, stride: int, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """(keys, t, low, mid, high, dominant): energies of thirds of |DFT|^2 of windows of `rows` rows every `stride` rows, and the strongest bin but the mean.

    The transform is two sums of products with literal cosines and sines for
    each bin, inside code generation. Windows with a null are left out.
    """
    import math

    w = by_time(keys)
    full = w.rowsBetween(-(rows - 1), 0)
    win = df.withColumn("_n", F.row_number().over(w)).withColumn("_x", F.array_agg(value).over(full)).where((F.col("_n") >= rows) & ((F.col("_n") - rows) % stride == 0) & (F.size("_x") == rows))
    bins = rows // 2 + 1

    def product(waves: list[float]) -> Column:
        return F.aggregate(F.zip_with("_x", F.array(*map(F.lit, waves)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    energy = []
    for k in range(bins):
        c, s = ([f(2 * math.pi * k * i / rows) for i in range(rows)] for f in (math.cos, math.sin))
        re, im = product(c), product(s)
        energy.append(re * re + im * im)
    win = win.withColumn("_e", F.array(*energy))
    third = bins // 3
    part = lambda a, b: F.aggregate(F.slice("_e", a + 1, b - a), F.lit(0.0), lambda x, y: x + y)
    rest = F.slice("_e", 2, bins - 1)
    return win.select(*keys, "t", part(0, third).alias("low"), part(third, 2 * third).alias("mid"), part(2 * third, bins).alias("high"), F.array_position(rest, F.array_max(rest)).cast("int").alias("dominant"))


def sidak_ratio(df: DataFrame, keys: Sequence[str], channel: str, value: str, alpha: float) -> DataFrame:
    """`df` with ratio, value over its channel's (1 - alpha)^(1 / channels) quantile."""
    n = df.select(channel).distinct().count()
    q = df.groupBy(*[k for k in keys if k != "t"], channel).agg(F.percentile(value, (1 - alpha) ** (1 / max(1, n))).alias("_q"))
    return df.join(q, [*[k for k in keys if k != "t"], channel]).withColumn("ratio", F.when(F.col("_q") > 0, F.col(value) / F.col("_q"))).drop("_q")
