"""Exact null distributions of rank statistics of a trend, by counting instead of writing out orders."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Periods up to which Spearman's null is counted: its table has a row for each subset of the ranks.
SPEARMAN_PERIODS = 12


def spearman_null(doubled: Sequence[int]) -> np.ndarray:
    """How many orders of these ranks, doubled so that ties are whole, have each sum of place times rank (place from 1).

    A subset of the ranks holds the first places: the counts of a subset are
    those of it less one rank, moved on by that rank times the subset's size.
    """
    n, top = len(doubled), sum(k * r for k, r in enumerate(sorted(doubled), 1))
    counts = np.zeros((1 << n, top + 1), np.int64)
    counts[0, 0] = 1
    for subset in range(1, 1 << n):
        size = subset.bit_count()
        for k in range(n):
            if subset >> k & 1:
                move = size * doubled[k]
                if move <= top:
                    counts[subset, move:] += counts[subset ^ (1 << k), : top + 1 - move]
    return counts[-1]


def kendall_null(groups: Sequence[int]) -> list[int]:
    """How many arrangements of values, of which `groups` are equal each, have 0, 1, 2, ... inversions.

    The generating function is a product of Gaussian binomials: each group is
    merged into those before it. Python's integers don't overflow.
    """
    out, placed = [1], 0
    for size in groups:
        for k in range(1, size + 1):  # times (1 - q^(placed + k)) / (1 - q^k)
            step = placed + k
            out = [*out, *[0] * step]
            for i in range(len(out) - 1, step - 1, -1):
                out[i] -= out[i - step]
            for i in range(k, len(out)):
                out[i] += out[i - k]
            while len(out) > 1 and out[-1] == 0:
                out.pop()
        placed += size
    return out


def spearman_p(values: Sequence[float]) -> float | None:
    """Share of orders whose rank correlation with time is as far from 0 as that of the values."""
    n = len(values)
    if n < 3 or n > SPEARMAN_PERIODS:
        return None
    x = np.asarray(values, float)
    doubled = [int(2 * (x < v).sum() + (x == v).sum() + 1) for v in x]
    null = spearman_null(sorted(doubled))
    centre = n * (n + 1) * (n + 1) // 2  # the mean of the doubled sums
    seen = abs(sum(k * r for k, r in enumerate(doubled, 1)) - centre)
    return float(null[np.abs(np.arange(len(null)) - centre) >= seen].sum() / null.sum())


def kendall_p(values: Sequence[float]) -> float | None:
    """Share of arrangements of the values whose pairs in order outnumber those against it, or the other way round, by as much."""
    n = len(values)
    if n < 3:
        return None
    x = np.asarray(values, float)
    against = sum(int((x[i] > x[i + 1 :]).sum()) for i in range(n))
    groups = np.unique(x, return_counts=True)[1].tolist()
    null = kendall_null(groups)
    most = len(null) - 1  # pairs that aren't tied
    far = abs(most - 2 * against)
    return sum(c for k, c in enumerate(null) if abs(most - 2 * k) >= far) / sum(null)


def trends(df: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """(keys, periods, rho_p, tau_p): exact two-sided p of the trend of a key's values, one row a period, over all its periods.

    rho_p is Spearman's, null beyond SPEARMAN_PERIODS periods, whose subsets
    would be too many; tau_p is Kendall's, exact for any number. Fewer than three
    periods have nulls. Null values are left out; ties are kept as ties.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(period).alias("p"), F.col(value).alias("v")))), lambda x: x["v"].cast("double")).alias("_v"))

    @F.pandas_udf("rho double, tau double")
    def both(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(spearman_p(x), kendall_p(x)) for x in v], columns=["rho", "tau"], dtype=float)

    return rows.withColumn("_p", both("_v")).select(*keys, F.size("_v").cast("long").alias("periods"), F.col("_p.rho").alias("rho_p"), F.col("_p.tau").alias("tau_p"))
