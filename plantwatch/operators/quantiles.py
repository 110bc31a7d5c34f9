"""Exact quantiles of groups of any size, by selection in rounds.

`percentile` keeps every distinct value of a group in one task. Here a mergeable
sketch of each group brackets each rank; an aggregate counts what lies below,
on and inside the bracket; and the next sketch is of the inside alone. Once a
bracket holds few rows they are sorted. Every pass is one aggregate with partial
sums, so no task holds a group, and each narrows a bracket some hundred times.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.operators.lineage import cut_lineage

#: Rows of a group, or of a bracket, that one task may hold and sort.
SORTED_ROWS = 100_000
#: Stretches that a sketch cuts a group into, and its accuracy.
PARTS, ACCURACY = 256, 4096


def _same(keys: Sequence[str], side: str) -> Column:
    found = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"{side}{k}"))
        found = one if found is None else found & one
    return found if found is not None else F.lit(True)


def _matched(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """`left` with the other columns of `right`, by null-safe equality of `on`."""
    own = right.select(*(F.col(c).alias(f"_r{c}" if c in on else c) for c in right.columns))
    return left.join(own, _same(on, "_r"), how).drop(*(f"_r{c}" for c in on))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame, rows: int = SORTED_ROWS) -> DataFrame:
    """(keys, rank, x): the value of each rank from 0 among its group's values that aren't null; `ranks` (keys, rank) asks, distinct.

    A rank that a group doesn't have gives no row. Keys may be null.
    """
    source = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    names = [f"_k{k}" for k in keys]
    renamed = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    asked = ranks.select(*renamed, F.col("rank").cast("long").alias("rank"))
    # a target: the rank within the rows strictly between lo and hi (null: no bound), and how many these are once known
    open_ = cut_lineage(asked.select(*names, "rank", F.col("rank").alias("within"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("few")))
    found = None
    grid = F.array(*(F.lit(k / PARTS) for k in range(PARTS + 1)))
    inside = (F.col("lo").isNull() | (F.col("_x") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("_x") < F.col("hi")))
    while True:
        targets = open_.where(~F.col("few"))
        if targets.isEmpty():
            break
        # targets of one bracket share its sketch
        brackets = targets.select(*names, "lo", "hi").distinct()
        held = source.join(brackets, _same(keys, "_k")).where(inside)
        sketch = held.groupBy(*names, "lo", "hi").agg(F.count("*").alias("n"), F.percentile_approx("_x", grid, F.lit(ACCURACY)).alias("s"))
        near = _matched(targets, sketch, (*names, "lo", "hi")).where(F.col("within") < F.col("n"))
        few = near.where(F.col("n") <= rows).select(*names, "rank", "within", "lo", "hi", F.lit(True).alias("few"))
        place = F.floor(F.col("within") / F.col("n") * PARTS).cast("int")
        cut = near.where(F.col("n") > rows).withColumn("a", F.get("s", F.greatest(place - 2, F.lit(0)))).withColumn("b", F.get("s", F.least(place + 3, F.lit(PARTS))))
        cut = cut_lineage(cut.select(*names, "rank", "within", "lo", "hi", "a", "b"))
        x = F.col("_x")
        counted = source.join(cut.select(*names, "lo", "hi", "a", "b").distinct(), _same(keys, "_k")).where(inside).groupBy(*names, "lo", "hi", "a", "b")
        counted = counted.agg(F.count_if(x < F.col("a")).alias("below"), F.count_if(x == F.col("a")).alias("on_a"), F.count_if((x > F.col("a")) & (x < F.col("b"))).alias("between"), F.count_if((x == F.col("b")) & (F.col("b") > F.col("a"))).alias("on_b"))
        r = _matched(cut, counted, (*names, "lo", "hi", "a", "b"))
        low, mid = F.col("below") + F.col("on_a"), F.col("below") + F.col("on_a") + F.col("between")
        w = F.col("within")
        where = F.when(w < F.col("below"), 0).when(w < low, 1).when(w < mid, 2).when(w < mid + F.col("on_b"), 3).otherwise(4)
        r = cut_lineage(r.select("*", where.alias("where"), low.alias("low"), (mid + F.col("on_b")).alias("top")))
        hit = r.where("where in (1, 3)").select(*names, "rank", F.when(F.col("where") == 1, F.col("a")).otherwise(F.col("b")).alias("x"))
        found = hit if found is None else found.union(hit)
        # below and above the bracket, should a sketch be off, and inside it
        parts = {0: ("within", "lo", "a"), 2: ("within - low", "a", "b"), 4: ("within - top", "b", "hi")}
        again = [r.where(F.col("where") == k).select(*names, "rank", F.expr(p).alias("within"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.lit(False).alias("few")) for k, (p, lo, hi) in parts.items()]
        open_ = open_.where("few").union(few)
        for part in again:
            open_ = open_.union(part)
        open_ = cut_lineage(open_)
    last = source.join(open_.select(*names, "lo", "hi").distinct(), _same(keys, "_k")).where(inside).groupBy(*names, "lo", "hi").agg(F.array_sort(F.collect_list("_x")).alias("v"))
    rest = _matched(open_, last, (*names, "lo", "hi")).select(*names, "rank", F.get("v", F.col("within").cast("int")).alias("x"))
    whole = rest if found is None else found.union(rest)
    return whole.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), "rank", "x")


def interpolated(low: Column, high: Column, part: Column) -> Column:
    """The point `part` of the way from `low` to `high`: low * (1 - part) + high * part with one rounding less, a fused multiply-add, as DuckDB's quantile_cont has it.

    On two equal values it may be off them by one unit in the last place, which decides whether rows of that value are below it.
    """
    fused = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - part, high * part).cast("double")
    return F.when(part == 0, low).when(low.isNotNull() & high.isNotNull(), fused)


def cut_points(df: DataFrame, keys: Sequence[str], value: str, columns: dict[str, float], rows: int = SORTED_ROWS) -> DataFrame:
    """(keys, columns): quantiles of each group that rows are compared with, to the last bit those of quantile_cont in DuckDB.

    Values are held against these points, so a difference in the last bit moves
    the rows that tie with one. The two ranks beside each point are selected, of
    groups of any size.
    """
    df = cut_lineage(df.select(*keys, value))  # read once a round
    sizes = cut_lineage(df.groupBy(*keys).agg(F.count(value).alias("_n")))
    place = {c: F.lit(float(q)) * (F.col("_n") - 1) for c, q in columns.items()}
    both = F.array(*(f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)))
    ranks = sizes.where("_n > 0").select(*keys, F.explode(F.array_distinct(both)).alias("rank"))
    got = order_statistics(df, keys, value, ranks, rows).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("_m"))  # two entries a point at most
    at = lambda f, p: F.element_at("_m", f(p).cast("long"))
    points = {c: interpolated(at(F.floor, p), at(F.ceil, p), p - F.floor(p)) for c, p in place.items()}
    return _matched(sizes, got, keys, "left").select(*keys, *(x.alias(c) for c, x in points.items()))


def position(cuts: str, most: int, before: Callable[[Column], Column]) -> Column:
    """How many elements of the array `cuts`, `most` at the most, fulfil `before`, which those in front fulfil and the others don't; by halving."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(most.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(before(F.get(cuts, n + step - 1)), step).otherwise(0))


def sorted_points(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys, points): an array of the quantiles of each group, in the order of `shares`, to the last bit those of quantile_cont in DuckDB.

    For many shares at once: a sketch cuts each group into buckets, whose counts
    say in which bucket each rank lies, and the values of those buckets are
    counted and numbered. Three passes whatever the number of shares, and a task
    holds the distinct values of a bucket. Rows with a null key and groups
    without values are left out.
    """
    source = df.dropna(subset=[*keys, value]).select(*keys, F.col(value).cast("double").alias("_x"))
    source = cut_lineage(source.groupBy(*keys, "_x").agg(F.count("*").alias("_c")))
    grid = F.expr(f"array({', '.join(f'{k / PARTS!r}D' for k in range(1, PARTS))})")
    sketch = cut_lineage(source.groupBy(*keys).agg(F.percentile_approx("_x", grid, F.lit(ACCURACY)).alias("_cuts")))
    dealt = source.join(F.broadcast(sketch), list(keys)).withColumn("_b", position("_cuts", PARTS - 1, lambda y: y < F.col("_x"))).drop("_cuts")  # a row a group
    along = Window.partitionBy(*keys).orderBy("_b")
    whole = Window.partitionBy(*keys)
    buckets = dealt.groupBy(*keys, "_b").agg(F.sum("_c").alias("_in"))
    buckets = cut_lineage(buckets.select(*keys, "_b", (F.sum("_in").over(along) - F.col("_in")).alias("_from"), F.sum("_in").over(along).alias("_to"), F.sum("_in").over(whole).alias("_n")))
    # each share's two ranks and its place between them
    listed = F.posexplode(F.expr(f"array({', '.join(f'{float(q)!r}D' for q in shares)})")).alias("_s", "_q")
    place = F.col("_q") * (F.col("_n") - 1)
    asked = buckets.groupBy(*keys).agg(F.first("_n").alias("_n")).select(*keys, "_n", listed).select(*keys, "_s", F.floor(place).alias("_low"), F.ceil(place).alias("_high"), (place - F.floor(place)).alias("_part"))
    ranks = asked.select(*keys, F.explode(F.array("_low", "_high")).alias("_rank")).distinct().join(buckets, list(keys)).where("_rank >= _from and _rank < _to")
    ranks = cut_lineage(ranks.groupBy(*keys, "_b", "_from").agg(F.collect_list("_rank").alias("_ranks")))
    held = dealt.join(F.broadcast(ranks), [*keys, "_b"])  # at most a row a bucket
    held = held.withColumn("_upto", F.col("_from") + F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.filter("_ranks", lambda r: (r >= F.col("_upto") - F.col("_c")) & (r < F.col("_upto")))
    got = held.select(*keys, F.explode(inside).alias("_rank"), "_x")
    beside = lambda rank, x: got.select(*keys, F.col("_rank").alias(rank), F.col("_x").alias(x))
    got = cut_lineage(got)
    point = interpolated(F.col("_lx"), F.col("_hx"), F.col("_part"))
    points = asked.join(beside("_low", "_lx"), [*keys, "_low"]).join(beside("_high", "_hx"), [*keys, "_high"]).select(*keys, "_s", point.alias("_y"))
    return points.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_y"))), lambda x: x["_y"]).alias("points"))  # an element a share


def quantiles(df: DataFrame, keys: Sequence[str], value: str, columns: dict[str, float], rows: int = SORTED_ROWS, within: DataFrame | None = None) -> DataFrame:
    """(keys, columns): what `percentile` gives for each share, linear between ranks, of the values of each group that aren't null.

    Groups of up to `rows` rows, which a task can hold, go to `percentile`; the
    ranks of larger ones are selected in rounds. The results are the same. A
    group without values has nulls. `within` may name a frame that is cheaper to
    count than `df` and has the keys and as many rows a group at least.
    """
    some = df.select(*keys, F.col(value).alias("_v"))
    shares = F.array(*(F.lit(float(q)) for q in columns.values()))
    plain = lambda g: g.agg(F.percentile("_v", shares).alias("_q")).select(*keys, *(F.get("_q", F.lit(k)).alias(c) for k, c in enumerate(columns)))
    counted = some if within is None else within
    if (counted.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= rows:
        return plain(some.groupBy(*keys))
    sizes = cut_lineage(some.groupBy(*keys).agg(F.count("_v").alias("_n")))
    large = sizes.where(F.col("_n") > rows)
    small = sizes.where(F.col("_n") <= rows).select(*(F.col(k).alias(f"_k{k}") for k in keys))
    place = {c: F.lit(q) * (F.col("_n") - 1) for c, q in columns.items()}
    both = F.array(*(f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)))
    ranks = large.select(*keys, F.explode(F.array_distinct(both)).alias("rank"))
    got = order_statistics(some, keys, "_v", ranks, rows).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("_m"))  # two entries a share at most
    got = got.select(*(F.col(k).alias(f"_k{k}") for k in keys), "_m")
    at = lambda f, p: F.element_at("_m", f(p).cast("long"))
    between = {c: at(F.floor, p) + (at(F.ceil, p) - at(F.floor, p)) * (p - F.floor(p)) for c, p in place.items()}
    chosen = large.join(got, _same(keys, "_k")).select(*keys, *(x.alias(c) for c, x in between.items()))
    rest = some.join(small, _same(keys, "_k"), "left_semi") if keys else some.where("false")
    return (plain(rest.groupBy(*keys)) if keys else chosen.where("false")).union(chosen)
