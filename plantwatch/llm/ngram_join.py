"""Near-duplicate join on word n-gram sets by signature trees.

1. Equal sets become one node.
2. The elements of a set are dealt to K partitions by hash. Two sets within the
   threshold differ by D elements at most, so with K > D some partition holds
   the same elements in both: nodes that share the hash of a partition may link,
   others can't. K follows the size band of a set. The nodes of a key make a
   star around the least of them.
3. Each star is compared in one task, many stars a task; a node near the end of
   its band is in the stars of two bands.
4. There each set has a token bitmap. A signature tree's nodes hold the OR of
   the bitmaps and the range of sizes below; a dual traversal drops a pair of
   tree nodes when the greatest overlap possible can't reach the threshold, or
   when all below both is linked already. Pairs of sets that are left are
   compared exactly.
5. Stars too large for one task, with those that they meet, form blocks, which
   are dealt to tiles that share a few pivots; what isn't linked to the largest
   component of a block by then is compared with all its tiles, tile by tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.llm.components import connected_components
from plantwatch.llm.tables import cut_lineage, numbered, without_ids
from plantwatch.llm.utf8 import mix64, shingle_sets, slices

#: Set elements that one task compares at once; larger blocks are dealt to tiles.
TILE_ELEMENTS = 2_000_000
#: Bytes of text that one task compares at once.
TILE_BYTES = 16 << 20
#: Rows of a slice with one key from which on they are merged before the shuffle.
HOT_ROWS = 64
#: Names of sets that a task remembers to leave out repeats; beyond, it starts anew and repeats are merged later.
REMEMBERED = 1 << 18
#: Sets below a leaf and nodes below a node of a signature tree.
FANOUT = 8
#: Pairs of tree nodes whose children are looked at together.
PAIRS_AT_ONCE = 1 << 14
#: The widest bitmap; widths follow the largest set of a task up to here.
MOST_BITS = 1 << 16
#: Hashes by which a set is dealt, one after the other, while it has too few telling partitions.
DEALS = 6
#: Sets that every tile of a large block holds.
PIVOTS = 16
#: Most bits of the Bloom filter that is broadcast to fetch the sets of blocks (16 MB).
FILTER_BITS = 1 << 27
#: Bits of one slice of it.
SLICE_BITS = 1 << 21


class Bands:
    """Size bands, and for each the number of partitions that makes a shared one certain."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40) -> None:
        self.num, self.den = num, den
        lows, highs = [], []
        low = 1
        while low <= largest:
            high = max(low, low * den * den // (num * num))
            lows.append(low)
            highs.append(high)
            low = high + 1
        self.lows, self.highs = np.array(lows, np.int64), np.array(highs, np.int64)
        # |A xor B| <= (den - num) / (den + num) * (|A| + |B|), both sizes up to the band's highest
        self.differ = (den - num) * 2 * self.highs // (den + num)
        self.least = np.ones(len(lows), np.int64)
        self.slack = np.zeros(len(lows), np.int64)
        for i, (d, n) in enumerate(zip(self.differ, self.lows, strict=True)):
            for least in (2, 1):  # partitions with one element tell little: leave them out where few more partitions allow it
                slack = 1
                for _ in range(60):
                    k = d + 1 + slack
                    weak = k * np.exp(-n / k) * (1 + (n / k if least == 2 else 0))
                    slack = max(slack, 1 + int(np.ceil(weak + 2 * np.sqrt(weak))))
                if least == 1 or slack <= 0.45 * (d + 1):
                    break
            self.least[i], self.slack[i] = least, min(slack, 3 * d + 6)
        self.parts = self.differ + 1 + self.slack

    def classes(self, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(documents, band): each set is in its own band and, if near enough to its lower end, in the next."""
        own = np.searchsorted(self.highs, sizes)
        yield np.flatnonzero(sizes > 0), own
        yield np.flatnonzero((sizes > 0) & (self.den * sizes >= self.num * self.lows[own + 1])), own + 1


def partition_keys(sets: np.ndarray, bounds: np.ndarray, bands: Bands, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, band) rows of the wanted sets: sets that are within the threshold and differ share a key.

    Only partitions with the band's least number of elements, one or two, give
    keys, and of those a set's first D + 1, where it differs from any set within
    the threshold by D elements at most. Partitions with more elements come
    first, then by number: equal partitions hold the same in both sets, so the
    first equal one has at most D others before it in either. A set with more
    than D such partitions meets all others within the threshold there; sets
    with fewer are dealt anew by the next hash, and after the last one they
    share one key of their band.
    """
    sizes = np.diff(bounds)
    docs, keys, of_band = [], [], []
    for which, band in bands.classes(sizes):
        which = which[wanted[which] & (bands.differ[band[which]] > 0)]  # otherwise only equal sets link
        for deal in range(DEALS):
            if not len(which):
                break
            size, own = sizes[which], band[which]
            differ = (bands.den - bands.num) * (size + np.minimum(size * bands.den // bands.num, bands.highs[own])) // (bands.den + bands.num)
            at = np.repeat(bounds[which] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            h, doc = sets[at], np.repeat(np.arange(len(which)), size)
            if deal:
                h = mix64(h ^ mix64(np.array([100 + deal], np.uint64)))
                h = h[np.lexsort((h, doc))]
            k = bands.parts[own].astype(np.uint64)
            part = ((h >> np.uint64(32)) * k[doc]) >> np.uint64(32)  # grows with h, so each partition is one run
            first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])]))
            sums = np.add.reduceat(mix64(h), first)
            count = np.diff(np.append(first, len(h)))
            strong = count >= bands.least[own][doc[first]]
            given = np.bincount(doc[first[strong]], minlength=len(which))
            kept = np.flatnonzero(strong)[_leading(doc[first[strong]], count[strong], given, differ + 1)]
            first, sums = first[kept], sums[kept]
            of = doc[first]
            tag = mix64(own.astype(np.uint64) * np.uint64(1 << 40) + np.uint64(7 + deal))
            docs.append(which[of])
            of_band.append(own[of])
            keys.append(mix64(sums ^ mix64(tag[of] + part[first])))
            which = which[given <= differ]
        if len(which):
            docs.append(which)
            of_band.append(band[which])
            keys.append(mix64(mix64(band[which].astype(np.uint64) * np.uint64(1 << 40)) ^ np.uint64(0x5851F42D4C957F2D)))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(keys), np.concatenate(of_band)


def _leading(of: np.ndarray, count: np.ndarray, given: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Places, in order, of each set's `most` rows with the largest counts; `of` ascends, `given` are its rows a set. Earlier rows come first of equal counts."""
    order = np.argsort((of << 32) - count, kind="stable")
    rank = np.arange(len(of)) - np.repeat(np.cumsum(given) - given, given)
    return np.sort(order[rank < most[of[order]]])


def set_digests(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit digests of each set, 0 for an empty one."""
    sums, some = np.zeros((2, len(bounds) - 1), np.uint64), np.flatnonzero(np.diff(bounds))
    if len(some):
        for row, seed in zip(sums, (3, 5), strict=True):
            row[some] = np.add.reduceat(mix64(sets ^ mix64(np.array([seed], np.uint64))), bounds[some])
    return mix64(sums).view(np.int64)


class Naming(NamedTuple):
    """A set's name is its first digest, or its second one where different sets share the first; `bits` of the first count."""

    bits: int
    shared: tuple[int, ...] = ()

    def digests(self, sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d1, d2 = set_digests(sets, bounds)
        return (d1 if self.bits == 64 else d1 & np.int64((1 << self.bits) - 1)), d2

    def names(self, sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        d1, d2 = self.digests(sets, bounds)
        return np.where(np.isin(d1, np.array(self.shared, np.int64)), d2, d1) if self.shared else d1


def _emit(what: str, size: int, naming: Naming, num: int = 0, den: int = 1, wanted: Broadcast | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over texts: digests of every row, or partition keys or texts of the distinct sets of a task.

    Copies of a text are merged here, before anything is shuffled. Of HOT_ROWS
    sets of a slice or more that share a key the one with the least name stands
    for them, and each other one goes on as a row with it as `own` low, under
    a key of its own, so no key gathers many rows of a task. `wanted` are the
    bits of a Bloom filter of names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den) if what == "keys" else None
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            sets, bounds = shingle_sets(batch.column("text"), size)
            n = np.diff(bounds)
            if what == "digests":
                d1, d2 = naming.digests(sets, bounds)
                sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), sizes, pa.array(d1), pa.array(d2)], ["id", "n", "size", "d1", "d2"])
                continue
            node = naming.names(sets, bounds)
            new = np.zeros(len(n), bool)
            ask = n > 0 if wanted is None else (n > 0) & _in_filter(wanted.value, node)
            for i in np.flatnonzero(ask):
                name = int(node[i])
                if name not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(name)
                    new[i] = True
            if what == "keys":
                doc, key, band = partition_keys(sets, bounds, bands, new)
                key, low = _merge_keys(key, node[doc])
                alone = low == node[doc]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[doc]), pa.array(band.astype(np.int16)), pa.array(low, mask=alone)], ["key", "node", "band", "own"])
            else:
                some = pa.array(np.flatnonzero(new))
                yield pa.RecordBatch.from_arrays([pa.array(node).take(some), batch.column("text").take(some)], ["node", "text"])

    return run


def _merge_keys(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, low) of rows: where HOT_ROWS rows or more have one key, low is their least node and the others get a key of their own; else low is the node."""
    order = np.lexsort((node, key))
    first = np.ones(len(order), bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    at = np.flatnonzero(first)
    low, size = np.empty(len(order), np.int64), np.diff(np.append(at, len(order)))
    low[order] = np.where(np.repeat(size, size) >= HOT_ROWS, np.repeat(node[order[at]], size), node[order])
    return np.where(low == node, key, mix64(key ^ mix64(node.view(np.uint64)))), low


def _filter_slices(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (slice, bit): the bytes of each slice of a Bloom filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags: dict[int, np.ndarray] = {}
        for batch in batches:
            part, bit = (batch.column(c).to_numpy() for c in ("slice", "bit"))
            for k in np.unique(part):
                flags.setdefault(int(k), np.zeros(min(bits, SLICE_BITS), bool))[bit[part == k] % SLICE_BITS] = True
        if flags:
            yield pa.RecordBatch.from_arrays([pa.array(list(flags), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in flags.values()], pa.binary())], ["slice", "bytes"])

    return run


def _name_filter(names: DataFrame) -> bytes:
    """Bits of a Bloom filter of the column `node`: 16 bits a name, at most FILTER_BITS, whatever the number of names; made in slices by tasks."""
    bits, asked = 1 << 16, min(FILTER_BITS, 16 * names.count())
    while bits < asked:
        bits *= 2
    at = names.select(F.explode(F.array(F.pmod("node", F.lit(bits)), F.pmod(F.shiftright("node", 32), F.lit(bits)))).alias("bit"))
    at = at.select(F.expr(f"bit div {SLICE_BITS}").alias("slice"), "bit").repartition(-(-bits // SLICE_BITS), "slice")
    out = np.zeros(bits // 8, np.uint8)
    for row in at.mapInArrow(_filter_slices(bits), "slice long, bytes binary").collect():  # FILTER_BITS at most; an iterator would run a job a partition
        own = np.frombuffer(row["bytes"], np.uint8)
        out[row["slice"] * SLICE_BITS // 8 :][: len(own)] = own
    return out.tobytes()


def _in_filter(raw: bytes, names: np.ndarray) -> np.ndarray:
    own = np.frombuffer(raw, np.uint8)
    found = np.ones(len(names), bool)
    for bit in (names % (8 * len(own)), (names >> 32) % (8 * len(own))):
        found &= (own[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
    return found


class _Links:
    """Union-find over the sets of one task."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def labels(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                self.up = nxt
                return nxt
            up = nxt


def _levels(bits: np.ndarray, sizes: np.ndarray, extra: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Signature tree from the leaves up: (bitmap OR, least size, largest size, most elements beyond set bits)."""
    levels = [(bits, sizes, sizes, extra)]
    while len(levels[-1][0]) > FANOUT:
        b, lo, hi, ex = levels[-1]
        first = np.arange(0, len(b), FANOUT)
        levels.append((np.bitwise_or.reduceat(b, first, axis=0), np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first), np.maximum.reduceat(ex, first)))
    return levels


def link_sets(sets: list[np.ndarray], num: int, den: int, known: np.ndarray | None = None, hints: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) that link all of `sets` that similarity of num/den or more connects.

    The pairs and the equalities in `known` together have the same components
    as all links. `hints` names a set to try first for each set, -1 for none.
    With `side`, only pairs with a set of side 0 are asked for.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    links, out = _Links(n), []
    if known is not None:
        first: dict = {}
        for i, label in enumerate(known):
            links.join(i, first.setdefault(label, i))

    def similar(i: int, j: int) -> bool:
        a, b = sets[i], sets[j]
        if len(a) > len(b):
            a, b = b, a
        if not len(a) or den * len(a) < num * len(b):
            return False
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        both = int((b[at] == a).sum())
        return (num + den) * both >= num * (len(a) + len(b))

    def test(i: int, j: int) -> None:
        i, j = int(i), int(j)
        if i != j and links.root(i) != links.root(j) and similar(i, j):
            links.join(i, j)
            out.append((i, j))

    if hints is not None:
        for i in np.flatnonzero(hints >= 0):
            test(i, hints[i])
    # Similar sets often have the same least hash: neighbours in this order come near each other in the tree.
    least = np.array([[s[0], s[min(1, len(s) - 1)]] if len(s) else [0, 0] for s in sets], np.uint64).reshape(n, 2)
    order = np.lexsort((sizes, least[:, 1], least[:, 0])) if side is None else np.lexsort((sizes, least[:, 1], least[:, 0], side))
    for i, j in zip(order, order[1:], strict=False):
        test(i, j)
    if n <= FANOUT:  # the tree is one leaf
        for i in range(n):
            for j in range(i + 1, n):
                if side is None or not (side[i] and side[j]):
                    test(i, j)
        return out
    width = 64
    while width < min(MOST_BITS, 4 * int(sizes.max(initial=1))):
        width *= 2
    bits = np.zeros((n, width // 8), np.uint8)
    for row, k in enumerate(order):
        at = (sets[k] & np.uint64(width - 1)).astype(np.int64)
        flags = np.zeros(width, bool)
        flags[at] = True
        bits[row] = np.packbits(flags)
    bits = bits.view(np.uint64)
    size = sizes[order]
    extra = size - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    levels = _levels(bits, size, extra)
    split = int((side == 0).sum()) if side is not None else n  # rows of side 0 come first in the order
    top = len(levels[-1][0])
    pairs = np.array([(i, j) for i in range(top) for j in range(i, top)], np.int64).reshape(-1, 2)
    spans = [FANOUT**k for k in range(len(levels))]

    def uniform(labels: np.ndarray, span: int) -> np.ndarray:
        """The common label below each node, -1 if there are several."""
        first = np.arange(0, n, span)
        lo, hi = np.minimum.reduceat(labels, first), np.maximum.reduceat(labels, first)
        return np.where(lo == hi, lo, -1)

    grid = np.arange(FANOUT)

    def descend(depth: int, pairs: np.ndarray) -> None:
        """Pairs of nodes of one level: what may link goes on to the pairs of their children, a bounded number at a time."""
        b, lo, hi, ex = levels[depth]
        step = max(1, min(PAIRS_AT_ONCE, (1 << 22) // b.shape[1]))
        for at in range(0, len(pairs), step):
            p = pairs[at : at + step]
            i, j = p[:, 0], p[:, 1]
            u = uniform(links.labels()[order], spans[depth])
            ok = (u[i] < 0) | (u[i] != u[j])
            ok &= (den * hi[i] >= num * lo[j]) & (den * hi[j] >= num * lo[i]) & (i * spans[depth] < split)
            p, i, j = p[ok], i[ok], j[ok]
            most = np.minimum(np.bitwise_count(b[i] & b[j]).sum(axis=1).astype(np.int64) + np.minimum(ex[i], ex[j]), np.minimum(hi[i], hi[j]))
            p = p[(num + den) * most >= num * (lo[i] + lo[j])]
            if not depth:
                for x, y in p:
                    test(order[x], order[y])
            elif len(p):
                below = len(levels[depth - 1][0])
                left = (p[:, 0, None, None] * FANOUT + grid[None, :, None]).repeat(FANOUT, axis=2).reshape(-1)
                right = (p[:, 1, None, None] * FANOUT + grid[None, None, :]).repeat(FANOUT, axis=1).reshape(-1)
                ok = (left < below) & (right < below) & (left <= right)
                descend(depth - 1, np.stack([left[ok], right[ok]], axis=1))

    descend(len(levels) - 1, pairs)
    return out


def _sets_of(texts: pd.Series, words: int) -> list[np.ndarray]:
    """The set of each text, made a slice of bounded bytes at a time."""
    sets = []
    for part in slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])], "text"):
        elements, bounds = shingle_sets(part.column("text"), words)
        sets += [elements[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    return sets


def _link_unit(words: int, num: int, den: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For applyInPandas over the rows (node, text, hint, known, side) of one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "node"], ignore_index=True).drop_duplicates("node", ignore_index=True)
        names = rows["node"].to_numpy(np.int64)
        place = {int(x): i for i, x in enumerate(names)}
        sets = _sets_of(rows["text"], words)
        hints = np.array([-1 if pd.isna(x) else place.get(int(x), -1) for x in rows["hint"]], np.int64)
        side = rows["side"].to_numpy(np.int64)
        pairs = link_sets(sets, num, den, rows["known"].to_numpy(np.int64), hints, side if side.any() else None)
        return pd.DataFrame({"u": [names[i] for i, _ in pairs], "v": [names[j] for _, j in pairs]}, dtype="int64")

    return run


_UNIT = ["unit", "tile", "other", "node", "hint", "known", "side"]


def _link(units: DataFrame, texts: DataFrame, words: int, naming: Naming, num: int, den: int) -> DataFrame:
    """Links within each unit; only the texts of the units' sets are fetched, each to its units."""
    wanted = texts.sparkSession.sparkContext.broadcast(_name_filter(units.select("node").distinct()))
    held = texts.mapInArrow(_emit("texts", words, naming, wanted=wanted), "node long, text string")
    rows = units.select(_UNIT).join(held, "node")
    links = cut_lineage(rows.groupBy("unit", "tile", "other").applyInPandas(_link_unit(words, num, den), "u long, v long"))
    wanted.destroy()
    return links


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100, tile_elements: int = TILE_ELEMENTS, tile_bytes: int = TILE_BYTES, name_bits: int = 64) -> DataFrame:
    """(id, n_shingles, class_id, component_id): one row for each row of `docs`.

    Two documents link when den * |A and B| >= num * |A or B| for their sets
    of `words`-word shingles; component_id is the smallest id reachable by
    links, class_id the smallest with the same set. Words are the runs of
    characters other than ASCII white space, A-Z lower-cased. A text with fewer
    words has its whole sequence as one element; a text without words, empty or
    null, has none and links with nothing. Rows that repeat an id are documents
    of their own with one id; a row with a null id is a document too, and where
    no id is reachable the component is null. Other columns are ignored. Ids
    are whole numbers. An empty table gives no rows.

    Sets are told apart by 128 bits. `name_bits` of the first 64 are their
    names in the tables between; the few sets that share those are named by the
    other 64. By the birthday bound some n * n / 2**65 names are shared, so the
    list of them is short.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    texts = own.select("text")
    naming = Naming(name_bits)
    rows = cut_lineage(own.mapInArrow(_emit("digests", words, naming), "id long, n long, size long, d1 long, d2 long"))
    nodes = cut_lineage(rows.where("n > 0").groupBy("d1", "d2").agg(F.min("n").alias("n"), F.min("id").alias("class_id"), F.max("size").alias("size")))
    name = F.col("d1")
    shared = tuple(sorted(r["d1"] for r in nodes.groupBy("d1").count().where("count > 1").select("d1").collect()))  # few; an iterator would run a job a partition
    if shared:
        naming = Naming(name_bits, shared)
        name = F.when(F.col("d1").isin(list(shared)), F.col("d2")).otherwise(F.col("d1"))
    nodes, rows = (df.withColumn("node", name).drop("d1", "d2") for df in (nodes, rows))
    if shared and not nodes.groupBy("node").count().where("count > 1").isEmpty():
        raise RuntimeError("a second digest is the name of another set")

    keys = texts.mapInArrow(_emit("keys", words, naming, num, den), "key long, node long, band short, own long")
    low = F.coalesce("own", F.min("node").over(Window.partitionBy("key")))
    stars = keys.withColumn("low", low).where("node > low").groupBy("band", "low", "node").agg(F.count("*").alias("shared"), F.max(F.col("own").isNotNull()).alias("own"))
    stars = cut_lineage(stars)
    links = _star_links(texts, nodes, stars, words, naming, num, den, tile_elements, tile_bytes)
    linked = connected_components(links)

    named = rows.where("n > 0").join(linked, "node", "left").withColumn("group", F.coalesce("component", "node"))
    named = cut_lineage(named.select("id", "n", "node", "group"))
    least = cut_lineage(named.groupBy("group").agg(F.min("id").alias("component_id")))
    named = named.join(least, "group").join(nodes.select("node", "class_id"), "node").select("id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    alone = rows.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    return named.union(alone)


def _named(node: str) -> Column:
    """A node in its band; two that collide only make one block of two."""
    return F.xxhash64("band", node)


def _blocks(stars: DataFrame, nodes: DataFrame, tile_elements: int, tile_bytes: int) -> DataFrame:
    """(unit, node, n, size, hint, tiles, members) of the nodes that the edges of `stars` connect."""
    blocks = connected_components(stars.select(_named("node").alias("u"), _named("low").alias("v"))).select(F.col("node").alias("name"), F.col("component").alias("unit"))
    members = stars.groupBy("band", "node").agg(F.max_by("low", F.struct("shared", -F.col("low"))).alias("hint"))
    members = members.unionByName(stars.select("band", F.col("low").alias("node")).distinct(), allowMissingColumns=True).groupBy("band", "node").agg(F.max("hint").alias("hint"))
    active = members.withColumn("name", _named("node")).join(blocks, "name").join(nodes.select("node", "n", "size"), "node")
    active = cut_lineage(active.groupBy("unit", "node", "n", "size").agg(F.max("hint").alias("hint")))
    tiles = F.greatest(F.ceil(F.sum("n") / tile_elements), F.ceil(F.sum("size") / tile_bytes)).cast("int")
    weight = active.groupBy("unit").agg(tiles.alias("tiles"), F.count("*").alias("members"))
    return cut_lineage(active.join(weight, "unit"))


def _as_units(active: DataFrame) -> DataFrame:
    return active.select("unit", F.lit(0).alias("tile"), F.lit(0).alias("other"), "node", "hint", F.col("node").alias("known"), F.lit(0).alias("side"), "tiles", "members")


def _hubs(stars: DataFrame) -> DataFrame:
    """(low, hub): where the least node of a star is itself in stars of other ones, the one that it shares most keys with, two steps on.

    The stars of a group of near copies have few hubs, so that most of their
    nodes go to one task. Only nodes with two keys or more in common count.
    """
    near = stars.where("shared > 1").groupBy("node").agg(F.max_by("low", F.struct("shared", -F.col("low"))).alias("to"))
    step = near.select(F.col("node").alias("at"), F.col("to").alias("next"))
    first = near.select(F.col("node").alias("low"), F.col("to").alias("at"))
    return first.join(step, "at", "left").select("low", F.coalesce("next", "at").alias("hub"))


def _star_links(texts: DataFrame, nodes: DataFrame, stars: DataFrame, words: int, naming: Naming, num: int, den: int, tile_elements: int, tile_bytes: int) -> DataFrame:
    """(u, v) links between nodes that connect all that the links within the stars connect.

    Two sets that share a key are in the star of its least node, so each star
    is compared with all of its nodes in one task, many stars a task. Where a
    key was merged in a slice its sets are in several stars; those stars, and
    stars too large for a task, make blocks, which are compared tile by tile.
    """
    merged = cut_lineage(stars.where("own").select("band", "low").distinct())
    through = stars.join(merged.withColumnRenamed("low", "node"), ["band", "node"], "left_semi").select("band", "low")
    of_star = stars.select("band", "low", "node").union(stars.select("band", "low", F.col("low").alias("node")).distinct())
    of_star = cut_lineage(of_star.join(nodes.select("node", "n", "size"), "node"))
    large = of_star.groupBy("band", "low").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).where(f"n > {tile_elements} or size > {tile_bytes}").select("band", "low")
    apart = cut_lineage(merged.union(through).union(large).distinct())
    none_apart = apart.isEmpty()
    few = of_star if none_apart else of_star.join(apart, ["band", "low"], "left_anti")
    few = few.join(_hubs(stars), "low", "left").withColumn("hub", F.coalesce("hub", "low"))
    wide = few.groupBy("hub").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).where(f"n > {tile_elements} or size > {tile_bytes}").select("hub", F.lit(True).alias("wide"))
    few = few.join(wide, "hub", "left").withColumn("home", F.when(F.col("wide"), F.col("low")).otherwise(F.col("hub")))
    weight = few.agg(F.greatest(F.sum("n") / (tile_elements / 2), F.sum("size") / (tile_bytes / 2))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("home"), F.lit(int(weight) + 1)).alias("bucket")
    links = _link_stars(few.select(bucket, F.xxhash64("band", "low").alias("star"), "node"), texts, words, naming, num, den)
    if none_apart:
        return links
    units = _blocks(stars.join(apart, ["band", "low"], "left_semi"), nodes, tile_elements, tile_bytes)
    links = links.union(_link(_as_units(units.where("tiles = 1")), texts, words, naming, num, den))
    tiled = cut_lineage(_as_units(units.where("tiles > 1")))
    return links if tiled.isEmpty() else links.union(_large_block_links(tiled, texts, words, naming, num, den))


def _link_star_unit(words: int, num: int, den: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For applyInPandas over the rows (node, stars, text) of one task: the links within each star."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node", ignore_index=True)
        names, sets = rows["node"].to_numpy(np.int64), _sets_of(rows["text"], words)
        place = np.repeat(np.arange(len(rows)), [len(x) for x in rows["stars"]])
        star = np.concatenate([np.asarray(x, np.int64) for x in rows["stars"]])
        order = np.argsort(star, kind="stable")
        links, out = _Links(len(rows)), []
        for own in np.split(place[order], np.flatnonzero(np.diff(star[order])) + 1):
            known = np.array([links.root(int(i)) for i in own])
            if (known == known[0]).all():
                continue
            for i, j in link_sets([sets[i] for i in own], num, den, known):
                links.join(int(own[i]), int(own[j]))
                out.append((names[own[i]], names[own[j]]))
        return pd.DataFrame({"u": [a for a, _ in out], "v": [b for _, b in out]}, dtype="int64")

    return run


def _link_stars(rows: DataFrame, texts: DataFrame, words: int, naming: Naming, num: int, den: int) -> DataFrame:
    """Links within each star of `rows` (bucket, star, node); a bucket is one task, and each of its texts goes there once."""
    rows = cut_lineage(rows.groupBy("bucket", "node").agg(F.collect_set("star").alias("stars")))
    wanted = texts.sparkSession.sparkContext.broadcast(_name_filter(rows.select("node").distinct()))
    held = texts.mapInArrow(_emit("texts", words, naming, wanted=wanted), "node long, text string")
    links = cut_lineage(rows.join(held, "node").groupBy("bucket").applyInPandas(_link_star_unit(words, num, den), "u long, v long"))
    wanted.destroy()
    return links


def _large_block_links(large: DataFrame, texts: DataFrame, words: int, naming: Naming, num: int, den: int) -> DataFrame:
    """Links of blocks of several tiles: within each tile and with the pivots, then of what isn't in a block's largest component with all tiles."""
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    every_tile = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    uses = large.where("hint is not null").groupBy("unit", "hint").agg(F.count("*").alias("uses"))
    rank = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("uses"), "hint"))
    pivots = uses.withColumn("k", rank).where(f"k <= {PIVOTS}").select("unit", F.col("hint").alias("node"))
    everywhere = large.join(pivots, ["unit", "node"], "left_semi").withColumn("tile", every_tile)
    first = _link(large.withColumn("tile", tile).unionByName(everywhere), texts, words, naming, num, den)
    known = large.drop("known").join(connected_components(first), "node", "left").withColumn("known", F.coalesce("component", "node")).drop("component")
    biggest = known.groupBy("unit", "known").agg(F.count("*").alias("c")).groupBy("unit").agg(F.max_by("known", F.struct("c", "known")).alias("main"))
    known = cut_lineage(known.join(biggest, "unit"))
    asked = known.where("known <> main").groupBy("unit").agg(F.count("*").alias("asked"))
    # a tile of what is left is as large as a tile of all
    rows = known.join(asked, "unit").withColumn("others", F.ceil(F.col("tiles") * F.col("asked") / F.col("members")).cast("int"))
    ask = rows.where("known <> main").withColumn("other", F.pmod(F.xxhash64("node", F.lit(1)), F.col("others")).cast("int")).withColumn("tile", every_tile)
    told = rows.withColumn("tile", tile).withColumn("side", F.lit(1)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    pairs = cut_lineage(ask.select(_UNIT).unionByName(told.select(_UNIT)))
    return first if pairs.isEmpty() else first.union(_link(pairs, texts, words, naming, num, den))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id, with all its columns; documents without words stay.

    Of rows that repeat the smallest id one stays; a null id comes after all
    others. Columns may have any names.
    """
    verdict = near_duplicates(docs, doc_id, text, words, num, den).select("id", "component_id")
    verdict = cut_lineage(verdict)
    if not verdict.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        rows = numbered(docs)
        verdict = near_duplicates(rows.select("k", F.col(f"row.`{text}`").alias("text")), "k", "text", words, num, den).select(F.col("id").alias("k"), "component_id")
        place = F.struct(F.col(f"row.`{doc_id}`").isNull().alias("last"), F.col(f"row.`{doc_id}`").alias("id"), "k")
        placed = cut_lineage(verdict.join(rows.select("k", place.alias("place")), "k"))
        stays = placed.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.k").alias("k"))
        return rows.join(stays, "k", "left_semi").select("row.*")
    return without_ids(docs, doc_id, verdict.where("component_id < id"))
