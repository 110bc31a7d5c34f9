"""Periodic runs of words by an enhanced suffix array.

A square is a stretch of words said twice in a row. Squares whose next word
breaks the repetition are found in the LCP intervals of a suffix array: for an
interval of depth d, each suffix i outside the largest child asks whether i + d
and i - d lie in the interval too, which is a look-up in the inverse array. Every
maximal run ends in such a square, so rotating squares to the left as far as
they go and merging those of equal bounds gives the runs. There are no tree
nodes: intervals are pairs of places in arrays, and all texts of a slice go
through the same numpy calls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.utf8 import slices

#: Suffixes that are tested at once.
TESTED = 1 << 21


def word_ids(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Ids of all words end to end, n + 1 offsets, and the words: equal ids are equal words of one text; texts share no id."""
    ids, bounds, split, base = [], [0], [], 0
    for x in texts:
        words = x.split() if x else []
        place = {w: base + k for k, w in enumerate(dict.fromkeys(words))}
        ids.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
        base += len(place)
        split.append(words)
        bounds.append(bounds[-1] + len(words))
    return np.concatenate(ids) if ids else np.zeros(0, np.int64), np.array(bounds), split


def prefix_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... ids, until all differ; equal ranks are equal prefixes.

    A rank is the place of the group's first suffix in the suffix array, so
    later ranks only refine, and only groups of two or more are sorted again.
    """
    n = len(ids)
    counts = np.bincount(ids, minlength=1)
    rank = (np.cumsum(counts) - counts)[ids].astype(np.int32)
    pos = np.flatnonzero(counts[ids] > 1)
    pos = pos[np.argsort(rank[pos], kind="stable")]
    ranks, step = [rank], 1
    while len(pos):
        after = pos + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1).astype(np.int64)
        key = rank[pos].astype(np.int64) * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        pos, key = pos[order], key[order]
        own = rank[pos]
        at = np.arange(len(pos))
        new = np.append(True, key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(new, at, 0))
        head = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), at, 0))
        rank = rank.copy()
        rank[pos] = own + (first - head).astype(np.int32)
        ranks.append(rank)
        alone = new & np.append(new[1:], True)
        pos = pos[~alone]
        step *= 2
    return ranks


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many ids the suffixes at a and b share from the front; with `back`, the prefixes that end before a and b from the end."""
    n, length = len(ranks[0]), np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = (a - length - (1 << k), b - length - (1 << k)) if back else (a + length, b + length)
        inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < n)
        same = inside & (ranks[k][np.clip(x, 0, n - 1)] == ranks[k][np.clip(y, 0, n - 1)])
        length += same.astype(np.int64) << k
    return length


def smaller_before(x: np.ndarray) -> np.ndarray:
    """For each element the last place before it that holds less, -1 if none: up a tree of minima, then down."""
    size = 1 << max(1, int(len(x) - 1).bit_length())
    top = np.iinfo(np.int64).max
    mins = [np.append(x, np.full(size - len(x), top))]
    while len(mins[-1]) > 1:
        mins.append(np.minimum(mins[-1][::2], mins[-1][1::2]))
    node, level = np.full(len(x), -1), np.zeros(len(x), np.int64)
    left, at = np.arange(len(x)), np.arange(len(x))
    for k in range(len(mins) - 1):
        hit = (at & 1 == 1) & (mins[k][at - 1] < x[left])
        node[left[hit]], level[left[hit]] = at[hit] - 1, k
        left, at = left[~hit], at[~hit] >> 1
    for k in range(len(mins) - 1, 0, -1):
        down = np.flatnonzero((level == k) & (node >= 0))
        right = 2 * node[down] + 1
        node[down] = np.where(mins[k - 1][right] < x[down], right, right - 1)
        level[down] = k - 1
    return node


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [lo, hi) end to end, and the range of each."""
    sizes = hi - lo
    of = np.repeat(np.arange(len(lo)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[of], of


def _small_children(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, depth, left, right) of all children of LCP intervals but the largest one of each; lcp[0] and the last are 0."""
    before, after = smaller_before(lcp), len(lcp) - 1 - smaller_before(lcp[::-1])[::-1]
    j = np.flatnonzero(lcp > 0)
    left, right = before[j], after[j]  # the interval's suffixes are left .. right - 1
    order = np.lexsort((j, right, left))
    j, left, right = j[order], left[order], right[order]
    new = np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
    group = np.cumsum(new) - 1
    end = np.where(np.append(new[1:], True), right, np.append(j[1:], 0))
    lo, hi, of = np.concatenate([left[new], j]), np.concatenate([j[new], end]), np.concatenate([group[new], group])
    rest = np.lexsort((lo - hi, of))
    rest = rest[np.append(False, of[rest][1:] == of[rest][:-1])]
    depth, left, right = lcp[j][new], left[new], right[new]
    return lo[rest], hi[rest], depth[of[rest]], left[of[rest]], right[of[rest]]


def find_runs(ids: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all maximal runs of `least` words or more, by start and period.

    A run of period q up to least / 2 repeats with a multiple of q between
    least / 4 and least / 2 too, so intervals of depth least / 4 and less are
    left out; smaller periods show when the run's words are compared.
    """
    none = np.zeros(0, np.int64)
    deep = least // 4 + 1
    ranks = prefix_ranks(ids)
    level = deep.bit_length() - 1
    if len(ranks) <= level:
        return none, none, none
    group = ranks[level]
    pos = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(pos):
        return none, none, none
    n = len(ids)
    suffixes = pos[np.argsort(ranks[-1][pos])]
    place = np.full(n, -1)
    place[suffixes] = np.arange(len(suffixes))
    pair = np.flatnonzero(group[suffixes[1:]] == group[suffixes[:-1]])
    lcp = np.zeros(len(suffixes) + 1, np.int64)
    lcp[pair + 1] = _common(ranks, suffixes[pair], suffixes[pair + 1])
    lcp[lcp < deep] = 0
    padded = np.append(ids, -1)

    lo, hi, depth, left, right = _small_children(lcp)
    squares = []
    parts = np.cumsum(hi - lo) // TESTED
    for part in np.split(np.arange(len(lo)), np.flatnonzero(np.diff(parts)) + 1) if len(lo) else []:
        at, of = _spread(lo[part], hi[part])
        of = part[of]
        d, i = depth[of], suffixes[at]
        for first in (i, i - d):  # the square starts here
            other = np.where(first == i, first + d, first)
            inside = (other >= 0) & (other < n)
            there = place[np.clip(other, 0, n - 1)]
            ok = inside & (there >= left[of]) & (there < right[of])
            ok[ok] = padded[first[ok] + d[ok]] != padded[np.minimum(first[ok] + 2 * d[ok], n)]
            squares.append(np.stack([first[ok], d[ok]]))
    if not squares:
        return none, none, none
    first, d = np.concatenate(squares, axis=1)
    start, end = first - _common(ranks, first, first + d, back=True), first + 2 * d
    long = end - start >= least
    start, end, d = start[long], end[long], d[long]
    order = np.lexsort((d, end, start))
    start, end, d = start[order], end[order], d[order]
    one = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    start, end, d = start[one], end[one], d[one]
    whole = d.copy()
    for q in range(1, deep):
        some = np.flatnonzero((whole <= least // 2) & (whole == d) & (whole % q == 0))
        same = np.ones(len(some), bool)
        for t in range(least // 2):
            same &= (t >= whole[some]) | (padded[np.minimum(start[some] + t, n)] == padded[np.minimum(start[some] + t + q, n)])
        d[some[same]] = np.minimum(q, d[some[same]])
    order = np.lexsort((d, start))
    return start[order], end[order], d[order]


def _runs(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, offs, split = word_ids(batch.column("text").cast(pa.large_binary()).to_pylist())
            start, end, period = find_runs(ids, least)
            cut = np.searchsorted(start, offs)
            held = np.zeros(len(ids) + 1, np.int64)
            np.add.at(held, start + period, 1)
            np.add.at(held, end, -1)
            kept = np.cumsum(held[:-1]) == 0
            texts = []
            for words, a, b, some in zip(split, offs, offs[1:], cut[1:] > cut[:-1], strict=False):
                texts.append(b" ".join(compress(words, kept[a:b].tolist()) if some else words))
            of = np.searchsorted(offs, start, side="right") - 1
            values = pa.StructArray.from_arrays([pa.array(start - offs[of]), pa.array(end - start), pa.array(period)], fields=list(kind.value_type))
            runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), values).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offs)), runs, pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """(id, n_words, runs, collapsed): one row for each row of `docs`.

    Words are runs of bytes other than space and the characters from tab to
    carriage return. runs are (start, length, period) by start, then period: the
    stretches of words with smallest period q, length max(`least`, 2 q) or more,
    that no word beside them continues. collapsed are the words that no run
    holds after its first q words, joined by one space.

    A null, empty or blank text has no words, no runs and an empty collapsed
    text. Repeated rows give rows of their own; other columns are ignored. A text
    is worked on whole by one task; its memory is some 200 bytes a word, and 4
    more for each doubling of its longest repeat. No shuffle.
    """
    if least < 4:
        raise ValueError("least must be 4 at least")
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(_runs(least), f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
