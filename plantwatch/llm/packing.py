"""Mixture-controlled packing of token ids into windows.

Each source is a queue of tokens. Windows are filled by deficit round-robin in
quanta of GRAIN tokens: of every window each queue gets its target share, and
what rounding withholds is owed to it in the next ones. How many quanta queue q
has had by window w follows from w and the queue totals alone: a balanced tree
over the queues splits the quanta so far at each node by floor(n * left / all),
which never falls and adds up exactly. So every task finds the places of its
own documents, and deficits carry across windows and partitions.

Queues that many sources share are sequences dealt by a second such tree over
their sources, one quantum at a time; each source has its path in it as a row.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.llm.tables import cut_lineage
from plantwatch.llm.utf8 import slices
from plantwatch.llm.word_bpe import encoder

#: Tokens of a window and of a quantum.
WINDOW, GRAIN = 4096, 64
#: Sources with queues of their own besides those with targets, the largest ones, and queues that the others are dealt to by hash.
OWN_QUEUES, SHARED_QUEUES = 192, 64
#: Most places of queues in partitions, rows of a few numbers, that are sent to all tasks; beyond, the tokens are shuffled to them.
BROADCAST_ROWS = 200_000


def exact_share(n: np.ndarray, left: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """floor(n * left / whole) of whole numbers below 2**62, whose product may pass 64 bits."""
    safe = np.maximum(whole, 1)
    q = np.floor(n.astype(np.longdouble) * left / safe).astype(np.int64)
    with np.errstate(over="ignore"):
        for _ in range(2):
            r = n * left - q * safe
            q = q - (r < 0) + (r >= safe)
    return np.where(whole > 0, q, 0)


class Schedule:
    """Places of the tokens of all queues. totals: tokens of each queue; weights: target shares, by default the totals."""

    def __init__(self, totals: list[int], weights: list[float] | None = None, window: int = WINDOW, grain: int = GRAIN) -> None:
        self.window, self.grain, self.per_window = window, grain, window // grain
        self.totals = np.array(totals, np.int64)
        self.grains = self.totals // grain
        rest = self.totals - self.grains * grain
        self.rest_start = self.grains.sum() * grain + np.concatenate([[0], np.cumsum(rest)[:-1]]) if len(totals) else rest
        self.phases = list(self._phases(self.grains.copy(), np.array(weights if weights is not None else self.grains, float)))
        self.all = int(self.totals.sum())
        whole = self.all // window * window
        ends, at = [], whole
        for bit in range(window.bit_length() - 1, -1, -1):  # the last tokens fill sequences of powers of two
            if (self.all - whole) >> bit & 1:
                at += 1 << bit
                ends.append(at)
        self.whole, self.tail_ends = whole, np.array(ends, np.int64)

    def _phases(self, left: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, tuple[np.ndarray, ...]]]:
        """(first grain of each queue, grains of each queue, first grain of all, grains of all, tree): the mixture holds until a queue is empty, then among those left."""
        start, first = np.zeros(len(left), np.int64), 0
        while left.sum():
            share = np.where(left > 0, np.maximum(weights, 1e-12), 0)
            share = share / share.sum()
            length = int(min(left.sum(), np.floor((left[left > 0] / share[left > 0]).min() + 1e-6)))
            length -= length % self.per_window
            counts = np.minimum(left, np.floor(share * length + 1e-6).astype(np.int64))
            if length < self.per_window or len(left[left > 0]) == 1 or np.allclose(share * left.sum(), left, rtol=1e-9, atol=1e-6):
                counts = left.copy()
            while counts.sum() % self.per_window and counts.sum() < left.sum():  # whole windows, but for the last
                counts[np.argmax(left - counts)] += 1
            yield start.copy(), counts, first, int(counts.sum()), self._tree(counts)
            start, left, first = start + counts, left - counts, first + int(counts.sum())

    @staticmethod
    def _tree(counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each queue its path from the root: quanta left of and in each node, and whether it turns right there."""
        depth = max(1, int(np.ceil(np.log2(max(2, len(counts))))) + 1)
        left, whole, right = (np.zeros((len(counts), depth), np.int64) for _ in range(3))
        sums = np.concatenate([[0], np.cumsum(counts)])
        for q in range(len(counts)):
            a, b, d = 0, len(counts), 0
            while b - a > 1:
                mid = (a + b) // 2
                left[q, d], whole[q, d] = sums[mid] - sums[a], sums[b] - sums[a]
                right[q, d] = q >= mid
                a, b = (mid, b) if q >= mid else (a, mid)
                d += 1
        return left, whole, right

    def _had(self, tree: tuple[np.ndarray, ...], q: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the first n quanta of a phase: those of queue q, and those of the queues before it."""
        left, whole, right = (x[q] for x in tree)
        before, n = np.zeros(len(n), np.int64), n.astype(np.int64)
        for d in range(left.shape[1]):
            turn, inner = right[:, d] == 1, whole[:, d] > 0
            part = exact_share(n, left[:, d], whole[:, d])
            before = before + np.where(turn & inner, part, 0)
            n = np.where(inner, np.where(turn, n - part, part), n)
        return n, before

    def places(self, q: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Place among all packed tokens of a token of queue q; a run within one quantum stays a run."""
        u, out = token // self.grain, np.zeros(len(q), np.int64)
        rest = u >= self.grains[q]
        out[rest] = self.rest_start[q[rest]] + (token - self.grains[q] * self.grain)[rest]
        for start, counts, first, total, tree in self.phases:
            own = np.flatnonzero(~rest & (u >= start[q]) & (u < (start + counts)[q]))
            if not len(own):
                continue
            k, x = q[own], u[own] - start[q[own]]
            near = tree[0].shape[1] + 1  # rounding moves a queue by at most one at each node
            ratio = total / counts[k]
            lo = np.maximum(0, np.floor((x - near) * ratio / self.per_window).astype(np.int64) - 1)
            hi = np.floor((x + near) * ratio / self.per_window).astype(np.int64) + 1
            while (lo < hi).any():  # the first window by whose end the queue has had more than x
                mid = (lo + hi) // 2
                had, _ = self._had(tree, k, np.minimum((mid + 1) * self.per_window, total))
                lo, hi = np.where(had > x, lo, mid + 1), np.where(had > x, mid, hi)
            had, before = self._had(tree, k, np.minimum(lo * self.per_window, total))
            _, then = self._had(tree, k, np.minimum((lo + 1) * self.per_window, total))
            out[own] = (first + lo * self.per_window + then - before + x - had) * self.grain + token[own] % self.grain
        return out

    def cut(self, place: int, length: int) -> list[int]:
        """Lengths of the parts of a run that lie in one sequence each."""
        parts = []
        while length:
            end = (place // self.window + 1) * self.window if place < self.whole else int(self.tail_ends[np.searchsorted(self.tail_ends, place, side="right")])
            parts.append(min(length, end - place))
            place, length = place + parts[-1], length - parts[-1]
        return parts

    def sequence(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence number of a place, and the place in it."""
        tail = np.searchsorted(self.tail_ends, place, side="right")
        starts = np.concatenate([[self.whole], self.tail_ends])
        late = place >= self.whole
        return np.where(late, self.whole // self.window + tail, place // self.window), np.where(late, place - starts[tail], place % self.window)


def _tokens(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        had: dict[str, int] = {}
        for batch in slices(batches, "text"):
            flat, offs = enc.encode(batch.column("text"))
            offs = offs + np.arange(len(offs))
            ids = np.full(offs[-1], end_id, enc.code)
            inner = np.ones(len(ids), bool)
            inner[offs[1:] - 1] = False
            ids[inner] = flat
            sizes, starts = np.diff(offs), []
            for s, n in zip(batch.column("queue").to_pylist(), sizes.tolist(), strict=True):
                starts.append(had.get(s, 0))
                had[s] = starts[-1] + n
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer((offs * enc.width).astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("queue"), raw.cast(pa.binary()), pa.array(sizes), pa.array(starts, pa.int64())], ["id", "queue", "ids", "n", "start"])

    return run


def _paths(grain: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of the sources (queue, all) of a shared queue: whole quanta, place of the tokens left over, and the path from the source up the tree.

    whole has the quanta of each node, side those of the side the path comes
    from, negative from the right; whole is 0 beyond the path.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("queue")
        total = group["all"].to_numpy(np.int64)
        grains = total // grain
        rest = total - grains * grain
        sums = np.concatenate([[0], np.cumsum(grains)])
        q, whole, part = np.arange(len(total)), [], []
        a, b = np.zeros_like(q), np.full_like(q, len(q))
        while (b - a > 1).any():
            mid, inner = (a + b) // 2, b - a > 1
            right = inner & (q >= mid)
            whole.append(np.where(inner, sums[b] - sums[a], 0))
            part.append(np.where(right, sums[mid] - sums[b], sums[mid] - sums[a]))
            a, b = np.where(right, mid, a), np.where(inner & ~right, mid, b)
        up = lambda x: list(np.array(x[::-1], np.int64).reshape(-1, len(q)).T)
        return pd.DataFrame({"queue": group["queue"].to_numpy(), "grains": grains, "rest_at": sums[-1] * grain + np.cumsum(rest) - rest, "whole": up(whole), "side": up(part)})

    return run


def shared_quanta(x: np.ndarray, whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Number in its shared queue of each source's quantum x; whole and part have a row of whole and side of _paths() each.

    The left side of a node has floor(n * left / whole) of its first n quanta
    and the right side the others, so quantum x of a side is that of the node
    with the least n after which the side has more than x.
    """
    for w, p in zip(whole.T, part.T, strict=True):
        side, left = np.abs(p), p > 0
        n = exact_share(x + left, w, side)
        with np.errstate(over="ignore"):
            n = n - (left & ((x + 1) * w == n * side))
        x = np.where((w > 0) & (side > 0), n, x)
    return x


def _shared(batch: pa.RecordBatch, grain: int, doc: np.ndarray, token: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, start, size, token) of pieces, tokens numbered in the shared queue instead of the source, cut at its quanta."""
    whole, part = batch.column("whole").to_pylist(), batch.column("side").to_pylist()
    depth = max((len(x) for x in whole if x is not None), default=0)
    paths = np.zeros((2, len(whole), depth), np.int64)
    for k, (w, p) in enumerate(zip(whole, part, strict=True)):
        if w:
            paths[0, k, : len(w)], paths[1, k, : len(p)] = w, p
    nested = np.array([x is not None for x in whole], bool)
    grains, rest_at = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("grains", "rest_at"))
    late = nested[doc] & (token // grain >= grains[doc])
    full = np.flatnonzero(nested[doc] & ~late)
    token = np.where(late, token + (rest_at - grains * grain)[doc], token)
    token[full] = shared_quanta(token[full] // grain, paths[0, doc[full]], paths[1, doc[full]]) * grain + token[full] % grain
    room = grain - token % grain
    at = np.repeat(np.arange(len(token)), np.where(size > room, 2, 1))
    second = np.concatenate([[False], at[1:] == at[:-1]]) if len(at) else np.zeros(0, bool)
    skip = np.where(second, room[at], 0)
    return doc[at], start[at] + skip, np.where(second, size[at] - room[at], np.minimum(size, room)[at]), token[at] + skip


def _pieces(schedule: Schedule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = schedule.grain
        for batch in slices(batches, "ids", 4 << 20):
            q, n, o = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "n", "first"))
            count = (o + n - 1) // g - o // g + 1
            doc = np.repeat(np.arange(len(n)), count)
            u = (o // g)[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            a, b = np.maximum(u * g, o[doc]), np.minimum((u + 1) * g, (o + n)[doc])
            start, size = a - o[doc], b - a
            if "whole" in batch.schema.names:
                doc, start, size, a = _shared(batch, g, doc, a, start, size)
            at = schedule.places(q[doc], a)
            late = np.flatnonzero((at // schedule.window != (at + size - 1) // schedule.window) | (at + size > schedule.whole))
            if len(late):
                keep = np.ones(len(at), bool)
                keep[late] = False
                more = [(doc[i], start[i], at[i], p) for i in late for p in [schedule.cut(int(at[i]), int(size[i]))]]
                rows = [(d, s + off, r + off, x) for d, s, r, p in more for x, off in zip(p, np.concatenate([[0], np.cumsum(p)[:-1]]), strict=True)]
                extra = np.array(rows, np.int64).reshape(-1, 4)
                doc, start, at, size = (np.concatenate([x[keep], extra[:, k]]) for k, x in enumerate((doc, start, at, size)))
                order = np.lexsort((start, doc))
                doc, start, at, size = doc[order], start[order], at[order], size[order]
            seq, off = schedule.sequence(at)
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (seq[1:] != seq[:-1]) | (at[1:] != at[:-1] + size[:-1])
            first = np.flatnonzero(new)
            size = np.add.reduceat(size, first) if len(first) else size
            doc, start, seq, off = doc[first], start[first], seq[first], off[first]
            raw = [np.frombuffer(x, f"<u{len(x) // m}").astype("<u4") for x, m in zip(batch.column("ids").to_pylist(), n, strict=True)]
            crc = [zlib.crc32(raw[d][s : s + m]) for d, s, m in zip(doc, start, size, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc)), *map(pa.array, (start, size, np.array(crc, np.int64), n[doc], seq, off))], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", source: str = "source", targets: dict[str | None, float] | None = None, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece of a document.

    A document is its token ids and end_id; a null or empty text is end_id
    alone. All tokens are packed, each once; sequences hold `window` tokens,
    but for the last few, whose sizes are different powers of two. Every window
    has the target proportions of the sources, to within a quantum a source:
    `targets` gives weights (0 for a source that isn't named), None the corpus'
    own proportions, so that all queues end together. With targets, windows
    keep to them until a source is used up and then to their ratio among the
    sources left. Sources with targets and the OWN_QUEUES largest ones have
    queues of their own, the others share SHARED_QUEUES, in which each has its
    proportion of any run of quanta; a null source is a source. Rows that
    repeat an id are documents of their own. An empty table gives no rows. Other columns
    are ignored.
    """
    own = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-")).alias("queue"), F.col(text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    tokens = own.mapInArrow(_tokens(vocabulary, end_id), f"id {kind}, queue string, ids binary, n long, start long")
    tokens = cut_lineage(tokens.withColumn("part", F.spark_partition_id()))
    parts = cut_lineage(tokens.groupBy("part", "queue").agg(F.sum("n").alias("had")))
    totals = parts.groupBy("queue").agg(F.sum("had").alias("all"))
    asked = {"-" if k is None else f"={k}": float(v) for k, v in (targets or {}).items()}
    largest = [r["queue"] for r in totals.orderBy(F.desc("all"), "queue").limit(OWN_QUEUES).collect()]
    shared = F.concat(F.lit("#"), F.pmod(F.xxhash64("queue"), F.lit(SHARED_QUEUES)).cast("string"))
    alone = sorted({*largest, *asked})
    lane = F.when(F.col("queue").isin(alone), F.col("queue")).otherwise(shared) if alone else shared
    parts = parts.withColumn("lane", lane)
    lanes = parts.groupBy("lane").agg(F.sum("had").alias("all")).orderBy("lane").collect()  # one row a queue
    names = [r["lane"] for r in lanes]
    weights = None
    if targets is not None:
        weights = [asked.get(x, 0.0) for x in names]
    schedule = Schedule([r["all"] for r in lanes], weights, window, grain)
    before = F.sum("had").over(Window.partitionBy("queue").orderBy("part")) - F.col("had")
    number = F.array_position(F.array(*map(F.lit, names)), F.col("lane")) - 1 if names else F.lit(0)
    parts = parts.select("part", "queue", before.alias("before"), number.alias("k"))
    nested: list[str] = []
    if any(x.startswith("#") for x in names):
        inner = totals.withColumn("lane", lane).where("lane like '#%'").groupBy("lane").applyInPandas(_paths(grain), "queue string, grains long, rest_at long, whole array<long>, side array<long>")
        parts, nested = parts.join(inner, "queue", "left"), ["grains", "rest_at", "whole", "side"]
    if not nested and parts.count() <= BROADCAST_ROWS:  # then the tokens stay where they are
        parts = F.broadcast(parts)
    placed = tokens.join(parts, ["part", "queue"]).select("id", "ids", "n", "k", (F.col("before") + F.col("start")).alias("first"), *nested)
    return placed.mapInArrow(_pieces(schedule), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
