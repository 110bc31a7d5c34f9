"""Dropping lines that many documents share, found by two Bloom filters.

Each task fills a filter with the hashes of its lines and a second one with
those that it has met twice; merged, a bit that two tasks set counts as met
twice. Filters have a fixed size. Only lines in the second filter are
suspected and shuffled, to be counted exactly by their keys; false suspicions
cost a count, no line is missed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.tables import cut_lineage
from plantwatch.llm.utf8 import IS_BLANK, LOWER_AZ, slices, span_hashes, text_bytes

#: Bits of each filter, 16 MB, whatever the number of lines; with far more lines than a tenth of it most lines are suspected.
FILTER_BITS = 1 << 27
#: Parts in which the filters are merged.
SLICES = 64
#: Most bytes of repeated keys that are broadcast; beyond, keys go to their documents by a join.
BROADCAST_BYTES = 16 << 20


def lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts; start, end of each line and of its stripped key; lines of each document."""
    data, offs = text_bytes(column)
    breaks = np.flatnonzero(data == 10)
    n = np.searchsorted(breaks, offs[1:]) - np.searchsorted(breaks, offs[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    starts = np.zeros(int(n.sum()), np.int64)
    rest = np.ones(len(starts), bool)
    rest[first] = False
    starts[first] = offs[:-1]
    starts[rest] = breaks + 1
    ends = np.zeros(len(starts), np.int64)
    last = first + n - 1
    rest = np.ones(len(starts), bool)
    rest[last] = False
    ends[last] = offs[1:]
    ends[rest] = breaks
    ink = np.flatnonzero(~IS_BLANK[data])
    a, b = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
    some = b > a
    key_start, key_end = starts.copy(), starts.copy()
    key_start[some], key_end[some] = ink[a[some]], ink[b[some] - 1] + 1
    return data, starts, ends, key_start, key_end, n


def _keys_of(column: pa.Array, least: int) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes; lines with their hashes; whether the key has `least` code points; document of each line."""
    data, starts, ends, ks, ke, n = lines(column)
    low = LOWER_AZ[data]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return low, starts, ends, ks, ke, span_hashes(low, ks, ke), chars[ke] - chars[ks] >= max(1, least), np.repeat(np.arange(len(n)), n), n


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(FILTER_BITS - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(33)) & mask).astype(np.int64)


def _fill(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bits that a task sets in both filters, by slices of the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in slices(batches, "text"):
            *_, h, long, doc, _ = _keys_of(batch.column("text"), least)
            doc, h = doc[long], h[long]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            own = np.ones(len(h), bool)
            own[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            found, times = np.unique(h[own], return_counts=True)
            twice = np.union1d(twice, np.union1d(found[times > 1], np.intersect1d(found, once, assume_unique=True)))
            once = np.union1d(once, found)
        out = []
        for kind, h in (("once", once), ("twice", twice)):
            at = np.unique(np.concatenate(_bits(h))) if len(h) else np.zeros(0, np.int64)
            part = at // (FILTER_BITS // SLICES)
            for k in np.unique(part):
                own = at[part == k] - k * (FILTER_BITS // SLICES)
                out.append((int(k), kind, zlib.compress(own.astype(np.uint32).tobytes(), 1)))
        if out:
            part, kinds, bits = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kinds), pa.array(bits, pa.binary())], ["slice", "kind", "bits"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second filter's slices: met twice in a task, or set by two tasks."""
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, kind, raw in zip(*(batch.column(c).to_pylist() for c in ("slice", "kind", "bits")), strict=True):
            at = np.frombuffer(zlib.decompress(raw), np.uint32)
            both = twice.setdefault(k, np.zeros(FILTER_BITS // SLICES, bool))
            if kind == "twice":
                both[at] = True
            else:
                had = once.setdefault(k, np.zeros(FILTER_BITS // SLICES, bool))
                both[at[had[at]]] = True
                had[at] = True
    if twice:
        yield pa.RecordBatch.from_arrays([pa.array(list(twice), pa.int32()), pa.array([zlib.compress(np.packbits(x).tobytes(), 1) for x in twice.values()], pa.binary())], ["slice", "bits"])


def _filter(kept: Broadcast) -> np.ndarray:
    """The unpacked filter."""
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for k, raw in kept.value.items():
        own = np.frombuffer(zlib.decompress(raw), np.uint8)
        out[k * len(own) : (k + 1) * len(own)] = own
    return out


def _suspects(least: int, twice: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, id, line): the distinct suspected keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _filter(twice)
        for batch in slices(batches, "text"):
            low, _, _, ks, ke, h, long, doc, n = _keys_of(batch.column("text"), least)
            for at in _bits(h):
                long &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            some = np.flatnonzero(long)
            first_line = np.concatenate([[0], np.cumsum(n)])
            seen, rows = set(), []
            for i in some:
                key = low[ks[i] : ke[i]].tobytes()
                if (doc[i], key) not in seen:
                    seen.add((doc[i], key))
                    rows.append((key, int(doc[i]), int(i - first_line[doc[i]])))
            docs = pa.array([d for _, d, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows], pa.binary()), batch.column("id").take(docs), pa.array([x for _, _, x in rows], pa.int64())], ["key", "id", "line"])

    return run


def _drop(least: int, keys: Broadcast | None, keep_first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, n_lines, n_dropped, text) without the lines whose keys are in `keys`, or in the row's own list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = keys.value if keys is not None else {}
        known = np.sort(np.array(_hashes(list(table)), np.uint64))
        for batch in slices(batches, "text"):
            low, starts, ends, ks, ke, h, long, doc, n = _keys_of(batch.column("text"), least)
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            own = [dict(x) if x else {} for x in batch.column("keys").to_pylist()] if keys is None else None
            ask = np.flatnonzero(long & (np.isin(h, known) if keys is not None else True))
            data, _ = text_bytes(batch.column("text"))
            gone: dict[int, set[int]] = {}
            met = set()
            for i in ask:
                d, key = int(doc[i]), low[ks[i] : ke[i]].tobytes()
                found = table if own is None else own[d]
                if key not in found:
                    continue
                if keep_first and found[key] == ids[d] and (d, key) not in met:
                    met.add((d, key))
                    continue
                gone.setdefault(d, set()).add(int(i))
            first_line = np.concatenate([[0], np.cumsum(n)])
            for d, drop in gone.items():
                stay = [i for i in range(first_line[d], first_line[d + 1]) if i not in drop]
                texts[d] = b"\n".join(data[starts[i] : ends[i]].tobytes() for i in stay).decode()
            dropped = [len(gone.get(d, ())) for d in range(len(n))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n.astype(np.int64)), pa.array(dropped, pa.int64()), pa.array([t or "" for t in texts], pa.string())], ["id", "n_lines", "n_dropped", "text"])

    return run


def _hashes(keys: list[bytes]) -> np.ndarray:
    raw = b"".join(keys)
    ends = np.cumsum([len(k) for k in keys]).astype(np.int64)
    return span_hashes(np.frombuffer(raw, np.uint8), ends - np.array([len(k) for k in keys], np.int64), ends) if keys else np.zeros(0, np.uint64)


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 2, min_chars: int = 1) -> DataFrame:
    """(key, n_docs, first): the keys of lines that min_docs documents or more hold, and the smallest (id, line) of each."""
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    spark = docs.sparkSession
    bits = own.select("text").mapInArrow(_fill(min_chars), "slice int, kind string, bits binary")
    merged = bits.repartition(SLICES, "slice").mapInArrow(_merge, "slice int, bits binary").collect()  # SLICES rows of a fixed size
    twice = spark.sparkContext.broadcast({r["slice"]: bytes(r["bits"]) for r in merged})
    met = own.mapInArrow(_suspects(min_chars, twice), f"key binary, id {kind}, line long")
    counted = met.groupBy("key").agg(F.count("*").alias("n_docs"), F.min(F.struct("id", "line")).alias("first"))
    return counted.where(F.col("n_docs") >= min_docs)


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 2, min_chars: int = 1, keep: str = "first", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    r"""(id, n_lines, n_dropped, text): one row for each row of `docs`.

    Texts are split at \n; a null or empty text is one empty line. The key of a
    line is the line without ASCII white space at both ends, A-Z lower-cased.
    Of the lines whose key has min_chars code points and is in min_docs
    documents, keep="first" leaves the first line of the document with the
    smallest id, keep="none" leaves none. What stays is joined by \n. Rows that
    repeat an id count as documents of their own; with keep="first" each of
    them keeps its first line. An empty table gives no rows. Other columns are
    ignored.
    """
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    keys = cut_lineage(repeated_lines(docs, doc_id, text, min_docs, min_chars).select("key", F.col("first.id").alias("first")))
    size = keys.agg(F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0))).first()[0]
    schema = f"id {kind}, n_lines long, n_dropped long, text string"
    if size <= broadcast_bytes:
        table = docs.sparkSession.sparkContext.broadcast({bytes(r["key"]): r["first"] for r in keys.collect()})  # at most broadcast_bytes
        return own.mapInArrow(_drop(min_chars, table, keep == "first"), schema)
    everything = docs.sparkSession.sparkContext.broadcast({k: zlib.compress(b"\xff" * (FILTER_BITS // SLICES // 8), 1) for k in range(SLICES)})
    held = own.mapInArrow(_suspects(min_chars, everything), f"key binary, id {kind}, line long").join(keys, "key")
    lists = held.groupBy(F.col("id").alias("_id")).agg(F.collect_set(F.struct("key", "first")).alias("l")).select("_id", F.map_from_entries("l").alias("keys"))
    return own.join(lists, F.col("id").eqNullSafe(F.col("_id")), "left").select("id", "text", "keys").mapInArrow(_drop(min_chars, None, keep == "first"), schema)
