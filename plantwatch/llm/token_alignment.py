"""Alignment of two tokenizers' tokens, in Arrow.

Texts are cut into chunks at spaces where neither tokenizer can join what lies
on both sides. The distinct chunks of a slice are encoded once. Their token
lists are flattened, with parent indices; segmented cumulative sums of token
bytes give the ends; an Acero join of both sides on (chunk, end) gives all
boundaries, of which those on both sides close a group. Each stretch between
boundaries is one pair of tokens that overlap. Texts follow from their chunks by
look-up: between the passes a row is one text with its distinct pairs and how
often it links each, so that no row, and no batch of rows, grows with a slice or a
partition. Spark sums the counts of pairs over all texts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.tables import cut_lineage, stored
from plantwatch.llm.utf8 import slices, text_bytes

#: Bytes of text whose distinct chunks are encoded together.
SLICE_BYTES = 1 << 20
#: Pairs, the most frequent ones, whose counts go to all tasks: 17 bytes each. The others are looked up by a join.
BROADCAST_PAIRS = 1_000_000
#: Bytes of a Parquet row group between the passes: a task that writes or reads one holds about as much, whatever its share of the input.
GROUP_BYTES = 8 << 20
#: Pairs of texts that are looked up at once; a text with more is looked up whole.
LOOKED_UP = 1 << 18
#: Code points of a chunk from which on it counts as long.
LONG = 20_000
#: Chunks that are encoded at once.
ENCODED = 5_000
#: A pair is a * PAIR + b.
PAIR = 1 << 32

#: After a space at which a text may be cut: printable ASCII, and first bytes of two-byte characters that hold no white space.
_AFTER = np.zeros(256, bool)
_AFTER[0x21:0x7F] = _AFTER[0xC3:0xE0] = True


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies (fixed values): printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(other)}


class ByteBpe:
    """Encoder and token bytes of a byte-level BPE in a tokenizers JSON file; the vocabulary's order is that of the merges."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        special, place = {x["content"] for x in known.get("added_tokens", [])}, _byte_of()
        ranks = {bytes(place[c] for c in entry): i for entry, i in known["model"]["vocab"].items() if entry not in special}
        self.bytes_of = [b""] * (max(known["model"]["vocab"].values()) + 1)
        for entry, i in ranks.items():
            self.bytes_of[i] = entry
        self._plain = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._path, self._slow = path, None

    def _long(self, chunk: str) -> list[int]:
        """The ids of a long chunk by the other library, as the first one's pattern fails on long white space."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._path)
            self._slow.encode_special_tokens = True
        return self._slow.encode(chunk, add_special_tokens=False).ids

    def encode(self, chunks: list[str]) -> list[list[int]]:
        plain = self._plain.encode_ordinary
        return [plain(x) if len(x) <= LONG else self._long(x) for x in chunks]


class PieceBpe:
    """Encoder and token bytes of a sentencepiece model that puts a space before each text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)  # no piece goes on over a space

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """Of chunks that start with a space."""
        return self._model.encode([x[1:] for x in chunks], num_threads=1)


@lru_cache(2)
def encoders(a: str, b: str) -> tuple[ByteBpe, PieceBpe]:
    return ByteBpe(a), PieceBpe(b)


@lru_cache(2)
def _numbers(a: int, b: int) -> pa.Array:
    """A's ids with a comma, A's with a bar, B's with a comma, B's with a semicolon."""
    return pa.array([f"{i}{sign}" for n, sign in ((a, ","), (a, "|"), (b, ","), (b, ";")) for i in range(n)], pa.large_string())


def chunk_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where chunks start: at each text's first byte, and at spaces between a byte that isn't one and a sign or letter.

    There both encoders cut too: the pattern of the first starts a piece at any
    space before a sign, and no piece of the second goes on over a space.
    """
    cut = np.zeros(len(data), bool)
    if len(data) > 2:
        space = data == 32
        cut[1:-1] = space[1:-1] & ~space[:-2] & _AFTER[data[2:]]
    cut[first] = True
    return np.flatnonzero(cut)


def _lists(encode: Callable[[list[str]], list[list[int]]], texts: list[str]) -> pa.ListArray:
    """Token lists of the texts; some thousands of texts at a time are Python lists."""
    sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for at in range(0, len(texts), ENCODED):
        own = encode(texts[at : at + ENCODED])
        sizes.append(np.fromiter(map(len, own), np.int64, len(own)))
        flat.append(np.fromiter(chain.from_iterable(own), np.int32, int(sizes[-1].sum())))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(sizes))), pa.int32()), pa.array(np.concatenate(flat)))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of stretches that end at `ends`."""
    total = np.append(0, np.cumsum(values))[ends]
    return np.diff(total, prepend=0)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of stretches of these sizes, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(int(sizes.sum())) + np.repeat(starts - ends + sizes, sizes)


class Aligned:
    """Groups and overlapping pairs of the token lists of many texts (here: chunks).

    ok: both sides' bytes are the text's. n_a, n_b, n_groups for each text;
    pairs and pair_ends: the overlapping pairs (a, b) of all texts end to end, in
    order, as a * PAIR + b; digest and digest_ends: "a1,a2|b1;" for each group,
    end to end. Texts that aren't ok have none of these.
    """

    def __init__(self, texts: list[bytes], a: pa.ListArray, b: pa.ListArray, a_bytes: list[bytes], b_bytes: list[bytes]) -> None:
        n = len(texts)
        sides, good = [], np.ones(n, bool)
        for lists, bytes_of in ((a, a_bytes), (b, b_bytes)):
            flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
            ends = np.asarray(lists.offsets)[1:]
            sizes = np.fromiter(map(len, bytes_of), np.int64, len(bytes_of))[flat]
            raw = b"".join(map(bytes_of.__getitem__, flat.tolist()))
            byte_ends = np.append(0, np.cumsum(sizes))[ends]
            good &= np.fromiter((raw[s:e] == t for s, e, t in zip(np.append(0, byte_ends[:-1]).tolist(), byte_ends.tolist(), texts, strict=True)), bool, n)
            sides.append((flat, pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), sizes))
        self.ok = good
        tables, counts = [], []
        for name, (flat, parent, sizes) in zip("ab", sides, strict=True):
            keep = good[parent]
            flat, parent, sizes = flat[keep], parent[keep], sizes[keep]
            total = np.cumsum(sizes)
            before = np.append(0, total)[np.searchsorted(parent, parent)]  # the sum where the token's text starts
            tables.append(pa.table({"text": pa.array(parent, pa.int32()), "end": pa.array(total - before, pa.int64()), name: pa.array(flat, pa.int32()), f"{name}_at": pa.array(np.arange(len(flat)), pa.int64())}))
            counts.append(np.bincount(parent, minlength=n))
        self.n_a, self.n_b = counts
        both = tables[0].join(tables[1], ["text", "end"], join_type="full outer", use_threads=False).sort_by([("text", "ascending"), ("end", "ascending")]).combine_chunks()
        closes = pc.and_(pc.is_valid(both["a"]), pc.is_valid(both["b"])).to_numpy(zero_copy_only=False)
        text = both["text"].to_numpy()
        # a stretch belongs to the tokens that end at its end or next after it
        of_a = pc.fill_null_backward(both["a"]).to_numpy().astype(np.int64)
        of_b = pc.fill_null_backward(both["b"]).to_numpy().astype(np.int64)
        self.pairs = of_a * PAIR + of_b
        self.pair_ends = np.cumsum(np.bincount(text, minlength=n))
        self.n_groups = np.bincount(text[closes], minlength=n)
        self._write(both, closes, tables, a_bytes, b_bytes)

    def _write(self, both: pa.Table, closes: np.ndarray, tables: list[pa.Table], a_bytes: list[bytes], b_bytes: list[bytes]) -> None:
        """The digests: tokens in the order of groups, A before B, each with its separator after it, taken from one table of texts."""
        group = np.append(0, np.cumsum(closes)[:-1]) if len(closes) else np.zeros(0, np.int64)
        size = len(a_bytes), len(b_bytes)
        own = [group[np.flatnonzero(pc.is_valid(both[x]).to_numpy(zero_copy_only=False))] for x in "ab"]
        groups = int(closes.sum())
        per = [np.bincount(g, minlength=groups) for g in own]
        place_a = np.arange(len(own[0])) + np.append(0, np.cumsum(per[1]))[own[0]]
        place_b = np.arange(len(own[1])) + np.cumsum(per[0])[own[1]]
        entry = np.zeros(len(own[0]) + len(own[1]), np.int64)
        last = [np.append(g[1:] != g[:-1], True)[: len(g)] for g in own]
        entry[place_a] = tables[0]["a"].to_numpy() + last[0] * size[0]
        entry[place_b] = tables[1]["b"].to_numpy() + 2 * size[0] + last[1] * size[1]
        said = _numbers(*size).take(pa.array(entry))
        _, offsets, data = said.buffers()
        self.digest = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        ends = np.frombuffer(offsets, np.int64)[: len(said) + 1] if len(said) else np.zeros(1, np.int64)
        self.digest_ends = ends[np.cumsum(self.n_a + self.n_b)].astype(np.int64)


def _align_slice(batch: pa.RecordBatch, a: ByteBpe, b: PieceBpe) -> dict[str, object]:
    """Per text ok, n_a, n_b, n_groups, n_links, groups_sha256; chunks of all texts, and pairs of all distinct chunks, end to end."""
    data, offs = text_bytes(batch.column("text"))
    n, some = len(offs) - 1, offs[1:] > offs[:-1]
    put = offs[:-1][some]
    data = np.insert(data, put, 32)  # every text that isn't empty gets its space
    offs = offs + np.append(0, np.cumsum(some))

    def cut(starts: np.ndarray) -> tuple[pa.DictionaryArray, Aligned]:
        bounds = np.append(starts, len(data)).astype(np.int64)
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        texts = chunks.dictionary.to_pylist()
        found = Aligned([x.encode() for x in texts], _lists(a.encode, texts), _lists(b.encode, texts), a.bytes_of, b.bytes_of)
        return chunks.indices.to_numpy().astype(np.int64), found

    first = offs[:-1][some]
    starts = chunk_starts(data, first) if b.cuts else first
    index, found = cut(starts)
    of = np.searchsorted(offs, starts, side="right") - 1
    fine = some & (np.bincount(of[~found.ok[index]], minlength=n) == 0)
    if b.cuts and (some & ~fine).any():  # a chunk differs: whether the whole text does is what counts, so take it whole
        whole = np.zeros(len(data), bool)
        whole[starts[fine[of]]] = True
        whole[offs[:-1][some & ~fine]] = True
        starts = np.flatnonzero(whole)
        index, found = cut(starts)
        of = np.searchsorted(offs, starts, side="right") - 1
        fine = some & (np.bincount(of[~found.ok[index]], minlength=n) == 0)
    stay = fine[of]
    index, of = index[stay], of[stay]
    ends = np.searchsorted(of, np.arange(n), side="right")
    size = np.diff(found.pair_ends, prepend=0)
    out = {name: _sums(x[index], ends) for name, x in (("n_a", found.n_a), ("n_b", found.n_b), ("n_groups", found.n_groups), ("n_links", size))}
    bounds = [0, *found.digest_ends.tolist()]
    digest, own = found.digest.tobytes(), list(zip(bounds, bounds[1:], strict=False))
    said, at = [], 0
    for to, good in zip(ends.tolist(), fine.tolist(), strict=True):
        if not good:
            said.append("")
            continue
        text = b"".join([digest[s:e] for s, e in map(own.__getitem__, index[at:to].tolist())])
        said.append(hashlib.sha256(text[:-1]).hexdigest())
        at = to
    # distinct chunks that stay, renumbered, and their links as numbers of distinct pairs
    used, index = np.unique(index, return_inverse=True)
    sizes = size[used]
    links = found.pairs[_ragged(np.append(0, found.pair_ends)[used], sizes)]
    coded = pa.array(links).dictionary_encode()
    return out | {"groups_sha256": said, "chunk_ends": ends, "chunks": index, "pairs": coded.dictionary.to_numpy(), "links": coded.indices.to_numpy(), "link_ends": np.cumsum(sizes)}


def _totals(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their n."""
    order = np.argsort(keys)
    keys = keys[order]
    last = np.append(keys[1:] != keys[:-1], True)[: len(keys)]
    return keys[last], _sums(n[order], np.flatnonzero(last) + 1)


def _text_pairs(got: dict[str, object]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of each text of a slice, how often the text links each, both end to end, and their ends."""
    chunks, pairs, of_text, ends = (got[k] for k in ("chunks", "pairs", "chunk_ends", "link_ends"))
    n, kinds, first = len(of_text), max(len(ends), 1), np.append(0, ends)
    # a chunk that a text holds again adds to its number, not to the links that are gone through
    text = np.repeat(np.arange(n), np.diff(of_text, prepend=0))
    own, held = np.unique(text * kinds + chunks, return_counts=True)
    text, chunk = own // kinds, own % kinds
    sizes = np.diff(first)[chunk]
    link = got["links"][_ragged(first[chunk], sizes)]
    kinds = max(len(pairs), 1)
    own, times = _totals(np.repeat(text, sizes) * kinds + link, np.repeat(held, sizes))
    return pairs[own % kinds], times, np.searchsorted(own // kinds, np.arange(n), side="right")


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _aligned(a_path: str, b_path: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = encoders(a_path, b_path)
        number = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", most):
            got = _align_slice(batch, a, b)
            pairs, times, ends = _text_pairs(got)
            bounds = pa.array(np.append(0, ends), pa.int32())
            lists = (pa.ListArray.from_arrays(bounds, pa.array(x, kind)) for x, kind in ((pairs, pa.int64()), (times, pa.int32())))
            keys = pa.array(np.arange(number, number + batch.num_rows))
            columns = [keys, batch.column("id"), *(pa.array(got[k], pa.int64()) for k in _NUMBERS), pa.array(got["groups_sha256"], pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["k", "id", *_NUMBERS, "groups_sha256", "pairs", "times"])
            number += batch.num_rows
            del got, columns, pairs, times, lists
            pa.default_memory_pool().release_unused()

    return run


def _parts(batches: Iterator[pa.RecordBatch], most: int = LOOKED_UP) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The same rows in parts of about `most` pairs, with the number of pairs of each row."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column("pairs")).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a), sizes[a:b]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold each pair, and whether its count is the highest of its B id."""
    held = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = held.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum(F.col("p.times").cast("long")).alias("n"))
    counts = cut_lineage(counts.withColumn("b", F.col("pair") % PAIR))
    top = counts.groupBy("b").agg(F.max("n").alias("top"))  # one row for each entry of B's vocabulary
    return counts.join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _scored(shared, rare: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of the texts with the sums over frequent pairs; with `rare`, instead, how often a text links each of its other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for batch, sizes in _parts(batches):
            pairs, times = (batch.column(x).flatten().to_numpy() for x in ("pairs", "times"))
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            if rare:
                columns = [np.repeat(batch.column("k").to_numpy(), sizes)[~known], pairs[~known], times[~known].astype(np.int64)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["k", "pair", "times"])
                continue
            own = np.where(known, times, 0).astype(np.int64)
            ends = np.cumsum(sizes)
            sums = [pa.array(_sums(own * values[at], ends) if len(keys) else np.zeros(len(sizes), np.int64)) for values in (best, counts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("k", "id", *_NUMBERS)), *sums, batch.column("groups_sha256")], ["k", "id", *_NUMBERS, "n_best", "count_sum", "groups_sha256"])

    return run


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", broadcast_pairs: int = BROADCAST_PAIRS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row for each row of `docs`.

    `a_path` is a byte-level BPE (tokenizers JSON), `b_path` a sentencepiece
    model, files that every executor can open. A encodes a space and the text, B
    the text, before which it puts a space itself. Offsets at which tokens of
    both end cut them into groups; a link is a pair of token occurrences whose
    bytes overlap, and a pair of ids counts the links in all texts that hold it.
    n_best are the links whose pair has the highest count of its B id, ties
    included; count_sum sums the counts over the links. groups_sha256 is of
    "a1,a2|b1;a3|b2,b3".

    Texts that are null or empty, or whose tokens' bytes aren't the space and the
    text, have noughts and an empty digest, and count for no pair. Repeated rows
    count each, and give rows of their own; other columns are ignored.

    What is written between the passes, to the shared folder, is a row for each
    text with its distinct pairs and how often it links each. Counts of
    the frequent pairs, `broadcast_pairs` at most, go to all tasks; the others, of
    which no pair is frequent, are joined by pair. A text is worked on whole by
    one task.
    """
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    numbers = ", ".join(f"{k} long" for k in _NUMBERS)
    rows, _ = stored(own.mapInArrow(_aligned(a_path, b_path, slice_bytes), f"k long, id {kind}, {numbers}, groups_sha256 string, pairs array<long>, times array<int>"), GROUP_BYTES)
    counts = cut_lineage(pair_counts(rows))
    # the least power of two from which on at most `broadcast_pairs` pairs are as frequent
    level = F.floor(F.log2("n")).cast("int")
    sizes = {r["level"]: r["pairs"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).collect()}
    least, total = 64, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > broadcast_pairs:
            break
        least = k
    frequent = counts.where(level >= least).toArrow()
    order = np.argsort(frequent["pair"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast((frequent["pair"].to_numpy()[order], frequent["n"].to_numpy()[order], frequent["best"].to_numpy(zero_copy_only=False)[order].astype(np.int8)))
    texts = rows.mapInArrow(_scored(shared, False), f"k long, id {kind}, {numbers}, n_best long, count_sum long, groups_sha256 string")
    if total == sum(sizes.values()) and least == min(sizes, default=64):
        return texts.drop("k")
    rare = rows.select("k", "pairs", "times").mapInArrow(_scored(shared, True), "k long, pair long, times long")
    rest = rare.join(counts.where(level < least), "pair").groupBy("k").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    both = texts.join(rest, "k", "left")
    plus = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return both.select("id", *_NUMBERS, plus("n_best", F.col("more_best")), plus("count_sum", F.col("more")), "groups_sha256")
