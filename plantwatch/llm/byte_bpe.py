"""Byte-level BPE by rank files.

Texts are cut before the merges without regular expressions. Each code point
has a class, each class a transition function on a dozen states; functions
compose associatively, and their products are few, so a composition is one
table look-up. A blocked scan gives the state at every code point, and states,
classes and the next class tell where pieces start. The pieces' bytes go
through a cached pair merge.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.utf8 import slices, text_bytes

#: Pieces whose ids a Python worker keeps; when full, it starts anew.
CACHED_PIECES = 400_000
_BLOCK = 128

# Classes of code points: other letters, numbers, other signs, apostrophe, space, other white space, and the letters of 's 't 'm 'd 're 've 'll.
LETTER, NUMBER, SIGN, APOSTROPHE, SPACE, BLANK, STMD, R, V, L, E = range(11)
# States: in a run of letters, numbers or signs; after a space or other white space; after an apostrophe that starts a piece, after 'r 'v 'l, and after a whole contraction.
START, IN_LETTERS, IN_NUMBERS, IN_SIGNS, AFTER_SPACE, AFTER_BLANK, OPEN, OPEN_R, OPEN_V, OPEN_L, CLOSED, CLOSED_LONG = range(12)
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _next(state: int, kind: int) -> int:
    if kind == APOSTROPHE:
        return IN_SIGNS if state in (IN_SIGNS, AFTER_SPACE, OPEN) else OPEN
    if kind == STMD and state == OPEN:
        return CLOSED
    if state == OPEN and kind in (R, V, L):
        return {R: OPEN_R, V: OPEN_V, L: OPEN_L}[kind]
    if (state in (OPEN_R, OPEN_V) and kind == E) or (state == OPEN_L and kind == L):
        return CLOSED_LONG
    return {NUMBER: IN_NUMBERS, SIGN: IN_SIGNS, SPACE: AFTER_SPACE, BLANK: AFTER_BLANK}.get(kind, IN_LETTERS)


def _starts(state: int, kind: int) -> bool:
    """Whether a code point other than white space starts a piece; 'r 'v 'l for the time being do."""
    if state == AFTER_SPACE:
        return False
    if kind in (SIGN, APOSTROPHE):
        return state not in (IN_SIGNS, OPEN)
    if kind == NUMBER:
        return state != IN_NUMBERS
    if state == OPEN:
        return kind != STMD
    return state not in (IN_LETTERS, OPEN_R, OPEN_V, OPEN_L)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code point; composition and values of the transition functions; piece starts by state and class.

    Function k of the first eleven is that of class k, the next eleven start
    anew before it, as the first code point of a text does; then the identity.
    """
    kinds = np.full(0x110000, SIGN, np.uint8)
    for c in range(0x110000):
        g = unicodedata.category(chr(c))[0]
        if g in "LN":
            kinds[c] = LETTER if g == "L" else NUMBER
    kinds[_WHITE] = BLANK
    for chars, k in ((" ", SPACE), ("'", APOSTROPHE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        kinds[[ord(c) for c in chars]] = k
    found = [tuple(_next(s, k) for s in range(12)) for k in range(11)]
    found += [(f[START],) * 12 for f in found]
    found.append(tuple(range(12)))
    place: dict[tuple[int, ...], int] = {}
    for i, f in enumerate(found):
        place.setdefault(f, i)
    at = 0
    while at < len(found):  # all products of two functions
        for other in range(len(found)):
            for a, b in ((found[at], found[other]), (found[other], found[at])):
                if (c := tuple(b[x] for x in a)) not in place:
                    place[c] = len(found)
                    found.append(c)
        at += 1
    values = np.array(found, np.uint8)
    compose = np.array([[place[tuple(b[x] for x in a)] for b in found] for a in found], np.uint8)
    starts = np.array([[_starts(s, k) for k in range(11)] for s in range(12)])
    return kinds, compose, values, starts


def scan_states(functions: np.ndarray) -> np.ndarray:
    """State after each element: an inclusive scan by composition, block-wise and over the blocks' totals."""
    _, compose, values, _ = _tables()
    identity, n = 22, len(functions)

    def scan(f: np.ndarray) -> np.ndarray:
        if len(f) <= _BLOCK:
            out = f.copy()
            for i in range(1, len(f)):
                out[i] = compose[out[i - 1], out[i]]
            return out
        rows = -(-len(f) // _BLOCK)
        grid = np.full(rows * _BLOCK, identity, np.uint8)
        grid[: len(f)] = f
        grid = np.ascontiguousarray(grid.reshape(rows, _BLOCK).T)
        for i in range(1, _BLOCK):
            grid[i] = compose[grid[i - 1], grid[i]]
        before = np.concatenate([[identity], scan(grid[-1])[:-1]]).astype(np.uint8)
        return compose[before[None, :], grid].T.reshape(-1)[: len(f)]

    return values[scan(functions), START] if n else np.zeros(0, np.uint8)


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each code point starts a piece; `first` marks the first one of each text."""
    kinds, _, _, starts = _tables()
    kind = kinds[points]
    state = scan_states(kind + np.uint8(11) * first)
    before = np.full(len(kind), START, np.uint8)
    before[1:] = state[:-1]
    before[first] = START
    white = (kind == SPACE) | (kind == BLANK)
    out = starts[before, kind]
    after_white = (before == AFTER_SPACE) | (before == AFTER_BLANK)
    next_ink = np.zeros(len(kind), bool)
    next_ink[:-1] = ~white[1:] & ~first[1:]
    out[white] = (~after_white | next_ink)[white]
    long = np.flatnonzero(state == CLOSED_LONG)
    out[long] = out[long - 1] = False
    return out | first


class Bpe:
    """Ids of pieces by pair merging in the order of ranks, and bytes of ids."""

    def __init__(self, path: str, cached: int = CACHED_PIECES) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.bytes_of = {i: x for x, i in self.ranks.items()}
        self.known: dict[bytes, bytes] = {}
        self.most = cached

    def merge(self, piece: bytes) -> list[bytes]:
        """The tokens of a piece: the adjacent pair of least rank merges first, the leftmost of equals."""
        ranks = self.ranks
        if piece in ranks:
            return [piece]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 400:
            return self._merge_long(parts)
        pair = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, r in enumerate(pair):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pair[at]
            if at < len(pair):
                pair[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                pair[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def _merge_long(self, parts: list[bytes]) -> list[bytes]:
        """The same with a heap and linked parts, for pieces whose length squared would be too much."""
        import heapq

        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        own: list[bytes | None] = list(parts)
        heap = [(r, i, i + 1, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if own[i] is None or j >= n or own[j] is None or after[i] != j or len(own[i]) + len(own[j]) != size:
                continue
            own[i], own[j] = own[i] + own[j], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(own[a] + own[b])) is not None:
                    heapq.heappush(heap, (r, a, b, len(own[a]) + len(own[b])))
        return [x for x in own if x is not None]

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """For each piece its ids as little-endian unsigned 32-bit integers."""
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for p in pieces:
                if p not in known:
                    known[p] = b"".join(self.ranks[t].to_bytes(4, "little") for t in self.merge(p))
            return [known[p] for p in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(4)
def bpe(path: str) -> Bpe:
    """The worker's vocabulary of a rank file."""
    return Bpe(path)


def _encode(path: str, offsets: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe(path)
        for batch in slices(batches, "text"):
            data, offs = text_bytes(batch.column("text"))
            raw = data.tobytes()
            points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
            at = np.flatnonzero((data & 0xC0) != 0x80)
            first = np.isin(at, offs[:-1])
            starts = at[piece_starts(points, first)]
            cut = np.searchsorted(starts, offs)
            ends = np.append(starts[1:], len(raw))
            bounds = [*zip(starts.tolist(), ends.tolist(), strict=True)]
            ids, places = [], []
            for a, b in zip(cut, cut[1:], strict=False):
                pieces = [raw[s:e] for s, e in bounds[a:b]]
                own = vocabulary.encode(pieces)
                ids.append(b"".join(own))
                if offsets:
                    sizes = np.array([len(vocabulary.bytes_of[i]) for i in np.frombuffer(ids[-1], "<u4").tolist()], np.int64)
                    places.append((np.cumsum(sizes) - sizes).astype("<u4").tobytes())
            columns = [batch.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            names = ["id", "n_tokens", "ids"]
            if offsets:
                columns.append(pa.array(places, pa.binary()))
                names.append("offsets")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, ranks: str, doc_id: str = "doc_id", text: str = "text", offsets: bool = True) -> DataFrame:
    """(id, n_tokens, ids[, offsets]): one row for each row of `docs`.

    ids are little-endian unsigned 32-bit integers end to end, offsets the
    first byte of each token in the text's UTF-8, likewise. `ranks` is a rank
    file that every executor can open. No special tokens. A null or empty text
    has no tokens. Rows that repeat an id give rows of their own; other columns
    are ignored.
    """
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(_encode(ranks, offsets), f"id {kind}, n_tokens long, ids binary" + ", offsets binary" * offsets)


def decode(tokens: DataFrame, ranks: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """`tokens` with one more column, the bytes that the ids stand for; null ids give null."""
    schema = tokens.select("*", F.lit(None).cast("binary").alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe(ranks)
        for batch in slices(batches, ids, 4 << 20):
            out = [None if x is None else vocabulary.decode(np.frombuffer(x, "<u4")) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, into])

    return tokens.mapInArrow(run, schema)
