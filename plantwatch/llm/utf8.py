"""Vectorised work on the UTF-8 bytes of Arrow string columns.

A text column of a record batch is one byte buffer with offsets, so words,
lines and hashes of thousands of documents come from a few numpy calls without
making Python strings. Batches are cut into slices of bounded bytes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer document is one slice.
SLICE_BYTES = 2 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    """Inverse of an odd number modulo 2**64."""
    return pow(odd, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over 64 output bits; its constants are fixed public values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
#: Bytes that are hashed at once; the tables of powers are as long, whatever the texts.
_HASH_BYTES = 1 << 17
_UP, _DOWN = (np.multiply.accumulate(np.append(np.uint64(1), np.full(_HASH_BYTES, base, np.uint64))) for base in (_BASE, _inverse(_BASE)))

LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32
#: Space and the control characters from tab to carriage return.
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _long_hash(data: np.ndarray, start: int, end: int) -> int:
    """The running sum of one span that is longer than the tables of powers."""
    total = 0
    for at in range(start, end, _HASH_BYTES):
        own = _BYTE_CODES[data[at : min(end, at + _HASH_BYTES)]]
        total += int((own * _UP[: len(own)]).sum()) * pow(_BASE, at - start, 1 << 64)
    return total & 0xFFFFFFFFFFFFFFFF


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for every span, by running sums over stretches of _HASH_BYTES.

    Spans are in order and don't overlap. Besides the result, memory doesn't
    grow with the bytes; a span longer than a stretch is summed in parts.
    """
    out, at = np.zeros(len(starts), np.uint64), 0
    total = np.zeros(_HASH_BYTES + 1, np.uint64)
    while at < len(starts):
        base = int(starts[at])
        to = int(np.searchsorted(ends, base + _HASH_BYTES, side="right"))
        if to <= at:
            out[at] = _long_hash(data, base, int(ends[at]))
            at += 1
            continue
        own = _BYTE_CODES[data[base : int(ends[to - 1])]]
        np.cumsum(own * _UP[: len(own)], out=total[1 : len(own) + 1])
        a, b = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (total[b] - total[a]) * _DOWN[a]
        at = to
    return mix64(out + (ends - starts).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and n + 1 offsets; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(int(a), int(b - a))


def words(data: np.ndarray, offs: np.ndarray, blank: np.ndarray = IS_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the runs of bytes that aren't blank."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~blank[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | first[1:n]
    starts = np.flatnonzero(start)
    end = ink.copy()
    end[:-1] &= ~ink[1:] | first[1:n]
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word n-grams of each text as sorted 64-bit hashes, end to end, with n + 1 offsets.

    A text with fewer than `size` words, but one at least, has its whole word
    sequence as its only element. A text without words has no element.
    """
    data, offs = text_bytes(column)
    data, n = LOWER_AZ[data], len(column)
    starts, ends, doc = words(data, offs)
    w = span_hashes(data, starts, ends)
    per_doc = np.bincount(doc, minlength=n)
    if len(w) >= size:
        h = w[: len(w) - size + 1].copy()
        for k in range(1, size):
            h = h * np.uint64(_BASE) + w[k : len(w) - size + 1 + k]
        whole = doc[: len(h)] == doc[size - 1 :]
        h, of = mix64(h[whole]), doc[: len(h)][whole]
    else:
        h, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(of, minlength=n)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out, sizes = [], np.zeros(n, np.int64)
    first_word = np.concatenate([[0], np.cumsum(per_doc)])
    for i in range(n):
        if counts[i]:
            own = h[bounds[i] : bounds[i + 1]]
            own.sort()
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif per_doc[i]:
            acc = np.uint64(per_doc[i])
            with np.errstate(over="ignore"):
                for x in w[first_word[i] : first_word[i + 1]]:
                    acc = acc * _ODD + x
            own = mix64(np.array([acc]))
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])
