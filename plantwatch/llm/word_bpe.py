"""Token ids of whole texts by a `tokenizers` vocabulary whose tokens never span white space.

Words of up to 24 bytes are three integers, looked up for thousands of
documents at once in a table of fixed size. Those that aren't in it, letters
with or without signs after them, are merged in numpy, all words of one length
together; the tokenizer itself encodes the others.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from plantwatch.llm.utf8 import LOWER_AZ, mix64, text_bytes, words

#: Slots of the table of words, each for one word.
SLOTS = 1 << 20
#: Bytes of a word and ids of a word that fit a slot.
KEY_BYTES, SLOT_IDS = 24, 12
#: Longer words whose ids a worker keeps; when full, it starts anew.
CACHED_WORDS = 50_000

#: Signs that, after letters, are a piece of their own whatever they are.
_TAIL = ".,;:!?*%$&#|()"
_IS_TAIL = np.zeros(256, bool)
_IS_TAIL[[ord(c) for c in _TAIL]] = True
#: The pattern for which letters followed by signs are two pieces.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MASKS = np.array([(1 << 8 * min(k, 8)) - 1 for k in range(9)], np.uint64)
_NONE = np.int32(2**31 - 1)


class Merges:
    """Byte-pair merging of many words at once."""

    def __init__(self, model: dict) -> None:
        vocab = model["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves, as code points
        chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.one = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[chars[b] + "</w>"] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.new = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
        order = np.argsort(keys)
        self.keys, self.order = keys[order], order.astype(np.int32)
        grid = np.arange(256)
        self.first_ranks = self.ranks(self.one[grid][:, None], self.one[grid][None, :])
        self.last_ranks = self.ranks(self.one[grid][:, None], self.last[grid][None, :])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, _NONE for one that doesn't merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], _NONE)

    def merge(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of words of one length, a word a row of bytes; of the pairs of lowest rank the leftmost goes first."""
        m, n = rows.shape
        ids = self.one[rows]
        ids[:, -1] = self.last[rows[:, -1]]
        count = np.full(m, n)
        if n == 1:
            return ids, count
        rank = self.first_ranks[rows[:, :-1], rows[:, 1:]]
        rank[:, -1] = self.last_ranks[rows[:, -2], rows[:, -1]]
        who, own = np.arange(m), ids
        while n > 1:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(at)), at]
            go = best < _NONE
            if not go.all():
                done = ~go
                ids[who[done], :n], count[who[done]] = own[done], n
                who, own, rank, at, best = who[go], own[go], rank[go], at[go], best[go]
            if not len(who):
                break
            k = np.arange(len(who))
            own[k, at] = self.new[best]
            keep = np.ones(own.shape, bool)
            keep[k, at + 1] = False
            own = own[keep].reshape(len(who), n - 1)
            keep = np.ones(rank.shape, bool)
            keep[k, at] = False
            rank = rank[keep].reshape(len(who), n - 2)
            n -= 1
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.ranks(own[left, at[left] - 1], own[left, at[left]])
            right = np.flatnonzero(at < n - 1)
            rank[right, at[right]] = self.ranks(own[right, at[right]], own[right, at[right] + 1])
        if len(who):
            ids[who, :n], count[who] = own, n
        return ids, count


def _merges(path: str) -> Merges | None:
    """The merges of a vocabulary file; None if it has other steps than those that words of letters need."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if not plain or steps != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in cuts] != ["Split", "ByteLevel"] or cuts[0]["pattern"] != {"Regex": _PIECES} or spec.get("post_processor"):
        return None
    return Merges(model)


class WordEncoder:
    """ids of texts, word by word through a table in which each word has one slot that the next word there takes over."""

    def __init__(self, path: str, slots: int = SLOTS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.code = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = int(self.code[-1])
        self.merges = _merges(path)
        self.slots = slots
        self.keys = np.zeros((3, slots), np.uint64)
        self.ids = np.zeros((slots, SLOT_IDS), self.code)
        self.counts = np.zeros(slots, np.uint8)
        self.long: dict[bytes, np.ndarray] = {}
        self.tails: dict[int, np.ndarray] = {}

    def _slow(self, own: list[bytes]) -> list[np.ndarray]:
        """The ids of each word by the tokenizer; all words in one call, each a sequence of its own."""
        if not own:
            return []
        found = self.tokenizer.encode([w.decode() for w in own], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, self.code)
        ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(own) + 1))
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _letters(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words, padded rows of bytes: the letters as they are merged, their sizes (0: the tokenizer must take the word), and up to eight signs after them."""
        place = np.arange(KEY_BYTES)
        inside = place < sizes[:, None]
        second = np.zeros(rows.shape, bool)
        second[:, 1:] = rows[:, :-1] == 0xC3  # the letters from U+00C0 to U+00FF, but for two signs
        second &= (rows >= 0x80) & (rows <= 0xBF) & (rows != 0x97) & (rows != 0xB7)
        letter = ((rows >= 97) & (rows <= 122)) | second
        letter[:, :-1] |= (rows[:, :-1] == 0xC3) & second[:, 1:]
        core = np.where((letter | ~inside).all(axis=1), sizes, (~letter).argmax(axis=1))
        plain = (core > 0) & (sizes - core <= 8) & (_IS_TAIL[rows] | ~inside | (place < core[:, None])).all(axis=1)
        out = np.where(second & (rows < 0x9F), rows + np.uint8(32), rows)
        size = np.where(plain, core, 0)
        for i in np.flatnonzero(~plain & (rows >= 128).any(axis=1)):
            word = rows[i, : sizes[i]].tobytes().decode()
            letters = word.rstrip(_TAIL)
            low = letters.lower()
            raw = low.encode()
            if letters.isalpha() and low.isalpha() and unicodedata.is_normalized("NFC", letters) and "\u03a3" not in letters and len(raw) <= KEY_BYTES and len(word) - len(letters) <= 8:
                out[i, : len(raw)] = np.frombuffer(raw, np.uint8)
                size[i], core[i] = len(raw), len(letters.encode())
        padded = np.zeros((len(rows), KEY_BYTES + 8), np.uint8)
        padded[:, :KEY_BYTES] = rows
        tail = np.take_along_axis(padded, core[:, None] + np.arange(8), axis=1)
        tail[size == 0] = 0
        return out, size, tail.view(np.uint64)[:, 0]

    def _cold(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """(ids, number of ids) of distinct words, padded rows of bytes; those with more ids than fit are apart."""
        m = len(rows)
        ids, count = np.zeros((m, 2 * KEY_BYTES), self.code), np.zeros(m, np.int64)
        letters, core, tail = self._letters(rows, sizes) if self.merges else (rows, np.zeros(m, np.int64), np.zeros(m, np.uint64))
        for n in np.unique(core[core > 0]):
            own = np.flatnonzero(core == n)
            ids[own, :n], count[own] = self.merges.merge(letters[own, :n])
        order = np.argsort(tail, kind="stable")
        kinds, first = np.unique(tail[order], return_index=True)
        for t, own in zip(kinds.tolist(), np.split(order, first[1:]), strict=True):
            if t:
                for k, x in enumerate(self._tail(t)):
                    ids[own, count[own] + k] = x
                count[own] += len(self._tail(t))
        slow = np.flatnonzero(core == 0)
        many: dict[int, np.ndarray] = {}
        for i, x in zip(slow.tolist(), self._slow([rows[i, : sizes[i]].tobytes() for i in slow]), strict=True):
            count[i] = len(x)
            if len(x) <= SLOT_IDS:
                ids[i, : len(x)] = x
            else:
                many[i] = x
        many |= {i: ids[i, : count[i]].copy() for i in np.flatnonzero(count > SLOT_IDS).tolist() if i not in many}
        return ids[:, :SLOT_IDS], count, many

    def _tail(self, raw: int) -> np.ndarray:
        """The ids of up to eight signs, given as the number that their bytes make."""
        if raw not in self.tails:
            if len(self.tails) >= CACHED_WORDS:
                self.tails.clear()
            self.tails[raw] = self._slow([raw.to_bytes(8, "little").rstrip(b"\0")])[0]
        return self.tails[raw]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, end to end, and n + 1 offsets; a null is an empty text."""
        data, offs = text_bytes(column)
        data = LOWER_AZ[data]
        starts, ends, doc = words(data, offs)
        size = ends - starts
        padded = np.append(data, np.zeros(KEY_BYTES, np.uint8))
        eight = np.ndarray(len(padded) - 7, np.uint64, padded, strides=(1,))
        short = size <= KEY_BYTES
        nul = np.flatnonzero(data == 0)
        short[np.searchsorted(starts, nul, side="right") - 1] &= len(nul) == 0  # a key is padded with zeros
        at = np.where(short, starts, 0)
        cut = np.where(short, size, 0)
        key = [eight[at + 8 * k] & _MASKS[np.clip(cut - 8 * k, 0, 8)] for k in range(3)]
        h = mix64(key[0] + np.uint64(0x9E3779B97F4A7C15) * mix64(key[1] + np.uint64(0xD6E8FEB86659FD93) * key[2]))
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        hit = short & (self.keys[0][slot] == key[0]) & (self.keys[1][slot] == key[1]) & (self.keys[2][slot] == key[2])
        ids, count = self.ids[slot], np.where(hit, self.counts[slot], 0).astype(np.int64)
        extra: dict[int, np.ndarray] = {}
        miss = np.flatnonzero(short & ~hit)
        if len(miss):
            whole = np.stack([x[miss] for x in key], axis=1)
            _, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            if (whole != whole[first[back]]).any():  # two words with one hash
                _, first, back = np.unique(whole.view(np.dtype((np.void, KEY_BYTES))).ravel(), return_index=True, return_inverse=True)
            rows = np.ascontiguousarray(whole[first]).view(np.uint8).reshape(len(first), KEY_BYTES)
            found, n, many = self._cold(rows, size[miss[first]])
            ids[miss], count[miss] = found[back], n[back]
            if many:
                extra |= {int(miss[j]): many[int(back[j])] for j in np.flatnonzero(np.isin(back, list(many)))}
            fits = n <= SLOT_IDS
            to = slot[miss[first]][fits]
            for k in range(3):
                self.keys[k][to] = whole[first, k][fits]
            self.ids[to], self.counts[to] = found[fits], n[fits]
            # of words that met in one slot the last one has it, in all columns alike
        long = np.flatnonzero(~short)
        if len(long):
            own = [data[starts[i] : ends[i]].tobytes() for i in long]
            new = list({w for w in own if w not in self.long})
            if len(self.long) + len(new) > CACHED_WORDS:
                self.long.clear()
                new = list(set(own))
            self.long.update(zip(new, self._slow(new), strict=True))
            extra |= {int(i): self.long[w] for i, w in zip(long, own, strict=True)}
            count[long] = [len(self.long[w]) for w in own]
        total = np.concatenate([[0], np.cumsum(count)])
        flat = np.zeros(total[-1], self.code)
        inline = np.minimum(count, SLOT_IDS)
        inline[list(extra)] = 0
        place = np.repeat(total[:-1] - (np.cumsum(inline) - inline), inline) + np.arange(inline.sum()) if extra else slice(None)
        flat[place] = ids[np.arange(SLOT_IDS) < inline[:, None]]
        for i, x in extra.items():
            flat[total[i] : total[i + 1]] = x
        return flat, total[np.searchsorted(doc, np.arange(len(offs)))]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
