"""Quality rules as a short-circuit cascade.

A rule is a test on statistics of a text. Every statistic has a cost and every
rule rejects some share of the texts; both are estimated on a sample. Rules then
run in the order of rejection per cost, each only on the texts that the rules
before it have left, and a statistic is counted only for texts that still need
it. The order decides the time taken, never which texts stay.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.periodic_runs import word_ids
from plantwatch.llm.utf8 import IS_BLANK, mix64, slices, words

#: Rows, about, that costs and rejections are estimated on; they set the order alone.
SAMPLE_ROWS = 4000
#: Words of a window whose repetition is counted.
WINDOW = 5


def _members(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOLS = _members(b"#*$%&|<>")
_CAPITALS = _members(bytes(range(65, 91)))
_LETTERS = _members(bytes([*range(65, 91), *range(97, 123), *range(0x80, 0x100)]))


class Texts:
    """UTF-8 texts of a slice, with what several statistics share made once."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts = texts
        self._kept: dict[str, object] = {}

    def __len__(self) -> int:
        return len(self.texts)

    def _once(self, name: str, make: Callable[[], object]) -> object:
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    @property
    def data(self) -> np.ndarray:
        return self._once("data", lambda: np.frombuffer(b"".join(self.texts), np.uint8))

    @property
    def offs(self) -> np.ndarray:
        return self._once("offs", lambda: np.cumsum([0, *map(len, self.texts)]))

    @property
    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of all words."""
        return self._once("spans", lambda: words(self.data, self.offs))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have the flag."""
        total = np.append(0, np.cumsum(flags))
        return total[self.offs[1:]] - total[self.offs[:-1]]


def n_words(x: Texts) -> np.ndarray:
    return np.bincount(x.spans[2], minlength=len(x)).astype(np.int64)


def word_chars(x: Texts) -> np.ndarray:
    """Code points in words."""
    return x.per_text(~IS_BLANK[x.data] & ((x.data & 0xC0) != 0x80))


def n_symbols(x: Texts) -> np.ndarray:
    return x.per_text(_SYMBOLS[x.data])


def n_capitals(x: Texts) -> np.ndarray:
    return x.per_text(_CAPITALS[x.data])


def n_letter_words(x: Texts) -> np.ndarray:
    """Words with a letter A-Z or a-z or a character outside ASCII."""
    starts, ends, of = x.spans
    total = np.append(0, np.cumsum(_LETTERS[x.data]))
    return np.bincount(of[total[ends] > total[starts]], minlength=len(x)).astype(np.int64)


def _lines(x: Texts) -> list[list[bytes]]:
    return x._once("lines", lambda: [[line for line in t.split(b"\n") if line.strip()] for t in x.texts])


def n_lines(x: Texts) -> np.ndarray:
    """Lines with a word."""
    return np.array([len(own) for own in _lines(x)], np.int64)


def n_dup_lines(x: Texts) -> np.ndarray:
    """Lines with a word that equal an earlier line."""
    return np.array([len(own) - len(set(own)) for own in _lines(x)], np.int64)


def repeated_windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Whether the window of `size` ids at each place is found elsewhere too; equal hashes are compared."""
    n = len(ids) - size + 1
    if n < 2:
        return np.zeros(max(n, 0), bool)
    code = mix64(ids.astype(np.uint64) + np.uint64(1))
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + code[k : n + k]
    same = lambda a, b: np.logical_and.reduce([ids[a + k] == ids[b + k] for k in range(size)])
    order = np.argsort(key, kind="stable")
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(key[a] == key[b])
    equal = same(a[near], b[near])
    if not equal.all():  # two windows of one hash: sort the ids themselves
        order = np.lexsort([ids[k : n + k] for k in range(size)])
        a, b = order[:-1], order[1:]
        near = np.flatnonzero(same(a, b))
    out = np.zeros(n, bool)
    out[a[near]] = out[b[near]] = True
    return out


def n_repeat_words(x: Texts) -> np.ndarray:
    """Words that lie in a window of five words found twice or more in the text."""
    ids, offs, _ = word_ids(x.texts)
    held = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(repeated_windows(ids, WINDOW))
    np.add.at(held, at, 1)
    np.add.at(held, at + WINDOW, -1)
    total = np.append(0, np.cumsum(np.cumsum(held[:-1]) > 0))
    return total[offs[1:]] - total[offs[:-1]]


STATISTICS: dict[str, Callable[[Texts], np.ndarray]] = {f.__name__: f for f in (n_words, word_chars, n_symbols, n_capitals, n_letter_words, n_lines, n_dup_lines, n_repeat_words)}


@dataclass(frozen=True)
class Rule:
    """Rejects the texts for which `fails` holds; `fails` gets the arrays of the statistics in `needs`."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[..., np.ndarray]


FEW_WORDS = Rule("few_words", ("n_words",), lambda n: n < 10)
REPEATS = Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 20 * n)
#: The base rules and those that tables, markup, shouting and boilerplate fail; whole numbers, so that the verdict is exact.
RULES = (
    FEW_WORDS,
    REPEATS,
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > n),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n, d: 2 * d > n),
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 15 * n)),
    Rule("letterless_words", ("n_words", "n_letter_words"), lambda n, w: 2 * w < n),
    Rule("capitals", ("word_chars", "n_capitals"), lambda c, u: 2 * u > c),
)


class _Counted:
    """Statistics of the texts of a slice, each counted when first asked for and for the texts asked for."""

    def __init__(self, texts: list[bytes]) -> None:
        self.all, self.values = Texts(texts), {}

    def get(self, name: str, alive: np.ndarray, part: Texts) -> np.ndarray:
        if name not in self.values:
            full = np.zeros(len(self.all), np.int64)
            full[alive] = STATISTICS[name](part)
            self.values[name] = full
        return self.values[name][alive]


def _judge(texts: list[bytes], rules: Sequence[Rule], report: Sequence[str]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """For each text the number of the rule that rejects it, -1 if none, how many rules looked at it, and the reported statistics."""
    counted = _Counted(texts)
    alive, part = np.arange(len(texts)), counted.all
    by, looked = np.full(len(texts), -1), np.zeros(len(texts), np.int64)
    for name in report:
        counted.get(name, alive, part)
    for k, rule in enumerate(rules):
        if not len(alive):
            break
        looked[alive] += 1
        bad = rule.fails(*(counted.get(name, alive, part) for name in rule.needs))
        if bad.any():
            by[alive[bad]] = k
            alive = alive[~bad]
            part = Texts([texts[i] for i in alive])
    return by, looked, {name: counted.values[name] for name in report}


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]


@dataclass(frozen=True)
class Profile:
    """What a sample shows: seconds of each statistic, and rows by the rules that they fail, bit k for rule k."""

    seconds: dict[str, float]
    rows: dict[int, int]


def profile(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> Profile:
    """Costs and verdicts on about `rows` rows drawn at random; what reaches the driver is one number for each statistic and each set of rules that fail together."""
    rules = tuple(rules)
    names = list(dict.fromkeys(n for r in rules for n in r.needs))
    size = docs.count()
    some = docs.select(F.col(text).alias("text"))
    if size > rows:
        some = some.sample(rows / size, seed=11)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, seconds, values = _texts(batch), [], {}
            for name in names:
                at = time.thread_time()
                values[name] = STATISTICS[name](Texts(x))
                seconds.append(time.thread_time() - at)
            bits = sum(rule.fails(*(values[n] for n in rule.needs)).astype(np.int64) << k for k, rule in enumerate(rules))
            found, counts = np.unique(np.broadcast_to(bits, len(x)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*names, *[""] * len(found)]), pa.array([*[0] * len(names), *found.tolist()], pa.int64()), pa.array([*seconds, *counts.tolist()], pa.float64())], ["name", "bits", "value"])

    got = some.mapInArrow(run, "name string, bits long, value double").groupBy("name", "bits").agg(F.sum("value").alias("value")).collect()
    return Profile({r["name"]: r["value"] for r in got if r["name"]}, {r["bits"]: int(r["value"]) for r in got if not r["name"]})


def ordered(seen: Profile, rules: Sequence[Rule] = RULES, given: Sequence[str] = ()) -> tuple[Rule, ...]:
    """The rules by rejection per cost: each time the one that rejects most of the sample's remaining rows for a second of statistics not counted yet.

    Statistics in `given` cost nothing, as all texts get them. Rules that reject
    nothing come last, the cheap ones first; ties keep the rules' own order.
    """
    left, counted, out = dict(seen.rows), set(given), []
    todo = list(enumerate(rules))
    while todo:
        alive = sum(left.values()) / max(1, sum(seen.rows.values()))

        def worth(item: tuple[int, Rule]) -> tuple[float, float]:
            k, rule = item
            cost = 1e-9 + alive * sum(seen.seconds.get(n, 0.0) for n in rule.needs if n not in counted)
            return sum(n for bits, n in left.items() if bits >> k & 1) / cost, -cost  # noqa: B023

        best = max(todo, key=worth)
        todo.remove(best)
        out.append(best[1])
        counted |= set(best[1].needs)
        left = {bits: n for bits, n in left.items() if not bits >> best[0] & 1}
    return tuple(out)


def cascade(docs: DataFrame, rules: Sequence[Rule] | None = None, doc_id: str = "doc_id", text: str = "text", report: Sequence[str] = ()) -> DataFrame:
    """(id, kept, rejected_by, n_looked, *report): one row for each row of `docs`.

    kept: no rule rejects the text. rejected_by is the first rule in the
    cascade's order that does, n_looked the number of rules that saw the text;
    with `rules` None the order comes from a sample's measured times, so these
    two may differ between runs, kept never does. Statistics named in `report`
    are counted for all texts. A null text is an empty one, which has no words.
    Repeated rows give rows of their own; other columns are ignored. No shuffle;
    a text is read whole.
    """
    rules = ordered(profile(docs, RULES, text), RULES, report) if rules is None else tuple(rules)
    report = tuple(report)
    names = np.array([*(r.name for r in rules), None], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            by, looked, values = _judge(_texts(batch), rules, report)
            columns = [batch.column("id"), pa.array(by < 0), pa.array(names[by].tolist(), pa.string()), pa.array(looked)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(values[n]) for n in report)], ["id", "kept", "rejected_by", "n_looked", *report])

    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, kept boolean, rejected_by string, n_looked long" + "".join(f", {n} long" for n in report))
