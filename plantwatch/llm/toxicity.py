"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model scores each sentence by its
words; noisy-or combines them, 1 - prod(1 - p), so the model is trained
from document labels alone and still tells which sentences offend.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.utf8 import LOWER_AZ, slices, span_hashes, text_bytes, words

#: Most labelled documents that a model is fitted on: those with the smallest hashes of their ids.
TRAIN_DOCS = 8000
#: Labelled documents that a word must be in to get a weight; rarer ones would only be learned by heart.
LEAST_DOCS = 4
#: Standard deviations by which a word must be more frequent in toxic documents than by chance.
LEAST_Z = 4.0
ROUNDS = 100

_NO_WORD = np.ones(256, bool)
_NO_WORD[48:58] = _NO_WORD[65:91] = _NO_WORD[97:123] = _NO_WORD[128:] = False
_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 63]] = True


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their sentence; document, first and last byte of each sentence with words."""
    data, offs = text_bytes(column)
    starts, ends, doc = words(data, offs, _NO_WORD)
    word = span_hashes(LOWER_AZ[data], starts, ends)
    section = np.searchsorted(np.flatnonzero(_ENDS[data]), starts)
    new = np.ones(len(starts), bool)
    new[1:] = (section[1:] != section[:-1]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts))[: len(first)] - 1
    return word, sentence, doc[first], starts[first], ends[last]


class Model(NamedTuple):
    """Sorted hashes of the words that have weights, their weights, and the bias of a sentence."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def sentences(self, word: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """Logit of each sentence."""
        if not len(self.words):
            return np.full(n, self.bias)
        at = np.searchsorted(self.words, word)
        at[at == len(self.words)] = 0
        known = self.words[at] == word
        return np.bincount(sentence[known], self.weights[at[known]], minlength=n) + self.bias


def fit(word: np.ndarray, sentence: np.ndarray, doc: np.ndarray, toxic: np.ndarray, least_docs: int = LEAST_DOCS, rounds: int = ROUNDS, rate: float = 0.15) -> Model:
    """Adam on the noisy-or likelihood of the document labels, over words that go with toxic documents, from their log-odds.

    With S the sum of softplus(z) over a document's sentences the noisy-or is
    1 - exp(-S); the loss is S for label 0 and -log(1 - exp(-S)) for label 1.
    """
    n, bias = max(1, len(toxic)), -6.0
    vocabulary, at = np.unique(word, return_inverse=True)
    pair = np.unique(at.astype(np.int64) * n + doc[sentence])
    seen = np.bincount(pair // n, minlength=len(vocabulary)).astype(float)
    with_label = np.bincount(pair // n, toxic[pair % n], minlength=len(vocabulary)) if len(pair) else seen
    share = toxic.mean() if len(toxic) else 0.0
    z = (with_label - seen * share) / np.sqrt(seen * share * (1 - share) + 1e-9)
    kept = (seen >= least_docs) & (z > LEAST_Z)
    own = kept[at]
    at, sentence = (np.cumsum(kept) - 1)[at[own]], sentence[own]
    vocabulary, seen, with_label = vocabulary[kept], seen[kept], with_label[kept]
    w = np.append(np.clip(np.log((with_label + 0.1) / (seen - with_label + 1)) - bias, 0, 9), bias)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(sentence, w[at], minlength=len(doc)) + w[-1]
        total = np.bincount(doc, np.logaddexp(0, z), minlength=len(toxic))
        slope = np.where(toxic == 1, -1 / np.expm1(np.clip(total, 1e-6, 500)), 1.0) / n
        dz = slope[doc] / (1 + np.exp(-np.clip(z, -500, 500)))
        g = np.append(np.bincount(at, dz[sentence], minlength=len(vocabulary)), dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return Model(vocabulary, w[:-1], float(w[-1]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        word, sentence, doc, _, _ = bags(batch.column("text"))
        of = doc[sentence]
        cut = np.searchsorted(of, np.arange(batch.num_rows + 1))
        firsts = np.searchsorted(doc, np.arange(batch.num_rows))
        rows = [(word[a:b].tobytes(), (sentence[a:b] - k).astype(np.int32).tobytes()) for a, b, k in zip(cut, cut[1:], firsts, strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array([x for x, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary())], ["id", "toxic", "word", "sentence"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row, the model of the given bags; the order in which they come doesn't matter."""
    rows = sorted((r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("toxic", "word", "sentence")), strict=True)))
    word, sentence, doc, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for k, (_, b, s) in enumerate(rows):
        own = np.frombuffer(s, np.int32)
        size = int(own[-1]) + 1 if len(own) else 0
        word.append(np.frombuffer(b, np.uint64))
        sentence.append(own.astype(np.int64) + n)
        doc.append(np.full(size, k))
        n += size
    toxic = np.array([t for t, _, _ in rows], np.int64)
    model = fit(np.concatenate(word), np.concatenate(sentence), np.concatenate(doc), toxic)
    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in model[:2]] + [pa.array([model.bias])], ["words", "weights", "bias"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = TRAIN_DOCS) -> Model:
    """A model from at most `most` labelled documents that aren't held out; one task fits it.

    Held out are ids whose crc32, as text, is divisible by 5. Rows with a null
    id or label aren't used; of labels that repeat an id the largest counts,
    and of documents that do one. Without labelled documents the model scores low.
    """
    chosen = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(most)
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")  # at most `most` rows of two numbers
    kind = own.schema["id"].dataType.simpleString()
    bagged = own.select("id", "toxic", "text").mapInArrow(_features, f"id {kind}, toxic int, word binary, sentence binary")
    one = bagged.groupBy("id").agg(F.max(F.struct("toxic", "word", "sentence")).alias("b")).select("b.*")
    row = one.repartition(1).mapInArrow(_fitted, "words binary, weights binary, bias double").first()  # at most `most` documents in that task
    if row is None:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -6.0)
    return Model(np.frombuffer(row["words"], np.uint64), np.frombuffer(row["weights"]), row["bias"])


def held_out(doc_id: str):
    """Whether the id's crc32, as text, is divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _score(model: Model, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            word, sentence, doc, start, end = bags(batch.column("text"))
            n = batch.num_rows
            z = model.sentences(word, sentence, len(doc))
            score = -np.expm1(-np.bincount(doc, np.logaddexp(0, z), minlength=n))
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            data, offs = text_bytes(batch.column("text"))
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            bad = np.flatnonzero(p >= threshold)
            spans = pa.StructArray.from_arrays([pa.array(x) for x in (chars[start[bad]] - chars[offs[doc[bad]]], chars[end[bad]] - chars[offs[doc[bad]]], p[bad])], ["start", "end", "score"])
            bounds = np.searchsorted(doc[bad], np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.clip(score, 0.0, 1.0)), pa.ListArray.from_arrays(pa.array(bounds), spans)], ["id", "score", "sentences"])

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, score, sentences): one row for each row of `docs`.

    score is the noisy-or of the sentence scores, 0 for a text without words,
    empty or null. sentences lists (start, end, score) of those that reach the
    threshold, from the first to the last word, in code points. Other columns
    are ignored; rows that repeat an id give rows of their own.
    """
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(_score(model, threshold), f"id {kind}, score double, sentences array<struct<start:long,end:long,score:double>>")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score is below the threshold, with all their columns."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            word, sentence, doc, _, _ = bags(batch.column(text))
            z = model.sentences(word, sentence, len(doc))
            low = -np.expm1(-np.bincount(doc, np.logaddexp(0, z), minlength=batch.num_rows)) < threshold
            yield batch.filter(pa.array(low))

    return docs.mapInArrow(keep, docs.schema)
