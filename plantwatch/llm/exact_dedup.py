"""Exact document dedup by content-defined chunk recipes.

A text (A-Z lower-cased) is cut where a rolling hash of its last bytes says so.
Each distinct chunk is moved once, to the chunk store, which compares the bytes
of all chunks under one digest and so verifies that the digest names one chunk.
Documents are then compared by their ordered lists of verified identifiers; the
texts themselves aren't moved again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.tables import cut_lineage, numbered, without_ids
from plantwatch.llm.utf8 import LOWER_AZ, mix64, slices, text_bytes

#: Bytes of a chunk: at least, on average beyond that, at most.
SMALLEST, MEAN, LARGEST = 256, 2048, 16384

_GEAR = mix64(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def chunk_ends(data: np.ndarray, offs: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document; the hash at a byte covers the 32 bytes up to it.

    A cut closer than SMALLEST to the start of its chunk isn't taken, so no
    window that decides reaches into the document before.
    """
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    cuts = np.flatnonzero(h % np.uint32(MEAN) == 0) + 1
    out = []
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        ends, at = [], int(a)
        own = cuts[np.searchsorted(cuts, a + SMALLEST) : np.searchsorted(cuts, b)]
        while at < b:
            nxt = own[np.searchsorted(own, at + SMALLEST) :][:1]
            end = min(int(nxt[0]) if len(nxt) else int(b), at + LARGEST, int(b))
            ends.append(end)
            at = end
        out.append(ends)
    return out


def _chunks(text: str, with_body: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: one row a chunk with its body, or one row a document with its recipe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            data, offs = text_bytes(batch.column(text))
            data = LOWER_AZ[data]
            keys, checks, bodies, counts, shas = [], [], [], [], []
            whole = memoryview(data)
            for a, ends in zip(offs[:-1], chunk_ends(data, offs), strict=True):
                start = at = int(a)
                for end in ends:
                    digest = hashlib.blake2b(whole[at:end], digest_size=24).digest()
                    keys.append(digest[:8])
                    checks.append(digest[8:])
                    if with_body:
                        bodies.append(bytes(whole[at:end]))
                    at = end
                counts.append(len(ends))
                if not with_body:
                    shas.append(hashlib.sha256(whole[start:at]).hexdigest())
            key = pa.array(np.frombuffer(b"".join(keys), np.int64))
            if with_body:
                yield pa.RecordBatch.from_arrays([key, pa.array(checks, pa.binary()), pa.array(bodies, pa.binary())], ["key", "check", "body"])
            else:
                bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shas, pa.string()), pa.ListArray.from_arrays(bounds, key), pa.ListArray.from_arrays(bounds, pa.array(checks, pa.binary()))], ["id", "text_sha256", "keys", "checks"])

    return run


def chunk_store(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, contested): one row for each 64-bit chunk key.

    The bytes of all chunks are compared where they meet, after equal chunks
    of a task have been merged. `contested` is true for a key under which
    different chunks were found; such a key is no identifier by itself. The
    job fails if one 192-bit digest holds two different chunks.
    """
    body = docs.select(F.col(text).alias("text")).mapInArrow(_chunks("text", True), "key long, check binary, body binary")
    met = body.groupBy("key", "check", "body").agg(F.count("*").alias("uses"))
    per_key = met.groupBy("key").agg(F.count("*").alias("n"), F.collect_set("check").alias("seen"))
    same = F.when(F.size("seen") < F.col("n"), F.raise_error(F.lit("two chunks with one digest"))).otherwise(F.col("n") > 1)
    return per_key.select("key", same.cast("boolean").alias("contested"))


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, text_sha256, recipe): one row a document; recipe lists its verified chunk identifiers in order."""
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    made = own.mapInArrow(_chunks("text", False), f"id {kind}, text_sha256 string, keys array<long>, checks array<binary>")
    made = cut_lineage(made.withColumn("row", F.monotonically_increasing_id()))
    contested = cut_lineage(chunk_store(docs, text).where("contested").select("key", F.lit(True).alias("contested")))
    if contested.isEmpty():  # every key names one chunk
        return made.select("row", "id", "text_sha256", F.concat_ws(",", F.transform("keys", F.hex)).alias("recipe"))
    part = made.select("row", F.posexplode(F.arrays_zip("keys", "checks")).alias("pos", "c")).select("row", "pos", F.col("c.keys").alias("key"), F.col("c.checks").alias("check"))
    named = part.join(contested, "key", "left").select("row", "pos", F.concat(F.hex("key"), F.when(F.col("contested"), F.hex("check")).otherwise("")).alias("name"))
    lists = named.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("l")).select("row", F.concat_ws(",", F.col("l.name")).alias("recipe"))
    return made.drop("keys", "checks").join(lists, "row", "left").withColumn("recipe", F.coalesce("recipe", F.lit("")))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, n_chunks): one row for each row of `docs`.

    Texts are equal when identical after lower-casing A-Z; a null text is an
    empty one, and all empty texts are equal. Of equal texts the row with the
    largest id stays; of rows that repeat an id too, one stays; a null id is
    the smallest. Other columns of `docs`, whatever their names, are ignored.
    An empty table gives no rows.
    """
    rows = cut_lineage(recipes(docs, doc_id, text))
    groups = cut_lineage(rows.groupBy("recipe").agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("group_size")))  # a table of its own, so that a hot group's join can be split
    joined = rows.join(groups, "recipe")
    n_chunks = F.when(F.col("recipe") == "", 0).otherwise(F.size(F.split("recipe", ",")))
    return joined.select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", n_chunks.alias("n_chunks"))


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns, whatever their names.

    Of rows that repeat both the id and the text of the one that stays, one stays.
    """
    verdict = cut_lineage(exact_dedup(docs, doc_id, text).select("id", "kept"))
    if not verdict.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        rows = numbered(docs)
        made = exact_dedup(rows.select(F.struct(F.col(f"row.`{doc_id}`").alias("id"), "k").alias("id"), F.col(f"row.`{text}`").alias("text")), "id")
        return rows.join(made.where("kept").select("id.k"), "k", "left_semi").select("row.*")
    return without_ids(docs, doc_id, verdict.where("not kept"))
