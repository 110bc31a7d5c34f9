"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of its input. Between stages rows are written and read again.

1. toxicity: documents whose score reaches 0.5 go. The model is fitted on the
   labelled documents of the stage's own input.
2. exact copies: of equal texts, A-Z lower-cased, the largest doc_id stays.
3. near copies: five-word shingles, similarity 0.8 or more; of each group the
   smallest doc_id stays.
4. secrets: every span found is replaced by "[secret]"; n_chars follows the text.
5. packing: token ids in windows of 4096, in the corpus' own mixture of sources.

Null and empty texts pass the first stage, are one text in the second, link
with nothing in the third, have no secrets, and are packed as their end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwatch.llm import toxicity
from plantwatch.llm.exact_dedup import drop_exact_copies
from plantwatch.llm.ngram_join import drop_near_copies
from plantwatch.llm.packing import pack
from plantwatch.llm.queries import vocabulary
from plantwatch.llm.secrets import redact_secrets
from plantwatch.llm.tables import read_table, removed, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, words=5, num=80, den=100)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary("word_bpe_49k.json"), end_id=2).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near), ("secret scans", redact), ("packing", pack_windows)]

#: A model and a tokenizer stand between the tables and the rows, so SQL can't give them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir))
        if before is not None:
            removed(spark, before)  # the next stage has all its rows
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
