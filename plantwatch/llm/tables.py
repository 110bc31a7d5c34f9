"""Reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Most ids, of eight bytes each where they are whole numbers, that are sent to all tasks.
BROADCAST_IDS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession, kind: str) -> str:
    """The folder that spark.checkpoint.dir names; on one machine, where it is unset, a new temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix=f"spark-{kind}-")
    return base.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared checkpoint folder of the cluster."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def stored(df: DataFrame, group_bytes: int | None = None) -> tuple[DataFrame, str]:
    """The same rows, written as Parquet to a new folder in the shared folder and read again, and that folder.

    With `group_bytes`, row groups of about that size, which is what a task holds at once; a longer row is one group.
    """
    path = f"{_shared_folder(df.sparkSession, 'stored')}/stored-{uuid.uuid4().hex}"
    sizes = {} if group_bytes is None else {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1}
    df.write.options(**sizes).parquet(path)
    return df.sparkSession.read.parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Takes away a folder of stored()."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def without_ids(docs: DataFrame, doc_id: str, gone: DataFrame) -> DataFrame:
    """The rows of `docs` whose id isn't in `gone` (id), with all their columns.

    Up to BROADCAST_IDS ids go to all tasks, so that the rows stay where they
    are; beyond, both sides are shuffled by id.
    """
    gone = cut_lineage(gone.select("id").distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("own"))
    return rows.join(gone, F.col("own") == F.col("id"), "left_anti").select("row.*")


def numbered(docs: DataFrame) -> DataFrame:
    """(k, row): every row of `docs` as a struct, with a number of its own that stays."""
    return cut_lineage(docs.select(F.monotonically_increasing_id().alias("k"), F.struct("*").alias("row")))
