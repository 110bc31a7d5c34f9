"""Cutting the lineage of a plan."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared checkpoint folder; a temporary one on one machine where spark.checkpoint.dir is unset."""
    session = df.sparkSession
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        base = session.conf.get("spark.checkpoint.dir", None)
        if base is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint().select(*(F.col(f"`{c}`").alias(c) for c in df.columns))  # as columns of its own, apart from those of `df`
