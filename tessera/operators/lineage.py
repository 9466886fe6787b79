"""Cutting the lineage of small loop state, in the folder that the cluster shares; bounds of Arrow batches."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only where none is named, as in tests."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="checkpoints-")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back; survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder(spark))
    return df.checkpoint(eager=True)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bounds the Arrow batches of the session by ``most`` bytes, unless it has a bound of its own already.

    Spark's default holds up to 64 MB of texts, of which a Python worker makes several copies.
    """
    if spark.conf.get(_BATCH) in ("67108864b", "64MB", "64m"):  # the default
        spark.conf.set(_BATCH, most)
