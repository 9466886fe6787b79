"""How many generator calls an ingest would take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P


def calls(files: DataFrame, group: str | None = None, directory: str = "parent", chunks: str = "n_chunks") -> DataFrame:
    """n_files, n_dirs (distinct, the root left out), n_chunks (one at least for each file), n_calls."""
    folder = F.when(F.col(directory) != ".", F.col(directory))
    sums = files.groupBy(*([group] if group else [])).agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct(folder).alias("n_dirs"), F.coalesce(F.sum(F.greatest(F.lit(1), F.col(chunks)).cast("long")), F.lit(0).cast("long")).alias("n_chunks"))
    return sums.withColumn("n_calls", F.col("n_files") + F.col("n_dirs") + F.col("n_chunks"))


def estimate(files: DataFrame, python_chunks: DataFrame) -> DataFrame:
    """The same for files (rel_path, suffix): Python files count their chunks, others one."""
    counted = python_chunks.groupBy("rel_path").agg(F.count(F.lit(1)).alias("own"))
    rows = files.join(counted, "rel_path", "left").select(P.parent(F.col("rel_path")).alias("parent"), F.when(F.col("suffix") == ".py", F.coalesce("own", F.lit(1))).otherwise(1).alias("n_chunks"))
    return calls(rows)
