"""Cutting lineage in the folder that the cluster shares, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bounds the Arrow batches of the session by ``most`` bytes, unless it has a bound of its own already."""
    if spark.conf.get(_BATCH) in ("67108864b", "64MB", "64m"):  # the default
        spark.conf.set(_BATCH, most)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back; survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is named, as in tests."""
    return spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) can reach.

    Rounds of taking the smallest neighbouring label and then the label's label. Nothing is
    collected but a count for each round; labels are cut from their lineage in every round.
    """
    both = checkpoint(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = checkpoint(low.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root")))
        labels = new.select("node", "root")
        if new.filter("root <> old").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return labels


def bounded_sample(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """``rows`` if they are at most ``most``, else those whose hash of ``keys`` lies below a threshold that leaves at most so many.

    Counts only come to the driver, and no task gets more than its own rows. Reruns agree.
    """
    n = rows.count()
    if n <= most:
        return rows
    share = most / n * max(0.1, 1 - 4 / most**0.5)
    place = F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / float(1 << 53)
    while (part := rows.filter(place < share)).count() > most:
        share *= 0.9
    return part


def write(df: DataFrame) -> str:
    """The path of ``df`` as Parquet in a new folder of the shared store."""
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir() or checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store that nothing reads any longer."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
