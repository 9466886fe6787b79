"""Change sets: what is new, modified or deleted between a snapshot and now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_paths(changed: DataFrame, known: DataFrame, key: str = "path") -> DataFrame:
    return changed.join(known.select(key), key, "left_anti")


def modified_paths(changed: DataFrame, known: DataFrame, key: str = "path") -> DataFrame:
    return changed.join(known.select(key), key, "left_semi")


def without_deleted(rows: DataFrame, deleted: DataFrame, key: str = "path") -> DataFrame:
    return rows.join(deleted.select(key), key, "left_anti")


def change_set(before: DataFrame, now: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """(key, status): A added, M modified, D deleted; a full outer join on the key, equal rows dropped."""
    a = before.select(F.col(key), F.col(digest).alias("old"), F.lit(True).alias("was"))
    b = now.select(F.col(key), F.col(digest).alias("new"), F.lit(True).alias("is_now"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("was").isNull(), "A").when(F.col("is_now").isNull(), "D").when(~F.col("old").eqNullSafe(F.col("new")), "M")
    return both.select(key, status.alias("status")).filter(F.col("status").isNotNull())
