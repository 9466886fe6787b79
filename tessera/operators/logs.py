"""The newest entries for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent(rows: DataFrame, key: str, order: list[Column], n: int = 10) -> DataFrame:
    """At most n rows for each key, with ``rank``; Spark cuts each map task to n rows a key before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= n)
