"""Open-task markers: one row for each line of a file that holds one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def lines_of(files: DataFrame, key: str = "file_path", text: str = "text") -> DataFrame:
    """(key, line_number from 1, line). A narrow generate, no shuffle."""
    return files.select(F.col(key), F.posexplode(T.lines(F.col(text))).alias("pos", "line")).select(key, (F.col("pos") + 1).cast("int").alias("line_number"), "line")


def scan(files: DataFrame, key: str = "file_path", text: str = "text", markers: Sequence[str] = T.MARKERS) -> DataFrame:
    """(key, line_number, text, tag): tag by the priority of ``markers``; files without any aren't exploded."""
    pattern = "|".join(markers)
    found = lines_of(files.filter(F.col(text).rlike(pattern)), key, text).withColumn("tag", T.marker(F.col("line"), markers))
    return found.filter(F.col("tag").isNotNull()).select(key, "line_number", T.strip(F.col("line")).alias("text"), "tag")
