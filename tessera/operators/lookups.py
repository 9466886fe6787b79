"""Small joins and aggregates around files, summaries and directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P


def with_summary(rows: DataFrame, summaries: DataFrame, key: str = "path") -> DataFrame:
    """Left join; a missing summary is the empty string."""
    return rows.join(summaries.select(key, "summary"), key, "left").withColumn("summary", F.coalesce("summary", F.lit("")))


def directories(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, n_files): every ancestor directory of the files, and how many files lie below it."""
    return files.select(F.explode(P.ancestors(F.col(path))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n_files"))


def first_occurrences(rows: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Distinct rows that keep their first position."""
    return rows.groupBy(*keys).agg(F.min(pos).alias(pos))


def joined_summaries(rows: DataFrame, group: str, path: str, summary: str) -> DataFrame:
    """(group, text): the summaries of a directory's own children in path order, ready for a prompt."""
    entry = F.struct(F.col(path).alias("p"), F.col(summary).alias("s"))
    sections = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.concat(F.lit("### "), x["p"], F.lit("\n"), x["s"]))
    return rows.groupBy(group).agg(F.array_join(sections, "\n\n---\n\n").alias("text"))


def last_writer(rows: DataFrame, key: str, content: str, order: str) -> DataFrame:
    """One row for each key: what was written last."""
    return rows.groupBy(key).agg(F.max_by(content, order).alias(content))


def suffix_counts(files: DataFrame, path: str = "path", order: str = "ord") -> DataFrame:
    """(suffix, n_files), most first, then by first appearance."""
    return files.groupBy(P.suffix(F.col(path)).alias("suffix")).agg(F.count(F.lit(1)).alias("n_files"), F.min(order).alias("first")).orderBy(F.desc("n_files"), "first").select("suffix", "n_files")
