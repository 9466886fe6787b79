"""Incremental upkeep: from a change set to new summaries, notes and index rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from . import changes
from .generate import AnswerStore, TextGenerator, judged
from .languages import languages


@dataclass(frozen=True)
class Plan:
    """Paths (path) by what has to happen to them."""

    new: DataFrame
    modified: DataFrame
    deleted: DataFrame


def plan(changed: DataFrame, known: DataFrame, ignored: tuple[str, ...] = ()) -> Plan:
    """From (path, status) and the paths with a summary; only supported files outside ignored folders count."""
    spark = changed.sparkSession
    rows = changed.withColumn("suffix", P.suffix(F.col("path"))).join(F.broadcast(languages(spark).select("suffix")), "suffix", "left_semi")
    if ignored:
        rows = rows.filter(~F.arrays_overlap(P.parts(F.col("path")), F.array(*map(F.lit, ignored))))
    present = rows.filter("status <> 'D'").select("path")
    return Plan(changes.new_paths(present, known), changes.modified_paths(present, known), rows.filter("status = 'D'").select("path"))


def rewritten(old_notes: DataFrame, new_notes: DataFrame, generator: TextGenerator, date: str, sha: str, store: AnswerStore | None = None) -> DataFrame:
    """(path, content, conflict): for modified files the new note if it contradicts the old one, else the
    old note; either way with a line in its log. Earlier lines of the log are kept."""
    both = new_notes.select("path", F.col("content").alias("new")).join(old_notes.select("path", F.col("content").alias("old")), "path")
    found = judged(both, generator, store)
    log = F.regexp_extract("old", rf"(?s)(\n{T.SYNC_LOG_HEADING}\n.*)$", 1)
    note = F.when(F.col("conflict"), F.concat("new", log)).otherwise(F.col("old"))
    verdict = F.when(F.col("conflict"), F.concat(F.lit("rewritten ("), "reason", F.lit(")"))).otherwise("still accurate")
    return found.select("path", T.append_sync_log(note, F.lit(date), F.lit(sha), verdict).alias("content"), "conflict")


def added(new_notes: DataFrame, date: str, sha: str) -> DataFrame:
    return new_notes.select("path", T.append_sync_log(F.col("content"), F.lit(date), F.lit(sha), F.lit("new file added")).alias("content"))
