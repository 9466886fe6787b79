"""A feed of open tasks: scans files as they arrive and keeps, for each, the markers of its newest text.

    python -m jobs.task_feed DOCUMENTS OUT PROGRESS --config jobs/task_feed.toml

DOCUMENTS is a folder of Parquet files (doc_id, text, lang, source) to which files are added, or a pattern of such
files (Spark streams no path that is a file itself, but a pattern that only this file fits). Each run takes the files
that no run has taken before (PROGRESS is the stream's checkpoint) and appends to OUT one row for each
document in them, also if it has no marker: a document that comes again with another text replaces what was
known of it, and one whose last marker is gone leaves the list. OUT is partitioned by language. A run that is
cut off is taken up by the next one; the sink's log leaves out what an unfinished batch has written, so a
document is never counted twice for that reason, and one delivered twice counts once in ``open_tasks``.

Defined cases: a null text has no lines; rows without an id count by their text; of two texts of one document in
one file the one with the larger digest stands; an empty table gives an empty feed; other columns are ignored.
"""

from __future__ import annotations

import logging
import re
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

from . import common

LOG = logging.getLogger(__name__)
DEFAULTS = {"markers": list(T.MARKERS), "files_per_batch": 1000}
FEED = "doc_id long, lang string, source string, digest string, n_lines int, tasks array<struct<line_number:int,tag:string,text:string>>, arrived timestamp, language string"


def tasks_of(text, markers: Sequence[str]):
    """The marked lines of a text, in order, without leaving its row."""
    each = F.transform(T.lines(text), lambda line, k: F.struct((k + 1).cast("int").alias("line_number"), T.marker(line, markers).alias("tag"), T.strip(line).alias("text")))
    return F.when(text.rlike("|".join(map(re.escape, markers))), F.filter(each, lambda t: t["tag"].isNotNull())).otherwise(F.array().cast("array<struct<line_number:int,tag:string,text:string>>"))


def arrivals(documents: DataFrame, markers: Sequence[str]) -> DataFrame:
    """One row of the feed for each row of ``documents``; narrow."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.sha2(text.cast("binary"), 256).alias("digest"), T.line_count(text).alias("n_lines"),
        tasks_of(text, markers).alias("tasks"), F.col("_metadata.file_modification_time").alias("arrived"), F.when(F.coalesce("lang", F.lit("")) == "", "none").otherwise(F.col("lang")).alias("language"),
    )


def open_tasks(feed: DataFrame) -> DataFrame:
    """(doc_id, lang, source, line_number, tag, text): the markers of each document's newest arrival."""
    newest = F.max_by(F.struct("lang", "source", "tasks"), F.struct("arrived", "digest")).alias("newest")
    rows = feed.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("digest")).alias("nameless")).agg(newest)
    return rows.select("doc_id", "newest.lang", "newest.source", F.explode("newest.tasks").alias("t")).select("doc_id", "lang", "source", "t.*")


def run(spark: SparkSession, documents: str, out: str, progress: str, *, config: str | None = None, **changed) -> dict:
    """Scans what has arrived since the last run, and appends it to the feed of open tasks."""
    chosen = common.settings(DEFAULTS, config) | changed
    schema = spark.read.parquet(documents).schema
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", chosen["files_per_batch"]).parquet(documents)
    writer = arrivals(arriving, chosen["markers"]).writeStream.format("parquet").outputMode("append").partitionBy("language")
    query = writer.option("checkpointLocation", progress).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    counts = {"batches": len(batches), "rows_read": sum(p["numInputRows"] for p in batches)}
    LOG.info("read %s new rows of %s in %s batches", counts["rows_read"], documents, counts["batches"])
    rows = feed(spark, out).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("tasks")), F.lit(0)).alias("tasks")).first()
    counts = counts | {"rows_in_feed": rows.n, "tasks_in_feed": rows.tasks}
    LOG.info("%s holds %s arrivals with %s marked lines", out, rows.n, rows.tasks)
    return counts


def feed(spark: SparkSession, out: str) -> DataFrame:
    return common.stored(spark, out, FEED)


if __name__ == "__main__":
    sys.exit(common.command(run, "documents", "out", "progress"))
