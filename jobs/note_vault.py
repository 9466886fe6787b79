"""A vault of notes kept in step with a table of documents: only what differs is written.

    python -m jobs.note_vault DOCUMENTS VAULT --config jobs/note_vault.toml

Each document is a file ``<lang>/<source>/d<doc_id>.md`` with a note; each folder above has one with its totals. A
run renders the notes of the snapshot, compares their digests with those in VAULT by a full outer join, and
rewrites the buckets (partitions by a hash of the path) that hold an added, modified or deleted note. The vault is
its own mark: it holds the digest of every note, so a run that is cut off between two buckets leaves some of them
new and some old, and the next run finds just the old ones. A deleted note stays as a row without content, so a
bucket that loses its last note is replaced like any other.

Defined cases: a null text has no summary; a null id, language or source is written ``none``; of repeated
paths the note with the largest content stays; an empty table deletes every note; other columns are ignored.
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tessera.functions import paths as P
from tessera.functions import text as T
from tessera.operators import changes, lookups, notes
from tessera.operators.lineage import checkpoint

from . import common
from .task_feed import tasks_of

LOG = logging.getLogger(__name__)
DEFAULTS = {"buckets": 64, "summary_chars": 120, "markers": list(T.MARKERS)}
VAULT = "path string, node_type string, content string, digest string, deleted boolean, bucket int"


def first_line(text: Column, n: int) -> Column:
    return F.substring(T.strip(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?U)\S[^\n]*", 0)), 1, n)


def rendered(documents: DataFrame, chosen: dict) -> DataFrame:
    """(path, node_type, content, digest) of the notes of all files and folders."""
    of = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("none"))
    path = F.concat(of("lang"), F.lit("/"), of("source"), F.lit("/d"), of("doc_id"), F.lit(".md"))
    files = documents.select(path.alias("path"), first_line(F.col("text"), chosen["summary_chars"]).alias("summary"), F.length("text").cast("long").alias("chars"), F.size(tasks_of(F.coalesce("text", F.lit("")), chosen["markers"])).cast("long").alias("tasks"))
    one = files.groupBy("path").agg(F.max(F.struct("summary", "chars", "tasks")).alias("kept")).select("path", "kept.*")

    no_links = documents.sparkSession.createDataFrame([], "src string, dst string, pos long")
    of_files = notes.file_notes(one.select("path", "summary"), no_links, None).select("path", F.lit("file").alias("node_type"), "content")
    total = lambda name: F.coalesce(F.sum(name), F.lit(0).cast("long"))
    sums = one.select(F.explode(P.ancestors(F.col("path"))).alias("path"), "chars", "tasks").groupBy("path").agg(F.count(F.lit(1)).alias("n"), total("chars").alias("chars"), total("tasks").alias("tasks"))
    content = F.concat(F.lit("---\ntype: directory\npath: "), "path", F.lit("\n---\n\n"), F.col("n").cast("string"), F.lit(" files, "), F.col("chars").cast("string"), F.lit(" characters, "), F.col("tasks").cast("string"), F.lit(" open tasks\n"))
    found = of_files.unionByName(sums.select("path", F.lit("directory").alias("node_type"), content.alias("content")))
    found = lookups.last_writer(found.withColumn("note", F.struct("node_type", "content")), "path", "note", "note").select("path", "note.*")  # a folder may be named like a file
    return found.withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))


def run(spark: SparkSession, documents: str, vault: str, *, config: str | None = None, **changed) -> dict:
    """Brings the vault up to the documents, writing only the buckets in which a note differs."""
    chosen = common.settings(DEFAULTS, config) | changed
    bucket = F.pmod(F.xxhash64("path"), F.lit(chosen["buckets"])).cast("int").alias("bucket")
    before = common.stored(spark, vault, VAULT)
    now = rendered(spark.read.parquet(documents).select("doc_id", "text", "lang", "source"), chosen)
    LOG.info("read %s and the digests of %s", documents, vault)
    differs = checkpoint(changes.change_set(before.filter("NOT deleted").select("path", "digest"), now.select("path", "digest")).withColumn("bucket", bucket))
    kinds = {r.status: r.n for r in differs.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = {"added": kinds.get("A", 0), "modified": kinds.get("M", 0), "deleted": kinds.get("D", 0), "buckets": 0}
    if kinds:
        touched = [r.bucket for r in differs.select("bucket").distinct().collect()]  # as many as there are buckets
        fresh = now.join(differs.filter("status <> 'D'").select("path", "bucket"), "path").withColumn("deleted", F.lit(False))
        of_touched = before.filter(F.col("bucket").isin(touched))
        gone = of_touched.join(differs.filter("status = 'D'").select("path"), "path", "left_semi").withColumns({"content": F.lit(None).cast("string"), "digest": F.lit(None).cast("string"), "deleted": F.lit(True)})
        kept = of_touched.join(differs.select("path"), "path", "left_anti")
        rows = checkpoint(fresh.unionByName(gone).unionByName(kept).select(*[c.split()[0] for c in VAULT.split(", ")]))  # the vault is read before it is written
        rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(vault)
        counts["buckets"] = len(touched)
    LOG.info("wrote %s: %s added, %s modified, %s deleted, in %s of %s buckets", vault, counts["added"], counts["modified"], counts["deleted"], counts["buckets"], chosen["buckets"])
    return counts


def live(spark: SparkSession, vault: str) -> DataFrame:
    """(path, node_type, content) of the notes as they stand."""
    return common.stored(spark, vault, VAULT).filter("NOT deleted").select("path", "node_type", "content")


if __name__ == "__main__":
    sys.exit(common.command(run, "documents", "vault"))
