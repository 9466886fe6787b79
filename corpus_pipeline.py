"""A corpus pipeline over ``documents``: toxicity, exact and near duplicates, mixing, tokens.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that applies one operator to all rows
that its predecessor kept; all but the last return the columns of ``documents``. Between the
stages ``run`` writes Parquet into the shared folder, so no stage is computed twice and a lost
executor costs no more than its tasks.

Every stage gives an empty table for an empty table and keeps further columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, exact_dedup, mixing, near_copies, shared, toxicity
from tessera.llm.catalogue import VOCABULARY, table

#: Byte-level BPE and iterated near-duplicate classes have no SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half stay; null and empty texts do, and repeated rows go or stay together."""
    shared.bound_batches(spark)
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_of(F.col("text"), lexicon) < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays (null last, null text as empty); of repeated rows one."""
    shared.bound_batches(spark)
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, similarity 0.8) the smallest id stays, null last, with all its rows."""
    shared.bound_batches(spark)
    return near_copies.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null is a source, empty texts stay once, repeated rows alike."""
    shared.bound_batches(spark)
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and a digest of what they decode to; null and empty texts have none."""
    shared.bound_batches(spark)
    tokens = byte_bpe.encode(docs, vocabulary=VOCABULARY)
    return tokens.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, over the whole of ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = shared.write(stage(spark, docs, sf_dir))
        docs = spark.read.parquet(path)
        if before:
            shared.delete(spark, before)
        before = path
    return docs
