"""Exact nearest vectors by cosine distance.

Each Arrow batch of vectors is scored against the queries by one matrix product and cut to its
best k before anything is shuffled, so what is shuffled is at most k rows for each query and
batch. Queries are taken from the driver in blocks of ``MOST_QUERIES``; where there is more than
one block, each one's hits are cut off in the checkpoint folder before the next is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpoint

MOST_QUERIES = 10_000
#: Distances are rounded before they are ranked, as the last bits of a product depend on the batch's shape.
DIGITS = 9
#: A distance up to this counts as confident.
MAX_DISTANCE = 1.35


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, *, query_id: str = "query_id", vector_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, vec_id, distance, rank): ties in distance go by id; fewer than k vectors give fewer rows.

    A null id or vector, a null in a vector, or another length than the query's finds nothing and is not found;
    no queries give no rows.
    """
    wanted = whole(queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(column).cast("array<double>").alias("embedding")))
    own = whole(vectors.select(F.col(vector_id).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding")))
    found = wanted.limit(MOST_QUERIES + 1).toArrow()
    if found.num_rows <= MOST_QUERIES:
        return _ranked(_near(found, own, k), k)
    hits, rows = None, wanted.toLocalIterator()
    while block := list(islice(rows, MOST_QUERIES)):
        some = pa.table({"query_id": pa.array([r.query_id for r in block], pa.int64()), "embedding": pa.array([r.embedding for r in block], pa.list_(pa.float64()))})
        near = checkpoint(_ranked(_near(some, own, k), k))
        hits = near if hits is None else hits.union(near)
    return hits


def whole(rows: DataFrame) -> DataFrame:
    """Rows (id, embedding) with an id and a vector that holds no null."""
    return rows.filter(F.col(rows.columns[0]).isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _near(found: pa.Table, own: DataFrame, k: int, cells: int = 1 << 22) -> DataFrame:
    """The best k of each batch of vectors for each query of ``found``; at most ``cells`` distances are held at once."""
    by_length: dict[int, tuple[list[int], list[list[float]]]] = {}
    for query, vector in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        ids, rows = by_length.setdefault(len(vector), ([], []))
        ids.append(query)
        rows.append(vector)
    wanted = {n: (np.array(ids), _unit(np.array(rows, dtype=np.float64).reshape(len(ids), n))) for n, (ids, rows) in by_length.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pc.list_value_length(batch.column(1)))
            for n, (ids, queries) in wanted.items():
                rows = np.flatnonzero(lengths == n)
                if not len(rows):
                    continue
                part = batch.take(pa.array(rows))
                vec = np.asarray(part.column(0))
                vectors = _unit(np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(len(rows), n))
                step = max(1, cells // len(rows))
                for at in range(0, len(ids), step):
                    distance = np.round(1.0 - queries[at : at + step] @ vectors.T, DIGITS)
                    best = [_best(d, vec, k) for d in distance]
                    q, v = np.repeat(np.arange(len(best)), [len(b) for b in best]), np.concatenate(best)
                    yield pa.record_batch([pa.array(ids[at + q]), pa.array(vec[v]), pa.array(distance[q, v])], names=["query_id", "vec_id", "distance"])

    return own.mapInArrow(run, "query_id long, vec_id long, distance double")


def _ranked(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _best(distance: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    near = np.arange(len(distance))
    if len(distance) > k:
        near = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
    return near[np.lexsort((vec[near], distance[near]))[:k]]


def with_confidence(hits: DataFrame, most: float = MAX_DISTANCE) -> DataFrame:
    """Adds ``confidence`` (high or low) and ``all_low``: whether no hit of the query is confident."""
    every = Window.partitionBy("query_id")
    return hits.withColumn("confidence", F.when(F.col("distance") <= most, "high").otherwise("low")).withColumn("all_low", F.every(F.col("distance") > most).over(every))


_TERM = r"[\p{L}\p{N}]+"
#: Query terms are broadcast up to so many rows; beyond it they are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: What one scoring task is to hold: pairs of a query and a text, and bytes of texts; and the most tasks that are asked for.
TASK_PAIRS, TASK_BYTES, MOST_TASKS = 500_000, 8_000_000, 20_000


def terms(text: str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(_TERM), 0)


def term_frequencies(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf)."""
    return texts.select(F.col(key), F.explode(terms(text)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def squares(found: Column) -> Column:
    """The sum of the squared frequencies in an array of terms: each further occurrence of a term adds 2 n + 1."""
    start = F.struct(F.lit("").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"))

    def step(state: Column, term: Column) -> Column:
        n = F.when(state["term"] == term, state["n"]).otherwise(F.lit(0).cast("long"))
        return F.struct(term.alias("term"), (n + 1).alias("n"), (state["total"] + 2 * n + 1).alias("total"))

    return F.aggregate(F.sort_array(found), start, step, lambda state: state["total"])


def scoring_tasks(texts: DataFrame, text: str, n_queries: int) -> int:
    """Into how many tasks the texts are dealt out, so that what one holds doesn't grow with the input.

    Left to itself, Spark merges partitions by their size as written, but each text makes a row for each query.
    """
    n, size = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    wanted = max(ceil(n * n_queries / TASK_PAIRS), ceil((size or 0) / TASK_BYTES), texts.sparkSession.sparkContext.defaultParallelism)
    return min(wanted, MOST_TASKS)


def sparse_top_k(queries: DataFrame, texts: DataFrame, k: int = 5, *, query_key: str = "item_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Top k texts by term-frequency cosine.

    A text's norm comes from its own row, in a projection of its own: beside the generator it would be
    computed again for each word. Only the occurrences of query terms are dealt out, by text, so terms are
    counted, scored and cut to the best of each task without another exchange. There are as many tasks as
    the pairs need (``scoring_tasks``).
    """
    q = checkpoint(term_frequencies(queries, query_key, text))
    q_norm = q.groupBy(query_key).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("q_norm"))
    q = q.withColumnRenamed("tf", "q_tf").join(q_norm, query_key)
    few = q.count() <= BROADCAST_TERMS
    parts = scoring_tasks(texts, text, q_norm.count())
    asked = q.select("term").distinct()
    normed = texts.select(F.col(key), terms(text).alias("terms")).select(key, "terms", F.sqrt(squares(F.col("terms"))).alias("d_norm"))
    each = normed.select(key, "d_norm", F.explode("terms").alias("term"))
    matched = each.join(F.broadcast(asked) if few else asked, "term", "left_semi").repartition(parts, key)
    d = matched.groupBy(key, "d_norm", "term").agg(F.count(F.lit(1)).alias("tf"))
    pairs = d.join(F.broadcast(q), "term") if few else d.join(q, "term").repartition(parts, key)
    scored = pairs.groupBy(query_key, key).agg(F.sum(F.col("tf") * F.col("q_tf")).alias("dot"), F.first("d_norm").alias("d_norm"), F.first("q_norm").alias("q_norm"))
    scored = scored.withColumn("distance", F.round(1 - F.col("dot") / (F.col("q_norm") * F.col("d_norm")), 6))
    order = Window.partitionBy(query_key).orderBy("distance", key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(query_key, key, "distance", "rank")
