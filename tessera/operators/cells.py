"""An approximate vector index: cells around centroids, and searches that read the nearest cells only.

Centroids are fitted by Spark's k-means on a bounded sample; every vector is then written to the partition of its nearest
centroid, with its distance from it. A search ranks the cells by their centroids and scores the vectors of
``probes`` cells a query; other partitions aren't read. How many that takes depends on the vectors, so the build measures
it: for a bounded sample of the vectors it finds the exact neighbours, and the ranks of the cells that hold them
tell how many cells reach the recall asked for. ``exact`` adds a second pass over just those cells that may still hold
something nearer: on unit vectors, nothing in a cell is nearer than the centroid's distance less the cell's radius.

Defined cases: a vector without an id, that is null, holds a null, or is of another length than the index finds nothing and isn't found;
zero vectors are at distance 1 from all; ties go by id; no vectors or no queries give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as vectors_of
from . import search
from .lineage import checkpoint

#: Cells at most, and vectors of the sample that the centroids are fitted on, about.
MOST_CELLS, SAMPLE = 4096, 40_000
#: Share of the true neighbours to be found, and vectors, about, that the number of cells for it is measured on.
RECALL, MEASURED = 0.95, 200
#: Bytes of query vectors that one pass takes along.
BLOCK = 16 << 20
_VECTORS = "vec_id long, embedding array<double>, off double, cell int"
_CELLS = "cell int, centroid array<double>, radius double, n long, probes int"


def _some(rows: DataFrame, share: float) -> DataFrame:
    """The rows whose hash lies below a threshold; reruns agree."""
    return rows.filter(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, share)))


def _flat(column: pa.Array, n: int) -> np.ndarray:
    return search._unit(np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), n))


def _assign(centroids: np.ndarray):
    """Each vector's nearest centroid, and how far off it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _flat(batch.column(1), centroids.shape[1])
            cells, off = np.zeros(len(rows), np.int32), np.zeros(len(rows))
            for at in range(0, len(rows), 1024):
                part = rows[at : at + 1024]
                apart = np.maximum(0.0, (part**2).sum(1)[:, None] + (centroids**2).sum(1)[None, :] - 2 * part @ centroids.T)
                cells[at : at + 1024] = apart.argmin(axis=1)
                off[at : at + 1024] = np.sqrt(apart.min(axis=1))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(off), pa.array(cells)], names=["vec_id", "embedding", "off", "cell"])

    return run


def _score(asked: dict[int, np.ndarray], ids: np.ndarray, queries: np.ndarray, k: int):
    """The best k of each batch and cell for the queries that ask for the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.asarray(batch.column(2))
            for cell in np.unique(cells).tolist():
                own = asked.get(cell, np.zeros(0, np.int64))
                part = batch.take(pa.array(np.flatnonzero(cells == cell)))
                vec, rows = np.asarray(part.column(0)), _flat(part.column(1), queries.shape[1])
                step = max(1, (1 << 22) // len(rows))
                for at in range(0, len(own), step):
                    distance = np.round(1.0 - queries[own[at : at + step]] @ rows.T, search.DIGITS)
                    best = [search._best(d, vec, k) for d in distance]
                    q, v = np.repeat(np.arange(len(best)), [len(b) for b in best]), np.concatenate(best)
                    yield pa.record_batch([pa.array(ids[own[at + q]]), pa.array(vec[v]), pa.array(distance[q, v])], names=["query_id", "vec_id", "distance"])

    return run


class CellIndex:
    """An index below ``path``: ``vectors``, partitioned by cell, and ``cells``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, *, vector_id: str = "vec_id", column: str = "embedding", cells: int | None = None, sample: int = SAMPLE, recall: float = RECALL, k: int = 10, seed: int = 7) -> int:
        """Writes the index anew; gives the number of cells. ``cells``: about the square root of the vectors, unless given.

        ``recall`` is the share of the ``k`` nearest that a search with the number of probes measured here should find.
        """
        own = search.whole(vectors.select(F.col(vector_id).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding")))
        length = own.groupBy(F.size("embedding").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length").first()
        if length is None or not length.length:
            centroids = np.zeros((0, 1))
        else:
            own = own.filter(F.size("embedding") == length.length)
            unit = _some(own, sample / length.n).filter(vectors_of.norm(F.col("embedding")) > 0).select(array_to_vector(vectors_of.unit(F.col("embedding"))).alias("features"))
            wanted = min(MOST_CELLS, cells or max(2, round(length.n**0.5)))
            fitted = KMeans(k=wanted, seed=seed, maxIter=10).fit(unit) if wanted > 1 and unit.limit(2).count() > 1 else None
            centroids = np.array(fitted.clusterCenters()) if fitted else np.zeros((1, length.length))
        rows = own.mapInArrow(_assign(centroids), _VECTORS) if len(centroids) else self.spark.createDataFrame([], _VECTORS)
        rows.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/vectors")
        stats = self.vectors().groupBy("cell").agg(F.max("off").alias("radius"), F.count(F.lit(1)).alias("n"))
        places = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        probes = self._probes(centroids, recall, k, length.n) if len(centroids) else 0
        places.join(stats, "cell").select("cell", "centroid", "radius", "n", F.lit(probes).alias("probes")).write.mode("overwrite").parquet(f"{self.path}/cells")
        return len(centroids)

    def _probes(self, centroids: np.ndarray, recall: float, k: int, n: int) -> int:
        """Cells to read for that recall, measured on the neighbours (other than itself) of a sample of the vectors."""
        asked = _some(self.vectors(), MEASURED / n).select(F.col("vec_id").alias("query_id"), "embedding", F.col("cell").alias("own"))
        near = search.top_k(asked, self.vectors(), k + 1).filter("query_id <> vec_id").join(self.vectors().select("vec_id", "cell"), "vec_id").select("query_id", "cell")
        at, vectors, ranks = {}, [], []
        for r in asked.collect():
            at[r.query_id] = len(vectors)
            vectors.append(r.embedding)
        if not vectors:
            return len(centroids)
        apart = -2 * search._unit(np.array(vectors)) @ centroids.T + (centroids**2).sum(1)[None, :]
        place = np.argsort(np.argsort(apart, axis=1, kind="stable"), axis=1, kind="stable")
        ranks = [int(place[at[r.query_id], r.cell]) for r in near.collect()]  # k for each of the sample
        return int(np.quantile(ranks, recall, method="higher")) + 1 if ranks else len(centroids)

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(_VECTORS).parquet(f"{self.path}/vectors")

    def cells(self) -> DataFrame:
        return self.spark.read.schema(_CELLS).parquet(f"{self.path}/cells")

    def search(self, queries: DataFrame, k: int = 5, *, probes: int | None = None, exact: bool = False, query_id: str = "query_id", column: str = "embedding") -> DataFrame:
        """(query_id, vec_id, distance, rank) from the ``probes`` nearest cells (as measured, unless given); with ``exact`` from as many as it takes."""
        cells = self.cells().orderBy("cell").collect()  # MOST_CELLS at most
        if not cells:
            return self.spark.createDataFrame([], "query_id long, vec_id long, distance double, rank int")
        centroids, radius, names = np.array([r.centroid for r in cells]), np.array([r.radius for r in cells]), np.array([r.cell for r in cells])
        wanted = search.whole(queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(column).cast("array<double>").alias("embedding"))).filter(F.size("embedding") == centroids.shape[1])
        rows, found = wanted.toLocalIterator(), None
        while block := list(islice(rows, max(1, BLOCK // (8 * centroids.shape[1])))):
            hits = self._block(np.array([r.query_id for r in block]), search._unit(np.array([r.embedding for r in block])), centroids, radius, names, k, probes or cells[0].probes, exact)
            found = hits if found is None else found.union(hits)
        return found if found is not None else self.spark.createDataFrame([], "query_id long, vec_id long, distance double, rank int")

    def _block(self, ids: np.ndarray, asked: np.ndarray, centroids: np.ndarray, radius: np.ndarray, names: np.ndarray, k: int, probes: int, exact: bool) -> DataFrame:
        apart = np.sqrt(np.maximum(0.0, (asked**2).sum(1)[:, None] + (centroids**2).sum(1)[None, :] - 2 * asked @ centroids.T))
        nearest = np.zeros(apart.shape, dtype=bool)
        np.put_along_axis(nearest, np.argsort(apart, axis=1, kind="stable")[:, :probes], True, axis=1)
        first = checkpoint(search._ranked(self._scored(ids, asked, names, nearest, k), k))
        if not exact:
            return first
        reached = dict.fromkeys(range(len(ids)), np.inf)
        last = {r.query_id: r.distance for r in first.filter(F.col("rank") == k).collect()}  # one for each query of the block
        limit = np.array([last.get(int(i), reached[q]) for q, i in enumerate(ids)])
        zero = ~asked.any(axis=1)
        # Squared distance of unit vectors is twice the cosine distance; a zero vector has no such bound.
        may = (apart - radius[None, :] <= np.sqrt(2 * np.maximum(limit, 0))[:, None] + 1e-6) | zero[:, None] | (limit >= 1 - 1e-9)[:, None]
        more = self._scored(ids, asked, names, may & ~nearest, k)
        return checkpoint(search._ranked(first.drop("rank").unionByName(more), k))

    def _scored(self, ids: np.ndarray, asked: np.ndarray, names: np.ndarray, which: np.ndarray, k: int) -> DataFrame:
        by_cell: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(0, np.int64))
        for place in np.flatnonzero(which.any(axis=0)).tolist():
            by_cell[int(names[place])] = np.flatnonzero(which[:, place])
        read = self.vectors().filter(F.col("cell").isin(sorted(by_cell)))
        return read.select("vec_id", "embedding", "cell").mapInArrow(_score(dict(by_cell), ids, asked, k), "query_id long, vec_id long, distance double")
