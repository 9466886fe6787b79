"""The vector index of questions: rows and removals in Parquet, appended by version and merged when read.

A write adds one version: its rows below ``rows/seq=<n>``, the files it removes below ``removed/seq=<n>``, both in buckets
by file path. Nothing written before is touched. A reader takes the versions up to the one that the pointer names,
leaves out rows of a file that a later version removes, and of rows with one id the newest. ``compact``
rewrites the live rows of those buckets that have gathered many versions; the pointer says from which version on each bucket
is read. The pointer moves last and in one step, so a reader sees the old or the new index, never half of one; what a run that
was cut off has written lies in a version that the next write replaces.

Ids are digests of place and question: writing the same rows again changes nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.vectors import cosine_distance
from .lineage import checkpoint

SCHEMA = "id string, question string, file_path string, start_line int, end_line int, markdown_path string, embedding array<float>"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
COLLECTION = "code_chunks"


class Embedder(Protocol):
    name: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashing of words and of their letter trigrams, at length 1; no model needed."""

    def __init__(self, size: int = 256):
        self.size, self.name = size, f"hashing-{size}"

    def embed(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.size), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                for part, weight in [(word, 1.0), *((f"#{word[k : k + 3]}", 0.3) for k in range(len(word) - 2))]:
                    h = zlib.crc32(part.encode())
                    out[row, h % self.size] += weight if h >> 31 else -weight
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class IndexMismatch(RuntimeError):
    """The index was built with another embedding model."""


def embedded(questions: DataFrame, embedder: Embedder) -> DataFrame:
    """Rows of the index from questions (rel_path, start_line, end_line, question)."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(list(embedder.embed(part.tolist())) if len(part) else [], dtype=object)

    vector = F.pandas_udf(run, "array<float>")
    row_id = F.sha2(F.concat_ws("\x1f", "rel_path", F.col("start_line").cast("string"), F.col("end_line").cast("string"), "question"), 256)
    return questions.select(row_id.alias("id"), "question", F.col("rel_path").alias("file_path"), "start_line", "end_line", F.concat(P.without_suffix(F.col("rel_path")), F.lit(".md")).alias("markdown_path"), vector("question").alias("embedding")).dropDuplicates(["id"])


class VectorIndex:
    """Create, open, add to, remove from and search an index below a path that Spark can write."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder, buckets: int = 16, most_versions: int = 8):
        self.spark, self.path, self.embedder = spark, path.rstrip("/"), embedder
        self.buckets, self.most_versions = buckets, most_versions

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def meta(self) -> dict | None:
        p, fs = self._fs("index.json")
        if not fs.exists(p):
            return None
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/index.json").collect()))

    def _state(self) -> dict:
        """The newest version, and for each bucket the version from which on it is read."""
        meta = self.meta()
        known = (meta or {}).get("embedding_model")
        if known and known != self.embedder.name:
            raise IndexMismatch(f"index problem, not a scope problem: {self.path} was built with {known}, this engine uses {self.embedder.name}; rebuild the index")
        return meta or {"version": -1, "since": [0] * self.buckets}

    def _move(self, version: int, since: list[int]) -> None:
        text = json.dumps({"name": COLLECTION, "space": "cosine", "embedding_model": self.embedder.name, "version": version, "since": since})
        temporary, fs = self._fs("index.json.new")
        out = fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        pointer, _ = self._fs("index.json")
        hadoop = self.spark._jvm.org.apache.hadoop.fs  # its rename replaces the pointer in one step
        over = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(temporary.toUri(), self.spark._jsc.hadoopConfiguration()).rename(temporary, pointer, over)

    def _bucketed(self, rows: DataFrame, since: list[int]) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("file_path"), F.lit(len(since))).cast("int"))

    def _read(self, kind: str, columns: str, state: dict) -> DataFrame:
        """The stored rows of a kind with bucket and seq; versions that don't count aren't read."""
        schema = f"{columns}, seq int, bucket int"
        p, fs = self._fs(kind)
        if not fs.exists(p):
            return self.spark.createDataFrame([], schema)
        since = F.element_at(F.array(*map(F.lit, state["since"])), F.col("bucket") + 1)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}").filter((F.col("seq") <= state["version"]) & (F.col("seq") >= since))

    def _live(self, state: dict) -> DataFrame:
        """The rows that count, with bucket and seq."""
        gone = self._read("removed", "file_path string", state).groupBy("bucket", "file_path").agg(F.max("seq").alias("gone"))
        stored = self._read("rows", SCHEMA, state)
        left = stored.join(gone, ["bucket", "file_path"], "left").filter("gone IS NULL OR seq >= gone")
        columns = [c for c in left.columns if c not in ("id", "gone")]
        return left.groupBy("id").agg(F.max_by(F.struct(*columns), "seq").alias("row")).select("id", "row.*")

    def rows(self) -> DataFrame:
        """The index as it stands; empty if nothing was written yet."""
        return self._live(self._state()).select(*COLUMNS)

    def _write(self, rows: DataFrame | None, removed: DataFrame | None, whole: bool = False) -> None:
        """One version more of these rows and removed files (file_path); ``whole``: and nothing from before."""
        state = self._state()
        version, since = state["version"] + 1, state["since"]
        for kind, part in (("rows", rows), ("removed", removed)):
            if part is not None:
                self._bucketed(part, since).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/seq={version}")
            else:  # a run that was cut off may have left some
                p, fs = self._fs(f"{kind}/seq={version}")
                fs.delete(p, True)
        self._move(version, [version] * len(since) if whole else since)

    def replace(self, rows: DataFrame) -> int:
        """These rows and none of those before. Gives the number of rows."""
        self._write(rows.select(*COLUMNS), None, whole=True)
        self._vacuum()
        return self.rows().count()

    def upsert(self, rows: DataFrame) -> int:
        """New rows beside the old; an old row with the same id is replaced. Gives the number of new rows."""
        rows = checkpoint(rows)  # its questions may be generated, which may answer otherwise a second time
        self._write(rows.select(*COLUMNS), None)
        self.compact()
        return rows.count()

    def delete_files(self, paths: DataFrame, also: DataFrame | None = None) -> None:
        """Drops the rows of files (path), and adds ``also`` in the same version."""
        self._write(None if also is None else also.select(*COLUMNS), paths.select(F.col("path").alias("file_path")).distinct())
        self.compact()

    def compact(self, most_versions: int | None = None) -> list[int]:
        """Rewrites the buckets that hold more versions than that, and no other; gives their numbers."""
        state, most = self._state(), self.most_versions if most_versions is None else most_versions
        every = self._read("rows", SCHEMA, state).select("bucket", "seq").union(self._read("removed", "file_path string", state).select("bucket", "seq"))
        full = sorted(r.bucket for r in every.groupBy("bucket").agg(F.count_distinct("seq").alias("n")).filter(F.col("n") > most).collect())  # as many as there are buckets
        if full:
            version = state["version"] + 1
            rows = self._live(state).filter(F.col("bucket").isin(full))
            rows.drop("seq").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/seq={version}")
            p, fs = self._fs(f"removed/seq={version}")
            fs.delete(p, True)
            self._move(version, [version if b in full else s for b, s in enumerate(state["since"])])
            self._vacuum()
        return full

    def _vacuum(self, keep: int = 1) -> None:
        """Deletes versions that no bucket is read from any longer, but the last ``keep`` of them, which a reader may still hold."""
        oldest = min(self._state()["since"]) - keep
        for kind in ("rows", "removed"):
            folder, fs = self._fs(kind)
            for part in fs.listStatus(folder) if fs.exists(folder) else []:
                if int(part.getPath().getName().removeprefix("seq=")) < oldest:
                    fs.delete(part.getPath(), True)

    def search(self, query: str, k: int = 5) -> DataFrame:
        """The k nearest questions with their places; ties by file, line, question; fewer if the index is small."""
        asked = np.asarray(self.embedder.embed([query])[0], dtype=np.float64)
        asked = F.array(*[F.lit(float(x)) for x in asked])
        near = self.rows().filter(F.size("embedding") == F.size(asked)).withColumn("distance", cosine_distance(F.col("embedding"), asked))
        top = near.orderBy(F.round("distance", 9), "file_path", "start_line", "question", "id").limit(k)
        return top.select("question", "file_path", "start_line", "end_line", "markdown_path", "distance")
