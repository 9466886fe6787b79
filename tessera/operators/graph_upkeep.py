"""The graph of a repository kept up by change sets: only what a change can alter is worked out again.

A change of files can alter the imports of the files that changed, the targets of imports that name a path which has
appeared or vanished, and the child lists of directories that gained or lost a file or a directory. Everything else
is taken over from the stored tables by anti joins; texts are read of changed files only.

Defined cases: an empty change set gives the same tables; a path that is added though it is known, or deleted though
it isn't, changes no count; a file that isn't UTF-8 has no imports.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from . import imports, lookups
from .lineage import checkpoint


@dataclass(frozen=True)
class Graph:
    """The tables that are kept."""

    paths: DataFrame  # rel_path
    folders: DataFrame  # path, n_files
    wanted: DataFrame  # src, pos, raw, label, candidates
    edges: DataFrame  # src, dst, pos
    children: DataFrame  # src, dst, dst_type, pos

    def write(self, folder: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{f.name}")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Graph:
        return cls(*[spark.read.parquet(f"{folder.rstrip('/')}/{f.name}") for f in fields(cls)])

    def settled(self) -> Graph:
        """The same tables, computed and cut off their lineage."""
        return Graph(*[checkpoint(getattr(self, f.name)) for f in fields(self)])


def _listing(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """(path): files, directories, and directories with a slash, as ``imports.listing`` has them."""
    return paths.select(F.col("rel_path").alias("path")).union(folders.select("path")).union(folders.select(F.concat("path", F.lit("/"))))


def _children(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """Files before directories, each by their parts."""
    rows = paths.select(F.col("rel_path").alias("dst"), F.lit("file").alias("dst_type"), F.lit(0).alias("k")).union(folders.select("path", F.lit("directory").alias("dst_type"), F.lit(1).alias("k")))
    rows = rows.withColumn("src", P.parent(F.col("dst"))).filter("src <> '.'")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy("k", P.parts(F.col("dst")))).cast("long")).select("src", "dst", "dst_type", "pos")


def build(files: DataFrame, everything: DataFrame) -> Graph:
    """The graph of supported files (rel_path, suffix, importer, text) among all paths (rel_path)."""
    paths = everything.select("rel_path").distinct()
    folders = lookups.directories(paths, "rel_path")
    wanted = checkpoint(imports.wanted(files))  # texts are read once, for the names and the edges
    return Graph(paths, folders, wanted, imports.resolve(wanted, _listing(paths, folders)), _children(paths, folders))


def advance(graph: Graph, changed: DataFrame, files: DataFrame) -> Graph:
    """The graph after a change set (path, status A, M or D); ``files`` holds the texts of added and modified files.

    The change set is taken as small against the repository, but nothing here needs it to be.
    """
    changed = checkpoint(changed.select("path", "status").distinct())
    named = changed.withColumnRenamed("path", "rel_path")
    added = checkpoint(named.filter("status <> 'D'").select("rel_path").join(graph.paths, "rel_path", "left_anti"))
    deleted = checkpoint(named.filter("status = 'D'").select("rel_path").join(graph.paths, "rel_path", "left_semi"))
    paths = graph.paths.join(deleted, "rel_path", "left_anti").union(added)

    more, less = (lookups.directories(rows, "rel_path").select("path", (F.col("n_files") * sign).alias("d")) for rows, sign in ((added, 1), (deleted, -1)))
    delta = checkpoint(more.union(less).groupBy("path").agg(F.sum("d").alias("d")))
    counted = graph.folders.join(delta, "path", "full_outer").select("path", F.coalesce("n_files", F.lit(0)).alias("before"), (F.coalesce("n_files", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n_files"))
    turned = checkpoint(counted.join(delta.select("path"), "path", "left_semi").filter("(before = 0) <> (n_files = 0)").select("path", (F.col("before") == 0).alias("appeared")))
    folders = counted.filter("n_files > 0").select("path", "n_files")

    # Imports: of changed files anew, and those with a candidate that has come or gone.
    texts = files.join(changed.filter("status <> 'D'").select(F.col("path").alias("rel_path")), "rel_path", "left_semi")
    stored = graph.wanted.join(changed.select(F.col("path").alias("src")), "src", "left_anti")
    wanted = stored.unionByName(checkpoint(imports.wanted(texts)))
    turned_names = added.union(deleted).select(F.col("rel_path").alias("candidate")).union(turned.select("path")).union(turned.select(F.concat("path", F.lit("/"))))
    touched = stored.select("src", F.explode("candidates").alias("candidate")).join(turned_names.distinct(), "candidate", "left_semi").select("src")
    stale = checkpoint(touched.union(changed.select("path")).distinct())
    again = checkpoint(wanted.join(stale, "src", "left_semi"))
    asked = again.select(F.explode("candidates").alias("path")).distinct()
    edges = graph.edges.join(stale, "src", "left_anti").unionByName(imports.resolve(again, _listing(paths, folders).join(asked, "path", "left_semi")))

    # Child lists: of directories that gained or lost a file or a directory.
    moved = added.union(deleted).select(P.parent(F.col("rel_path")).alias("src")).union(turned.select(P.parent(F.col("path"))))
    dirty = checkpoint(moved.filter("src <> '.'").distinct())
    of_dirty = lambda rows, path: rows.withColumn("src", P.parent(F.col(path))).join(dirty, "src", "left_semi").drop("src")
    children = graph.children.join(dirty, "src", "left_anti").unionByName(_children(of_dirty(paths, "rel_path"), of_dirty(folders, "path").select("path")))
    return Graph(paths, folders, wanted, edges, children)
