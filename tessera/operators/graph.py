"""The note graph: files, their directories and the index, as nodes and ordered edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from . import lookups, ordering


def numbered(rows: DataFrame, group: str | None, order: str) -> DataFrame:
    """Positions from 1 within a group, or over all rows."""
    if group is None:
        return ordering.numbered(rows, order)
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("long"))


def nodes(files: DataFrame, file_summaries: DataFrame, dir_summaries: DataFrame) -> DataFrame:
    """(node_type, path, name, parent, summary, ord) of files (rel_path, parts).

    ``ord`` sorts like a walk: each file, then its directory if new, then missing ancestors from
    shallow to deep. Every directory gets its summary, ancestors too.
    """
    file_rows = files.select(F.lit("file").alias("node_type"), F.col("rel_path").alias("path"), F.struct("parts", F.lit(0).alias("kind"), F.lit(0).alias("depth")).alias("ord"))
    own = files.filter(F.size("parts") > 1)
    p = F.col("parts")
    direct = own.select(P.parent(F.col("rel_path")).alias("path"), F.struct("parts", F.lit(1).alias("kind"), F.lit(0).alias("depth")).alias("ord"))
    above = own.filter(F.size("parts") > 2).select("parts", F.explode(F.sequence(F.lit(1), F.size(p) - 2)).alias("depth")).select(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("path"), F.struct("parts", F.lit(2).alias("kind"), "depth").alias("ord"))
    dir_rows = direct.union(above).groupBy("path").agg(F.min("ord").alias("ord")).select(F.lit("directory").alias("node_type"), "path", "ord")
    both = lookups.with_summary(file_rows, file_summaries).unionByName(lookups.with_summary(dir_rows, dir_summaries))
    return both.select("node_type", "path", P.name(F.col("path")).alias("name"), P.parent(F.col("path")).alias("parent"), "summary", "ord")


def walk(all_nodes: DataFrame) -> DataFrame:
    """(path, walk): the place of every node in the order of a walk, from 1."""
    return ordering.numbered(all_nodes.select("path", "node_type", "ord"), "ord", "path", "node_type", name="walk").select("path", "walk")


def child_edges(all_nodes: DataFrame) -> DataFrame:
    """(src, pos, dst, dst_type): directories to their children, files before directories, each in node order."""
    rows = all_nodes.filter("parent <> '.'").select(F.col("parent").alias("src"), F.col("path").alias("dst"), F.col("node_type").alias("dst_type"), F.struct(F.when(F.col("node_type") == "file", 0).otherwise(1).alias("k"), "ord").alias("o"))
    return numbered(rows, "src", "o").select("src", "pos", "dst", "dst_type")


def top_level(all_nodes: DataFrame) -> DataFrame:
    """(path, node_type, pos) of the nodes at the root."""
    return numbered(all_nodes.filter("parent = '.'"), None, "ord").select("path", "node_type", "pos")
