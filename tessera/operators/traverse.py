"""Breadth-first traversal as a loop of joins over the depth.

The order of a queue inside a depth is (rank of the parent, position of the link), and the
first occurrence of a node counts, so the smallest such pair of each node reproduces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpoint
from .ordering import numbered


def bfs(edges: DataFrame, nodes: DataFrame, start: str = "INDEX", max_depth: int = 2) -> DataFrame:
    """(depth, node_path, ord) from edges (src, pos, dst) over existing nodes (node_path).

    A link to a missing node is skipped; every node is visited once. The frontier is the only
    thing joined with the edges; it is numbered in its partitions and cut from its lineage at each
    depth, so that no level is computed again for the next.
    """
    spark = edges.sparkSession
    begin = checkpoint(spark.createDataFrame([(0, start, 1)], "depth int, node_path string, ord long").join(nodes.select("node_path"), "node_path", "left_semi").select("depth", "node_path", "ord"))
    found, frontier = begin, begin
    for depth in range(1, max_depth + 1):
        near = (
            edges.join(frontier.select(F.col("node_path").alias("src"), F.col("ord").alias("parent")), "src")
            .groupBy(F.col("dst").alias("node_path"))
            .agg(F.min(F.struct("parent", "pos")).alias("first"))
            .join(found.select("node_path"), "node_path", "left_anti")
            .join(nodes.select("node_path"), "node_path", "left_semi")
        )
        placed = numbered(near, "first.parent", "first.pos", "node_path", name="ord")
        frontier = checkpoint(placed.select(F.lit(depth).alias("depth"), "node_path", "ord"))
        found = found.unionByName(frontier)
    return found
