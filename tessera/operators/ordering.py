"""Positions in a total order, numbered where the rows lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import checkpoint

_PART = 33  # monotonically_increasing_id: the partition above, the row below


def numbered(rows: DataFrame, *order: Column | str, name: str = "pos", start: int = 1) -> DataFrame:
    """``rows`` with their place in the order, from ``start``.

    The rows are dealt out by ranges of the order and sorted in their partitions; a row's place is its place there plus
    the rows of the partitions before. Only the partitions' row counts come to the driver. Ties are numbered in any
    order, and lie in one partition: give columns that tell rows apart. No rows give no rows.
    """
    here = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PART).cast("int")
    offset, offsets = start, []
    for r in here.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # as many as there are partitions
        offsets.append((r.part, offset))
        offset += r.n
    before = rows.sparkSession.createDataFrame(offsets, "_part int, _before long")
    placed = here.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _PART) - 1))).drop("_part", "_before", "_at")
