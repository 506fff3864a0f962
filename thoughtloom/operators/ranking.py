"""Ranks within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thoughtloom.session import materialise

#: ``monotonically_increasing_id`` keeps the partition above this many bits.
_ROW_BITS = 33


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place (from 1) in their group, without gathering a group.

    Rows are dealt by range of (group, order), sorted where they are and written once, so
    a group on a third of all rows is spread over a third of the partitions. What a window
    then sees is one count per partition and group. The order should tell all rows of a
    group apart, else the ranks of equal ones are any.
    """
    keys = [*[F.col(g) for g in group], *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialise(placed.withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_slice", F.shiftright("_place", _ROW_BITS))
    slices = placed.groupBy(*group, "_slice").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + 1 - F.col("_first")
    shifts = slices.select(*group, "_slice", shift.alias("_shift"))
    found = placed.join(shifts, [*group, "_slice"])
    return found.select(*rows.columns, (F.col("_place") + F.col("_shift")).alias(name))
