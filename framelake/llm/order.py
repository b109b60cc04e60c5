"""Places in a total order, found side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, partitions


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df (one column) with each row's place, from 0, in the column's order, nulls last.

    Range partitions are sorted side by side and written once with each row's place in its
    partition; they are then shifted by the sizes of the partitions before them, a row each.
    """
    column = F.col(df.columns[0])
    ranged = df.repartitionByRange(partitions(df.sparkSession), column.isNull(), column).sortWithinPartitions(column.isNull(), column)
    ranged = cut(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    placed = ranged.withColumns({"part": F.shiftright("at", 33), "local": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # as many rows as partitions
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(F.broadcast(sizes), "part").select(*df.columns, (F.col("before") + F.col("local")).alias(name))
