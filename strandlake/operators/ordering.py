"""Running numbers over whole tables without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, name: str, cell: Column, order: list) -> DataFrame:
    """rows with a running number from 0, in the order given. cell: a whole number that never falls along that order.

    Two steps: a running count over cells (one row per cell goes through one window), then a rank within each cell.
    """
    dealt = rows.withColumn("__cell", cell)
    before = dealt.groupBy("__cell").agg(F.count("*").alias("n")).select("__cell", (F.sum("n").over(Window.orderBy("__cell")) - F.col("n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__cell").orderBy(*order)) - 1
    return dealt.join(before, "__cell").withColumn(name, (F.col("__before") + rank).cast("bigint")).drop("__cell", "__before")
