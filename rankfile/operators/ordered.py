"""Ranks and running sums over a whole table, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def ranked(df: DataFrame, order: list, name: str = "rank", running: str | None = None) -> DataFrame:
    """df with each row's place (1, 2, ...) in an order of all rows, or the running sum of a column in that order.

    Rows are cut into ranges of the order, each range is counted by itself, and the ranges' offsets (a row a range) are
    added. Ties are broken arbitrarily: give an order that has none.
    """
    cut = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    value = F.col(running) if running else F.lit(1)
    sums = cut.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))  # a row a range
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.sum(value).over(within)).drop("_range", "_before")
