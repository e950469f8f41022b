"""Running sums and row numbers that no single task has to make.

Rows are cut into slices by a number that grows with their order.  Sums run
within a slice; what all earlier slices of the group hold comes from one row for
each slice.  A group with a third of all rows is as many sorts as it has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, by: list[str], order: str, slice_by: Column, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the group up to each row;
    ``order`` parts the rows of a group, or rows that tie get sums of any order."""
    cut = rows.withColumn("_slice", slice_by).withColumn("_value", value)
    part = [*by, "_slice"]
    sums = cut.groupBy(*part).agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*part, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = F.sum("_value").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = cut.withColumn("_inside", inside).join(before, part)
    return found.withColumn(name, F.col("_inside") + F.col("_before")).drop("_slice", "_value", "_inside", "_before")


def numbered(rows: DataFrame, by: list[str], order: str, slice_by: Column, name: str) -> DataFrame:
    """Adds the number of each row in its group, from 1."""
    return running(rows, by, order, slice_by, F.lit(1).cast("long"), name)
