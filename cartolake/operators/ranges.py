"""Rows in order over many tasks: range partitions, and numbers or sums carried over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolake.operators.scratch import kept


def in_ranges(df: DataFrame, *columns: str, part: str = "part") -> DataFrame:
    """df in ranges of the columns, each a task, with the number of its range; written, so that ranges stay as they are."""
    return kept(df.repartitionByRange(*columns).withColumn(part, F.spark_partition_id()))


def carried(ranges: DataFrame, part: str, **sums: Column) -> DataFrame:
    """ranges with, for each sum, what all earlier ranges have of it. One row a range comes together, never the rows."""
    totals = ranges.groupBy(part).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_{n}") for n, c in sums.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(n) for n in sums])
    return ranges.join(F.broadcast(offsets), part)


def numbered(df: DataFrame, *columns: str, name: str = "number") -> DataFrame:
    """df with a number from 0 in order of the columns, which tell all rows apart."""
    placed = carried(in_ranges(df, *columns, part="_part"), "_part", _before=F.lit(1))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*columns))
    return placed.withColumn(name, (F.col("_before") + inside - 1).cast("long")).drop("_part", "_before")
