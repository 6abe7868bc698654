"""Places in an order, worked out by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.sinks import scratch_table


def numbered(df: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """Add ``name``, the place of each row (from 1) in the given order; rows that
    are equal in it follow each other in any order.

    The rows are dealt into ranges of the order and written once, so that the
    ranges stand; each task numbers its own range, and the counts of the ranges
    before it (one small row per range) are added.  No task sees all rows."""
    ranges = scratch_table(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (ranges.withColumn("_own", own).join(starts, "_range")
            .withColumn(name, (F.col("_own") + F.col("_start")).cast("bigint")).drop("_own", "_start", "_range"))
