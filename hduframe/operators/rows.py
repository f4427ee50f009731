"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_index(df: DataFrame, order: list[str], path: str, name: str = "row_index") -> DataFrame:
    """Adds the place of each row, from 0, in the given order.

    Rows are dealt to ranges and sorted within them, and that is written to ``path``, so that a task that runs again finds the
    same ranges; only the ranges' sizes come to the driver.  Rows that are equal in ``order`` get places in any order."""
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the rows as one column, so that no name of theirs clashes
    placed.select(F.struct("*").alias("row"), F.spark_partition_id().alias("_range"), (F.monotonically_increasing_id() % (1 << 33)).alias("_place")).write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    sizes = sorted(tuple(r) for r in back.groupBy("_range").count().collect())
    starts, at = [], 0
    for k, n in sizes:
        starts.append((k, at))
        at += n
    offsets = spark.createDataFrame(starts, "_range int, _start long")  # a row for each range
    place = (F.col("_start") + F.col("_place")).alias(name)
    return back.join(F.broadcast(offsets), "_range").select(*(F.col("row")[c].alias(c) for c in df.columns if c.lower() != name.lower()), place)
