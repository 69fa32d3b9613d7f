"""A global index without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.matching import _cut


def global_index(df: DataFrame, order: list[str], name: str = "k") -> DataFrame:
    """Rows with their place, from 1, in the order of the columns, which together must be unique.

    Rows are range-partitioned and sorted in their partitions; each takes its place there and its partition's
    offset. Range bounds are sampled, so the partitioned rows are checkpointed before their counts are taken.
    Only one row per partition goes through a single window.
    """
    parts = _cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    # One row per partition: bounded by the number of partitions.
    return parts.join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_i") + F.col("_before") + 1).cast("long")).drop("_p", "_i", "_before")


def running_total(df: DataFrame, order: list[str], add: str, name: str) -> DataFrame:
    """Rows with the total of a column up to and with them in the order of the columns, which together must be unique, and _lo, the
    total before them. As global_index(), but what is carried over is each partition's sum."""
    parts = _cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sums = parts.groupBy("_p").agg(F.sum(add).alias("_s"))
    before = F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    w = Window.partitionBy("_p").orderBy(*order)
    both = parts.join(F.broadcast(offsets), "_p")
    upto, ahead = (F.sum(add).over(w.rowsBetween(Window.unboundedPreceding, end)) for end in (0, -1))
    return both.withColumns({name: F.col("_before") + upto, "_lo": F.col("_before") + F.coalesce(ahead, F.lit(0))}).drop("_p", "_before")
