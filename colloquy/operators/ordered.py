"""What looks at the row before, per key, without gathering a key in one task.

Rows are range-partitioned by key and order; what a partition has to know of the
rows before it comes from one row per key and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import durable


def with_previous(df: DataFrame, key: str, value: Column, *order: str, name: str = "previous") -> DataFrame:
    """Adds ``name``, the value of the row before in the same key, and ``is_first``; ``order`` must be unique within a key."""
    parted = durable(df.withColumn("_v", value).repartitionByRange(key, *order).withColumn("_pid", F.spark_partition_id()))
    local = Window.partitionBy("_pid", key).orderBy(*order)
    marked = parted.withColumn("_lag", F.lag("_v").over(local)).withColumn("_start", F.row_number().over(local) == 1)
    ends = parted.groupBy(F.col(key).alias("_k"), "_pid").agg(F.max_by(F.struct("_v"), F.struct(*order)).alias("_end"))
    before = F.lag("_end").over(Window.partitionBy("_k").orderBy("_pid"))
    seams = ends.select("_k", F.col("_pid").alias("_p"), before.alias("_before"))
    joined = marked.join(seams, (F.col("_pid") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    previous = F.when(F.col("_start"), F.col("_before._v")).otherwise(F.col("_lag"))
    return joined.withColumn(name, previous).withColumn("is_first", F.col("_start") & F.col("_before").isNull()).drop("_v", "_lag", "_start", "_k", "_p", "_before")


def gaps(df: DataFrame, key: str, ts: Column, order: str) -> DataFrame:
    """Adds ``gap``: the difference to the row before in the same key."""
    own = with_previous(df.withColumn("_ts", ts), key, F.col("_ts"), "_ts", order)
    return own.withColumn("gap", F.col("_ts") - F.col("previous")).drop("_ts", "_pid", "previous", "is_first")


def islands(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Adds ``run``, numbered from 1: neighbours of one key with equal values belong to one run; NULL values are never equal."""
    own = with_previous(df, key, F.col(value), *order).withColumn("_fresh", F.when(F.col("is_first"), 1).when(F.coalesce(F.col("previous") == F.col(value), F.lit(False)), 0).otherwise(1))
    kept = durable(own.drop("previous", "is_first"))
    sums = kept.groupBy(F.col(key).alias("_k"), "_pid").agg(F.sum("_fresh").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_k").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("_k", F.col("_pid").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_fresh").over(Window.partitionBy("_pid", key).orderBy(*order))
    joined = kept.withColumn("_inside", inside).join(offsets, (F.col("_pid") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    return joined.withColumn("run", F.col("_inside") + F.col("_before")).drop("_pid", "_fresh", "_inside", "_k", "_p", "_before")
