"""Running sums and numbers over a whole table without a single sorted task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postalloom.plans.lineage import cut


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value``, a whole number, over all rows before a row in the order of the columns ``order``, 0 for the first.

    Rows are range-partitioned; a row per partition comes to the driver for the partitions' totals. Equal rows may stand in either order.
    """
    ranged = cut(df.withColumn("_value", value.cast("long")).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = sorted(ranged.groupBy("_part").agg(F.sum("_value").alias("n")).collect())
    starts, at = [], 0
    for part, n in totals:
        starts.append((part, at))
        at += n
    before = df.sparkSession.createDataFrame(starts, T.StructType([T.StructField("_of", T.IntegerType()), T.StructField("_before", T.LongType())]))
    within = F.sum("_value").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("_within", F.coalesce(within, F.lit(0).cast("long"))).join(F.broadcast(before), F.col("_part") == F.col("_of"))
    return placed.select(*df.columns, (F.col("_before") + F.col("_within")).alias(name))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with numbers from 0 in the order of ``order``."""
    return running(df, order, F.lit(1), name)
