"""Running sums over rows in an order, in ranges side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.scratch import cut


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Rows with the sum of ``value`` over the rows of their key that come before them (0 for the first).

    Rows are dealt into ranges of key and order, each summed on its own; of every range and key one sum is ordered as a
    whole. So a key with most of the rows is spread over tasks. The order has no ties within a key.
    """
    ranged = rows.withColumn("__v", value).repartitionByRange(*keys, *order)
    placed = cut(ranged.withColumn("__p", F.spark_partition_id()))
    sums = placed.groupBy(*keys, "__p").agg(F.sum("__v").alias("s"))
    before = Window.partitionBy(*keys).orderBy("__p")
    starts = sums.select(*keys, "__p", (F.sum("s").over(before) - F.col("s")).alias("__s0"))
    inside = F.sum("__v").over(Window.partitionBy(*keys, "__p").orderBy(*order)) - F.col("__v")
    both = placed.withColumn("__s1", inside).join(starts, [*keys, "__p"])
    return both.withColumn(name, F.col("__s0") + F.col("__s1")).select(*rows.columns, name)
