"""Row numbers and running totals over a whole table without one task that holds it.

Rows are range-partitioned and sorted; a row's total is the one of the rows before
it in its partition plus the totals of the partitions before.  The order must be total
over what the caller tells apart: equal rows follow one another in either order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators.settled import settled


def running_totals(df: DataFrame, order: Sequence[str | Column], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows before, in ``order``."""
    order = list(order)
    # written once: both passes below must see the same partitions
    rows = settled(df.withColumn("__value", value).repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "__part", F.spark_partition_id()), "running")
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = rows.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    before = settled(parts.select("__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before")), "running-before")
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__own", F.coalesce(F.sum("__value").over(own), F.lit(0)))
    return rows.join(before, "__part").select(*df.columns, (F.col("__own") + F.col("__before")).alias(name))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "rn") -> DataFrame:
    """``df`` with a 0-based BIGINT ``name`` in ``order``."""
    return running_totals(df, order, F.lit(1).cast("long"), name)
