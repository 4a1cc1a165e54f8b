"""Global row order without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.workspace import Workspace


def ordinal(df: DataFrame, order: list[Column], ws: Workspace, name: str = "ord") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the given order.

    Range partitioning puts the order across partitions, a window numbers the rows inside
    each, and the partitions' counts (one row a partition) shift them. Ties of the whole
    order are numbered arbitrarily, so give an order that is total where that matters.
    """
    dealt = ws.save(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return dealt.join(F.broadcast(shift), "_p").withColumn(name, F.col("_shift") + within).drop("_p", "_shift")


#: Rows up to which a table of groups is broadcast.
FEW = 10_000


def if_few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df``, to be broadcast if a count finds it small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
