"""Running sums and positions over a total order, without putting all rows in one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions.storage import cut


def running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """`df` with the sum of `value` over all rows before each one in `order` (which must be total).

    Rows are dealt to ranges; sums run inside a range, and the totals of the
    ranges before (one row each) are added. The dealt rows are written to the
    shared folder, so that both passes read the same ranges even where executors
    are lost in between.
    """
    dealt = cut(df.withColumn("_v", value).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("_p").agg(F.sum("_v").alias("_t")).select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("_r", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return ranked.join(F.broadcast(base), "_p").withColumn(name, (F.col("_r") + F.col("_b")).cast("long")).drop("_v", "_p", "_r", "_b")


def position(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` numbered from 0 in `order`."""
    return running_sum(df, order, F.lit(1).cast("long"), name)
