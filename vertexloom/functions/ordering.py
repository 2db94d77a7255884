"""Positions and successors in a sorted table, without putting a whole group or table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.functions.rounds import checkpointed

SLICE = "_slice"


def sorted_slices(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """Range-partition ``df`` on ``order_cols`` and number the slices in order, in column ``_slice``.

    Spark picks the range bounds from a sample of the sort key, so slices are balanced even when one leading value
    holds most rows. The frame is checkpointed: the slice number of a row must not change between two uses.
    """
    ranged = df.repartitionByRange(*[F.col(name) for name in order_cols])
    return checkpointed(ranged.withColumn(SLICE, F.spark_partition_id()))


def with_next(df: DataFrame, group_cols: list[str], order_cols: list[str], value: Column, name: str) -> DataFrame:
    """``lead(value)`` within ``group_cols`` by ``order_cols`` (a total order); the last row of a group gets null.

    Each window covers one range slice, so a group that holds a third of all rows is spread over many tasks. The last
    row of a slice takes its successor from the first row of the next non-empty slice: one small row per slice.
    """
    keys = [*group_cols, *order_cols]
    sliced = sorted_slices(df.withColumn("_value", value), keys)
    group = F.struct(F.lit(0).alias("_all"), *group_cols)
    here = F.struct(group.alias("of"), F.col("_value").alias("value"))

    heads = sliced.groupBy(SLICE).agg(F.min(F.struct(*keys, here.alias("head"))).alias("first"))
    heads = heads.select(SLICE, F.lead("first.head").over(Window.orderBy(SLICE)).alias("_after"))

    by_slice = Window.partitionBy(SLICE).orderBy(*keys)
    following = F.coalesce(F.lead(here).over(by_slice), F.col("_after"))
    return (
        sliced.join(F.broadcast(heads), SLICE)  # one row per range slice: at most spark.sql.shuffle.partitions rows
        .withColumn("_following", following)
        .withColumn(name, F.when(F.col("_following.of") == group, F.col("_following.value")))
        .drop(SLICE, "_value", "_after", "_following")
    )


def with_position(df: DataFrame, order_cols: list[str], name: str) -> DataFrame:
    """Dense position 0..n-1 of each row in the order of ``order_cols`` (a total order)."""
    sliced = sorted_slices(df, order_cols)
    sizes = sliced.groupBy(SLICE).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))

    by_slice = Window.partitionBy(SLICE).orderBy(*order_cols)
    return (
        sliced.join(F.broadcast(starts), SLICE)  # one row per range slice, as above
        .withColumn(name, F.col("_start") + F.row_number().over(by_slice) - 1)
        .drop(SLICE, "_start")
    )
