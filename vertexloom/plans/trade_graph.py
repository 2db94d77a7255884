"""The property graph of customers and nations that the registered queries run on, derived from the order tables.

Ids: nation n becomes vertex 2n, customer c vertex 2c + 1. Relationships: ``HAS_CUSTOMER`` from a nation to each of its
customers, and from each order's customer to the customer of the next order in the same nation (by order date, then
order key) one relationship whose type is the priority of the first order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.ordering import with_next, with_position
from vertexloom.functions.rounds import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nation_id(column: str):
    return F.col(column).cast("long") * 2


def _customer_id(column: str):
    return F.col(column) * 2 + 1


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(
        _nation_id("n_nationkey").alias("id"), F.lit("Nation").alias("label"), F.col("n_name").alias("name")
    )
    customers = table(spark, sf_dir, "customer").select(
        _customer_id("c_custkey").alias("id"), F.lit("Customer").alias("label"), F.col("c_name").alias("name")
    )
    return nations.unionByName(customers)


def _placed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), _nation_id("c_nationkey").alias("partition_id")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    placed = orders.join(customers, "o_custkey").withColumn("src", _customer_id("o_custkey"))
    chained = with_next(placed, ["partition_id"], ["o_orderdate", "o_orderkey"], F.col("src"), "dst")
    return chained.filter(F.col("dst").isNotNull())


def order_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(partition_id, src, dst, rel_type)``: one row per order that has a next one in its nation."""
    steps = _placed_steps(spark, sf_dir)
    return checkpointed(steps.select("partition_id", "src", "dst", F.col("o_orderpriority").alias("rel_type")))


def order_walks(spark: SparkSession, sf_dir: str, steps: int) -> DataFrame:
    """``(partition_id, walk, src, dst)``: the chains of all nations one after another, cut into walks of ``steps`` orders.

    A walk is a small graph of customers; there are more of them in larger tables, but they don't grow.
    """
    placed = with_position(_placed_steps(spark, sf_dir), ["partition_id", "o_orderdate", "o_orderkey"], "place")
    return checkpointed(placed.select("partition_id", F.floor(F.col("place") / steps).alias("walk"), "src", "dst"))


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    has_customer = table(spark, sf_dir, "customer").select(
        _nation_id("c_nationkey").alias("src"), _customer_id("c_custkey").alias("dst"), F.lit("HAS_CUSTOMER").alias("rel_type")
    )
    return order_chain(spark, sf_dir).select("src", "dst", "rel_type").unionByName(has_customer)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user, item, rating)``: how many lines of a customer's orders came from a supplier."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    counts = lines.join(orders, "o_orderkey").groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        F.col("o_custkey").cast("int").alias("user"),
        F.col("l_suppkey").cast("int").alias("item"),
        F.col("n").cast("double").alias("rating"),
    )
