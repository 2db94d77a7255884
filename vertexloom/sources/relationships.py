"""Sub-graphs of a property graph: ``vertices(id, label, ...)`` and ``relationships(src, dst, rel_type, ...)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.skew import join_spread


def vertex_scan(vertices: DataFrame, label: str | None = None) -> DataFrame:
    """All vertices, or those with ``label``."""
    return vertices if label is None else vertices.filter(F.col("label") == label)


def edges_of_type(relationships: DataFrame, rel_type: str, distinct: bool = False) -> DataFrame:
    """``(src, dst)`` of all relationships of a type, one row each: parallel edges and self-loops are kept.

    ``distinct`` keeps one row per (start, neighbour) pair and no self-loops.
    """
    edges = relationships.filter(F.col("rel_type") == rel_type).select("src", "dst")
    return edges.filter(F.col("src") != F.col("dst")).distinct() if distinct else edges


def partition_edges(
    vertices: DataFrame, relationships: DataFrame, label: str, group_rel: str, target_rel: str
) -> DataFrame:
    """``(partition_id, src, dst)``: one sub-graph per vertex with ``label``.

    The members of a partition are its labelled vertex and that vertex's ``group_rel`` neighbours; the partition holds
    every ``target_rel`` relationship that starts at a member. The other end may lie outside the partition.
    """
    roots = vertex_scan(vertices, label).select(F.col("id").alias("partition_id")).distinct()
    grouping = edges_of_type(relationships, group_rel).select(F.col("src").alias("partition_id"), F.col("dst").alias("src"))
    # A partition vertex may have most of the grouping relationships, a member most of the target ones.
    grouped = join_spread(grouping, roots, ["partition_id"], "left_semi")
    members = grouped.unionByName(roots.withColumn("src", F.col("partition_id"))).distinct()
    targets = edges_of_type(relationships, target_rel)
    return join_spread(targets, members, ["src"]).select("partition_id", "src", "dst")


def ratings_from_query(spark: SparkSession, query: str | DataFrame) -> DataFrame:
    """``(user int, item int, rating double)`` from any query (SQL text or frame) that returns exactly three columns."""
    rows = spark.sql(query) if isinstance(query, str) else query
    if len(rows.columns) != 3:
        raise ValueError(f"the query must return 3 columns per row, not {len(rows.columns)}")
    # Under ANSI casts an id that does not fit an int fails the job instead of wrapping around.
    types = {"user": "int", "item": "int", "rating": "double"}
    return rows.toDF(*types).select(*[F.col(name).cast(kind).alias(name) for name, kind in types.items()])
