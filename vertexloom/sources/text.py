"""Text forms of edge lists, ratings, property updates and recommendations.

Lines that are blank or start with ``#`` are comments everywhere but in ratings. A line that does not have the fields
of its form fails the read with the line in the message.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vertexloom.operators.graph import canonicalize

# Header of a property update file (fixed value of the format).
UPDATES_HEADER = "# Node Property Value List"
# Analysis key of recommendations (fixed value).
RECOMMENDATIONS = "collaborative_filtering"


def content_lines(lines: DataFrame) -> DataFrame:
    """Drop blank and comment lines from a frame with a ``value`` column."""
    text = F.trim("value")
    return lines.filter((F.length(text) > 0) & ~text.startswith("#"))


def with_fields(lines: DataFrame, separator: str, at_least: int, at_most: int | None = None) -> DataFrame:
    """Add ``_parts``, the fields of a line. A line that does not have the fields of its form fails the read, also where
    only rows are counted: the check is a filter, which no pruning of columns removes."""
    parts = F.split(F.trim("value"), separator)
    fits = F.size(parts) >= at_least
    if at_most is not None:
        fits = fits & (F.size(parts) <= at_most)
    problem = F.raise_error(F.concat(F.lit(f"expected {at_least} fields: "), F.col("value"))).cast("boolean")
    return lines.filter(F.when(fits, True).otherwise(problem)).withColumn("_parts", parts)


def parse_updates(lines: DataFrame) -> DataFrame:
    """``id value`` lines of a frame with a ``value`` column; other columns are kept."""
    kept = with_fields(content_lines(lines), r"\s+", 2, 2)
    others = [name for name in lines.columns if name != "value"]
    return kept.select(*others, F.col("_parts")[0].cast("long").alias("id"), F.col("_parts")[1].cast("double").alias("value"))


def read_edge_list(spark: SparkSession, path: str, canonical: bool = False) -> DataFrame:
    """``(src, dst)`` from lines whose first two whitespace-separated fields are ids; further fields are ignored.

    Parallel edges and self-loops are kept. ``canonical`` orients every edge from the lower to the higher id.
    """
    parts = with_fields(content_lines(spark.read.text(path)), r"\s+", 2)
    edges = parts.select(F.col("_parts")[0].cast("long").alias("src"), F.col("_parts")[1].cast("long").alias("dst"))
    return canonicalize(edges) if canonical else edges


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """``(user, item, rating)`` from CSV lines of exactly three fields, without header or comments."""
    parts = with_fields(spark.read.text(path), ",", 3, 3)
    return parts.select(
        F.col("_parts")[0].cast("int").alias("user"),
        F.col("_parts")[1].cast("int").alias("item"),
        F.col("_parts")[2].cast("double").alias("rating"),
    )


def read_property_updates(spark: SparkSession, path: str) -> DataFrame:
    """``(id, value double)`` from ``id value`` lines."""
    return parse_updates(spark.read.text(path))


def read_recommendations(spark: SparkSession, path: str) -> DataFrame:
    """``(user, item, rank)`` from ``user,item,rank`` lines."""
    parts = with_fields(content_lines(spark.read.text(path)), r"\s*,\s*", 3, 3)
    return parts.select(
        F.col("_parts")[0].cast("long").alias("user"),
        F.col("_parts")[1].cast("long").alias("item"),
        F.col("_parts")[2].cast("int").alias("rank"),
    )


def _lines(df: DataFrame, separator: str, fields: list[str] | None = None) -> DataFrame:
    """``value``, the joined fields (by default all columns), and the columns that are no fields."""
    fields = df.columns if fields is None else fields
    absent = [F.when(F.col(name).isNull(), F.raise_error(f"null {name}")).otherwise(F.col(name).cast("string"))
              for name in fields]
    return df.select(F.concat_ws(separator, *absent).alias("value"), *[name for name in df.columns if name not in fields])


def write_edge_list(edges: DataFrame, path: str) -> None:
    """``src dst`` lines, one per edge, in a folder of part files; replaces what is there."""
    _lines(edges.select("src", "dst"), " ").write.mode("overwrite").text(path)


def write_property_updates(result: DataFrame, path: str) -> int:
    """Write a two-column result as ``id value`` lines; replaces what is there and returns the number of lines.

    The header, a comment to readers, is a file of its own in the folder.
    """
    if len(result.columns) != 2:
        raise ValueError("a property update has an id and a value")
    written = Observation()
    lines = _lines(result, " ").observe(written, F.count(F.lit(1)).alias("rows"))
    lines.write.mode("overwrite").text(path)
    header = result.sparkSession.range(1).select(F.lit(UPDATES_HEADER).alias("value"))
    header.write.mode("append").text(path)
    return written.get["rows"]


def write_rows(df: DataFrame, path: str) -> None:
    """Comma-joined columns without header: the export form of query results and recommendations."""
    df.write.mode("overwrite").csv(path)


def write_results(result: DataFrame, folder: str, analysis: str) -> None:
    """Add the result of an analysis to ``folder``, on the path that the import stream routes by.

    ``(partition_id, id, value)`` goes to a folder per partition, ``(user, item, rank)`` of recommendations and
    ``(id, value)`` to one folder. Each call adds a folder of its own and replaces nothing.
    """
    job = f"{folder}/{uuid.uuid4().hex}"
    if "partition_id" in result.columns:
        rest = [name for name in result.columns if name != "partition_id"]
        lines = _lines(result.select(*rest, "partition_id"), " ", rest)
        rows = lines.withColumn("analysis", F.lit(analysis)).hint("rebalance", "partition_id")
        rows.write.partitionBy("partition_id", "analysis").text(f"{job}/partitioned")
    else:
        separator = "," if analysis == RECOMMENDATIONS else " "
        _lines(result, separator).write.text(f"{job}/unpartitioned/{analysis}")
