"""Triangle counting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.rounds import checkpointed, row_count
from vertexloom.functions.skew import join_spread
from vertexloom.operators.adjacency import Adjacency
from vertexloom.operators.graph import vertices_from_edges


def triangle_count(edges: DataFrame, group_cols: Sequence[str] = (), hot_rows: int | None = None) -> DataFrame:
    """``(id, triangle_count long)``: triangles through each vertex of the undirected simple graph, 0 included.

    Direction, parallel edges and self-loops do not matter; every end point is listed.

    Each edge points from its end of lower (degree, id) to the other. A vertex then has at most sqrt(2 * edges)
    successors however large its degree, so the successor lists stay short, and the corners that close a triangle over
    an edge are the common members of two such lists. Pairs of neighbours are never listed.
    """
    groups = list(group_cols)
    keys = [*groups, "id"]
    simple = checkpointed(
        edges.filter(F.col("src") != F.col("dst"))
        .select(*groups, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
    )
    degrees = checkpointed(
        simple.select(*groups, F.explode(F.array("src", "dst")).alias("id"))
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("degree"))
    )
    of_src = degrees.select(*groups, F.col("id").alias("src"), F.col("degree").alias("src_degree"))
    of_dst = degrees.select(*groups, F.col("id").alias("dst"), F.col("degree").alias("dst_degree"))
    size = row_count(simple)
    sized = join_spread(simple, of_src, [*groups, "src"], rows=size, hot_rows=hot_rows)
    sized = join_spread(sized, of_dst, [*groups, "dst"], rows=size, hot_rows=hot_rows)
    low_first = F.struct("src_degree", "src") < F.struct("dst_degree", "dst")
    oriented = checkpointed(
        sized.select(
            *groups,
            F.when(low_first, F.col("src")).otherwise(F.col("dst")).alias("src"),
            F.when(low_first, F.col("dst")).otherwise(F.col("src")).alias("dst"),
        )
    )

    successors = checkpointed(oriented.groupBy(*groups, "src").agg(F.collect_list("dst").alias("nexts")))
    entering = Adjacency(oriented, "dst", groups, hot_rows, size)
    with_high = entering.attach(successors.select(*groups, F.col("src").alias("id"), F.col("nexts").alias("high")))
    both = with_high.join(successors.withColumnRenamed("nexts", "low"), [*groups, "src"])
    closing = both.select(*groups, "src", "dst", F.array_intersect("low", "high").alias("third"))
    closing = closing.filter(F.size("third") > 0)

    corner = F.struct(F.col("third_id").alias("id"), F.lit(1).cast("long").alias("n"))
    per_edge = F.size("third").cast("long")
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), per_edge.alias("n")),
                             F.struct(F.col("dst").alias("id"), per_edge.alias("n"))))
    counted = checkpointed(closing)
    corners = counted.select(*groups, ends.alias("c")).unionByName(
        counted.select(*groups, F.explode("third").alias("third_id")).select(*groups, corner.alias("c"))
    )
    everyone = vertices_from_edges(edges, group_cols=groups).withColumn("n", F.lit(0).cast("long"))
    rows = corners.select(*groups, "c.id", "c.n").unionByName(everyone)
    result = checkpointed(rows.groupBy(*keys).agg(F.sum("n").alias("triangle_count")))
    entering.release()
    return result
