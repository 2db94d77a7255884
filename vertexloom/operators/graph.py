"""Graphs as two DataFrames: construction, projections and reshaping.

``vertices`` has an ``id`` column and any attributes; ``edges`` has ``src``, ``dst`` and any attributes. ``group_cols``
names further key columns on both frames; every group is then a graph of its own and all groups run in one job.
Ids may be of any type that Spark can order and hash (longs, strings, structs).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.ordering import with_position
from vertexloom.functions.skew import join_spread, join_spread_both


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    group_cols: tuple[str, ...] = ()


def vertices_from_edges(
    edges: DataFrame, default: Mapping[str, Column] | None = None, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Distinct end points of ``edges``, one row per vertex; ``default`` adds attribute columns."""
    ends = edges.select(*group_cols, F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.withColumns(dict(default)) if default else ends


def graph(
    vertices: DataFrame | None,
    edges: DataFrame,
    default: Mapping[str, Column] | None = None,
    group_cols: Sequence[str] = (),
) -> Graph:
    """Build a graph. End points that have no vertex row get one, with ``default`` (else null) as attributes."""
    groups = tuple(group_cols)
    ends = vertices_from_edges(edges, group_cols=groups)
    if vertices is None:
        return Graph(ends.withColumns(dict(default)) if default else ends, edges, groups)
    keys = [*groups, "id"]
    known = vertices.withColumn("_known", F.lit(True))
    full = ends.join(known, keys, "full_outer")
    filled = {
        name: F.when(F.col("_known").isNull(), value).otherwise(F.col(name)) for name, value in (default or {}).items()
    }
    return Graph(full.withColumns(filled).drop("_known") if filled else full.drop("_known"), edges, groups)


def map_vertices(g: Graph, attributes: Mapping[str, Column]) -> Graph:
    """Replace or add vertex attributes; expressions may use the id and the other attributes."""
    return Graph(g.vertices.withColumns(dict(attributes)), g.edges, g.group_cols)


def map_edges(g: Graph, attributes: Mapping[str, Column]) -> Graph:
    """Replace or add edge attributes; expressions may use ``src``, ``dst`` and the other attributes."""
    return Graph(g.vertices, g.edges.withColumns(dict(attributes)), g.group_cols)


def triplets(g: Graph) -> DataFrame:
    """Every edge with the attributes of both ends, in the columns ``src_attr`` and ``dst_attr`` (structs).

    Parallel edges and self-loops are kept.
    """
    groups = list(g.group_cols)
    attributes = [name for name in g.vertices.columns if name not in (*groups, "id")]
    packed = F.struct(*attributes) if attributes else F.struct(F.col("id"))
    starts = g.vertices.select(*groups, F.col("id").alias("src"), packed.alias("src_attr"))
    ends = g.vertices.select(*groups, F.col("id").alias("dst"), packed.alias("dst_attr"))
    joined = join_spread(join_spread(g.edges, starts, [*groups, "src"]), ends, [*groups, "dst"])
    return joined.select(*g.edges.columns, "src_attr", "dst_attr")


def map_triplets(g: Graph, attributes: Mapping[str, Column]) -> Graph:
    """New edge attributes computed from the edge and both of its ends (``src_attr.x``, ``dst_attr.x``)."""
    edges = triplets(g).withColumns(dict(attributes)).drop("src_attr", "dst_attr")
    return Graph(g.vertices, edges, g.group_cols)


def merge_end_lists(g: Graph, vertex_list: str, name: str) -> Graph:
    """Edge attribute ``name``: the distinct members of the array ``vertex_list`` of both ends, source first."""
    return map_triplets(g, {name: F.array_union(f"src_attr.{vertex_list}", f"dst_attr.{vertex_list}")})


def remove_edges(g: Graph, removed: DataFrame) -> Graph:
    """Drop every copy of each (src, dst) pair in ``removed``; all vertices stay."""
    keys = [*g.group_cols, "src", "dst"]
    kept = g.edges.join(removed.select(*keys).distinct(), keys, "left_anti")
    return Graph(g.vertices, kept.select(*g.edges.columns), g.group_cols)


def canonicalize(edges: DataFrame) -> DataFrame:
    """Undirected orientation: the lower id becomes ``src``. Copies and self-loops are kept."""
    return edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def simplify(edges: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """One edge per (src, dst); a self-loop counts as an edge."""
    return edges.select(*group_cols, "src", "dst").distinct()


def neighbors(edges: DataFrame, direction: str = "out", group_cols: Sequence[str] = ()) -> DataFrame:
    """Sorted distinct neighbour ids per vertex, ``(id, neighbors)``. Vertices without neighbours are absent.

    ``direction`` is ``out``, ``in`` or ``both``. The array of a vertex is as long as its degree: that is the result
    asked for. Operators in this package follow edges instead of building these arrays.
    """
    forward = edges.select(*group_cols, F.col("src").alias("id"), F.col("dst").alias("other"))
    backward = edges.select(*group_cols, F.col("dst").alias("id"), F.col("src").alias("other"))
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    pairs = {"out": forward, "in": backward}.get(direction)
    pairs = (forward.unionByName(backward) if pairs is None else pairs).distinct()
    return pairs.groupBy(*group_cols, "id").agg(F.sort_array(F.collect_list("other")).alias("neighbors"))


def line_graph(edges: DataFrame, group_cols: Sequence[str] = (), hot_rows: int | None = None) -> DataFrame:
    """Directed line graph: each edge (u, v) becomes a vertex, joined to (v, w) for every successor w of v.

    Parallel edges collapse first. ``src`` and ``dst`` of the result are structs (src, dst), so no numbering of the
    edges is needed. Edges without a neighbour in the line graph do not occur. A vertex with many edges in and out is
    a hot key on both sides of the join and is spread on both.
    """
    groups = list(group_cols)
    simple = simplify(edges, groups)
    pair = F.struct("src", "dst")
    entering = simple.select(*groups, F.col("dst").alias("via"), pair.alias("first"))
    leaving = simple.select(*groups, F.col("src").alias("via"), pair.alias("second"))
    joined = join_spread_both(entering, leaving, [*groups, "via"], hot_rows)
    return joined.select(*groups, F.col("first").alias("src"), F.col("second").alias("dst"))


def index_vertices(vertices: DataFrame, name: str = "index") -> DataFrame:
    """``(id, index)`` with a dense index 0..n-1 in id order; join on ``index`` for the way back."""
    return with_position(vertices.select("id"), ["id"], name)


def random_vertex(vertices: DataFrame, seed: int) -> DataFrame:
    """One vertex, the one with the smallest md5 of ``seed:id``: the same seed and vertices always give the same pick."""
    return vertices.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(1)


def count_graph(g: Graph) -> DataFrame:
    """``(vertices, edges)`` counts, one row per group if the graph is grouped."""
    groups = list(g.group_cols)
    vertex_rows = g.vertices.select(*groups, F.lit(1).alias("v"), F.lit(0).alias("e"))
    edge_rows = g.edges.select(*groups, F.lit(0).alias("v"), F.lit(1).alias("e"))
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("v", "vertices"), ("e", "edges"))]
    return vertex_rows.unionByName(edge_rows).groupBy(*groups).agg(*totals)
