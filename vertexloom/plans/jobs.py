"""User-level jobs: derive a sub-graph, run one named analysis, write the result back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.operators.betweenness import betweenness_centrality, edge_removal_communities
from vertexloom.operators.components import connected_components, strongly_connected_components
from vertexloom.operators.pagerank import pagerank
from vertexloom.operators.recommend import TOP_ITEMS, recommend, recommend_with_error
from vertexloom.operators.traversal import closeness_centrality
from vertexloom.operators.triangles import triangle_count
from vertexloom.operators.upserts import set_property, upsert_partition_relationships, upsert_recommendations
from vertexloom.sources.relationships import edges_of_type, partition_edges, ratings_from_query
from vertexloom.sources.text import RECOMMENDATIONS


def _communities(edges: DataFrame, group_cols: Sequence[str] = (), **options) -> DataFrame:
    """Communities by removed edges: two per graph where the options name no other stop. Without one all edges would go."""
    if not options.keys() & {"max_removals", "target_components"}:
        options["target_components"] = 2
    return edge_removal_communities(edges, group_cols=group_cols, **options)[0]


# Analysis keys are fixed values: they name the property that receives the result.
ANALYSES: dict[str, Callable[..., DataFrame]] = {
    "pagerank": pagerank,
    "connected_components": connected_components,
    "strongly_connected_components": strongly_connected_components,
    "triangle_count": triangle_count,
    "closeness_centrality": closeness_centrality,
    "betweenness_centrality": betweenness_centrality,
    "edge_betweenness": _communities,
}


def run_analysis(name: str, data: DataFrame, group_cols: Sequence[str] = (), **options) -> DataFrame:
    """Run the analysis ``name``: ``(id, <name>)`` for edges, ``(user, item, rank)`` for ratings.

    ``options`` go to the operator. An unknown name raises ValueError.
    """
    if name == RECOMMENDATIONS:
        if group_cols:
            raise ValueError("recommendations are not computed per partition")
        return recommend(data, **options)
    if name not in ANALYSES:
        raise ValueError(f"unknown analysis {name!r}; known: {sorted([*ANALYSES, RECOMMENDATIONS])}")
    result = ANALYSES[name](data, group_cols=group_cols, **options)
    return result.withColumnRenamed(result.columns[-1], name)


def analyze(vertices: DataFrame, relationships: DataFrame, rel_type: str, name: str, **options) -> DataFrame:
    """Vertices with property ``name`` set by running that analysis on all relationships of one type."""
    result = run_analysis(name, edges_of_type(relationships, rel_type), **options)
    return set_property(vertices, result, name)


def analyze_partitions(
    vertices: DataFrame,
    relationships: DataFrame,
    label: str,
    group_rel: str,
    target_rel: str,
    name: str,
    existing: DataFrame | None = None,
    **options,
) -> DataFrame:
    """``(partition_id, id, analysis, value)``: the analysis on each labelled vertex's partition, in one job.

    Every operator carries ``partition_id`` in its keys; there is no loop over partitions. ``existing`` relationships
    are updated.
    """
    edges = partition_edges(vertices, relationships, label, group_rel, target_rel)
    result = run_analysis(name, edges, ["partition_id"], **options)
    if existing is None:
        value = F.col(result.columns[-1]).alias("value")
        existing = result.select("partition_id", "id", F.lit(name).alias("analysis"), value).limit(0)
    return upsert_partition_relationships(existing, result, name)


def recommend_from_query(
    spark: SparkSession, query: str | DataFrame, existing: DataFrame | None = None, n: int = TOP_ITEMS, **options
) -> DataFrame:
    """Recommendations for the three-column result of a query, merged into ``existing`` ones."""
    return recommendation_job(spark, query, existing, n, **options)[0]


def recommendation_job(
    spark: SparkSession, query: str | DataFrame, existing: DataFrame | None = None, n: int = TOP_ITEMS, **options
) -> tuple[DataFrame, DataFrame]:
    """What ``recommend_from_query`` gives, and one row ``mse``, the error of the model on the ratings of the query."""
    recommendations, error = recommend_with_error(ratings_from_query(spark, query), n, **options)
    return recommendations if existing is None else upsert_recommendations(existing, recommendations), error
