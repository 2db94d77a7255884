"""The registered queries: every operator on the whole tables of a scale-factor folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.rounds import checkpointed, scratch_path
from vertexloom.operators import betweenness, components, graph, pregel, recommend, traversal, triangles, upserts
from vertexloom.operators.pagerank import pagerank
from vertexloom.plans import jobs, trade_graph
from vertexloom.sources import relationships as rel
from vertexloom.sources import text
from vertexloom.streaming import updates

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NATION = ["partition_id"]
TYPE = ["rel_type"]
NATION_AND_TYPE = ["partition_id", "rel_type"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def micros(df: DataFrame, name: str) -> DataFrame:
    """Ranks as whole millionths, for comparison: floor(rank * 10^6 + 0.318). Ranks near sources are simple fractions such
    as 0.3741875, right on a boundary of rounding, where the order of summation would decide; the odd offset avoids it."""
    return df.withColumn(f"{name}_micros", F.floor(F.col(name) * 1e6 + 0.318309886).cast("double")).drop(name)


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = trade_graph.table(spark, sf_dir, "customer")
    return customers.select((F.col("c_custkey") * 2 + 1).alias("id"), F.col("c_acctbal").alias("balance"))


def order_counts(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    """``(id, value)``: number of orders of each customer, of one status if given."""
    orders = trade_graph.table(spark, sf_dir, "orders")
    if status is not None:
        orders = orders.filter(F.col("o_orderstatus") == status)
    counts = orders.groupBy((F.col("o_custkey") * 2 + 1).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("id", F.col("n").cast("double").alias("value"))


def first_customers(edges: DataFrame, groups: list[str]) -> DataFrame:
    """The lowest vertex of each group."""
    return edges.groupBy(*groups).agg(F.min(F.least("src", "dst")).alias("id"))


# --- sources and sinks -----------------------------------------------------------------------------------------------


@query
def read_edge_list(spark, sf_dir):
    path = scratch_path(spark, "edges")
    text.write_edge_list(trade_graph.order_chain(spark, sf_dir), path)
    return text.read_edge_list(spark, path)


@query
def read_edge_list_canonical(spark, sf_dir):
    path = scratch_path(spark, "edges")
    text.write_edge_list(trade_graph.order_chain(spark, sf_dir), path)
    return text.read_edge_list(spark, path, canonical=True)


@query
def read_property_updates(spark, sf_dir):
    path = scratch_path(spark, "updates")
    text.write_property_updates(order_counts(spark, sf_dir), path)
    return text.read_property_updates(spark, path)


@query
def write_property_updates(spark, sf_dir):
    """The number of lines written, as the writer reports it, beside the number read back."""
    path = scratch_path(spark, "updates")
    written = text.write_property_updates(order_counts(spark, sf_dir), path)
    return text.read_property_updates(spark, path).agg(
        F.lit(written).cast("long").alias("written"), F.count(F.lit(1)).alias("read"), F.sum("value").alias("total")
    )


@query
def read_ratings(spark, sf_dir):
    path = scratch_path(spark, "ratings")
    text.write_rows(trade_graph.ratings(spark, sf_dir), path)
    return text.read_ratings(spark, path)


@query
def read_recommendations(spark, sf_dir):
    path = scratch_path(spark, "recommendations")
    scored = trade_graph.ratings(spark, sf_dir).withColumnRenamed("rating", "score")
    text.write_rows(recommend.rank_candidates(scored), path)
    return text.read_recommendations(spark, path)


@query
def vertex_scan(spark, sf_dir):
    return rel.vertex_scan(trade_graph.vertices(spark, sf_dir))


@query
def vertex_scan_by_label(spark, sf_dir):
    return rel.vertex_scan(trade_graph.vertices(spark, sf_dir), "Customer")


@query
def edges_of_type(spark, sf_dir):
    return rel.edges_of_type(trade_graph.relationships(spark, sf_dir), "1-URGENT")


@query
def edges_of_type_distinct(spark, sf_dir):
    return rel.edges_of_type(trade_graph.relationships(spark, sf_dir), "1-URGENT", distinct=True)


@query
def partition_edges(spark, sf_dir):
    vertices, relationships = trade_graph.vertices(spark, sf_dir), trade_graph.relationships(spark, sf_dir)
    return rel.partition_edges(vertices, relationships, "Nation", "HAS_CUSTOMER", "2-HIGH")


@query
def ratings_from_query(spark, sf_dir):
    trade_graph.table(spark, sf_dir, "lineitem").createOrReplaceTempView("rated_lines")
    trade_graph.table(spark, sf_dir, "orders").createOrReplaceTempView("rated_orders")
    return rel.ratings_from_query(
        spark,
        "SELECT o_custkey, l_suppkey, sum(l_quantity) FROM rated_lines JOIN rated_orders ON l_orderkey = o_orderkey "
        "GROUP BY o_custkey, l_suppkey",
    )


@query
def set_property(spark, sf_dir):
    vertices = trade_graph.vertices(spark, sf_dir).join(balances(spark, sf_dir), "id", "left")
    return upserts.set_property(vertices, order_counts(spark, sf_dir, "F"), "balance")


@query
def unknown_ids(spark, sf_dir):
    vertices = trade_graph.vertices(spark, sf_dir)
    neighbours = order_counts(spark, sf_dir).select((F.col("id") + 2).alias("id"), "value")
    return upserts.unknown_ids(vertices, neighbours)


@query
def upsert_partition_relationships(spark, sf_dir):
    chain = trade_graph.order_chain(spark, sf_dir)
    degree = chain.groupBy("partition_id", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("value"))
    existing = chain.groupBy("partition_id", F.col("dst").alias("id")).agg(F.min("src").alias("value"))
    existing = existing.withColumn("analysis", F.when(F.col("id") % 4 == 1, "degree").otherwise("other"))
    once = upserts.upsert_partition_relationships(existing, degree, "degree")
    return upserts.upsert_partition_relationships(once, degree, "degree")


@query
def upsert_recommendations(spark, sf_dir):
    scored = trade_graph.ratings(spark, sf_dir)
    old = recommend.rank_candidates(scored.select("user", "item", (-F.col("rating")).alias("score")), 12)
    new = recommend.rank_candidates(scored.select("user", "item", F.col("rating").alias("score")), 10)
    return upserts.upsert_recommendations(upserts.upsert_recommendations(old, new), new)


# --- graph construction ----------------------------------------------------------------------------------------------


@query
def vertices_from_edges(spark, sf_dir):
    return graph.vertices_from_edges(trade_graph.order_chain(spark, sf_dir), {"score": F.lit(1)})


@query
def build_graph(spark, sf_dir):
    """Nations as the only given vertices: customers come in as end points of edges, with the default label."""
    nations = rel.vertex_scan(trade_graph.vertices(spark, sf_dir), "Nation")
    edges = trade_graph.relationships(spark, sf_dir)
    return graph.graph(nations, edges, {"label": F.lit("unknown"), "name": F.lit("")}).vertices


@query
def map_vertices(spark, sf_dir):
    g = graph.graph(balances(spark, sf_dir), trade_graph.order_chain(spark, sf_dir))
    return rounded(graph.map_vertices(g, {"balance": F.col("balance") * 2 + F.col("id")}).vertices, "balance")


@query
def map_edges(spark, sf_dir):
    g = graph.graph(None, trade_graph.order_chain(spark, sf_dir).select("src", "dst", "rel_type"))
    return graph.map_edges(g, {"rel_type": F.upper("rel_type"), "gap": F.col("dst") - F.col("src")}).edges


def _with_balances(spark, sf_dir):
    return graph.graph(balances(spark, sf_dir), trade_graph.order_chain(spark, sf_dir).select("src", "dst", "rel_type"))


@query
def triplets(spark, sf_dir):
    rows = graph.triplets(_with_balances(spark, sf_dir))
    return rows.select(
        "src", "dst", "rel_type",
        F.col("src_attr.balance").alias("src_balance"), F.col("dst_attr.balance").alias("dst_balance"),
    )


@query
def map_triplets(spark, sf_dir):
    difference = {"difference": F.round(F.col("src_attr.balance") - F.col("dst_attr.balance"), 6)}
    return graph.map_triplets(_with_balances(spark, sf_dir), difference).edges


@query
def merge_end_lists(spark, sf_dir):
    """Per distinct edge, the members of both ends' lists; the list of a customer holds the types of its relationships."""
    chain = trade_graph.order_chain(spark, sf_dir)
    ends = chain.select(F.explode(F.array("src", "dst")).alias("id"), "rel_type").distinct()
    lists = ends.groupBy("id").agg(F.sort_array(F.collect_list("rel_type")).alias("types"))
    merged = graph.merge_end_lists(graph.Graph(lists, graph.simplify(chain)), "types", "types").edges
    return merged.select("src", "dst", F.array_join(F.sort_array("types"), ",").alias("types"))


@query
def remove_edges(spark, sf_dir):
    chain = trade_graph.order_chain(spark, sf_dir)
    g = graph.graph(None, chain.select("src", "dst", "rel_type"))
    return graph.remove_edges(g, rel.edges_of_type(chain, "5-LOW")).edges


@query
def canonicalize(spark, sf_dir):
    return graph.canonicalize(trade_graph.order_chain(spark, sf_dir).select("src", "dst"))


@query
def simplify(spark, sf_dir):
    return graph.simplify(trade_graph.order_chain(spark, sf_dir))


def _neighbors(direction: str) -> Query:
    def run(spark, sf_dir):
        lists = graph.neighbors(trade_graph.order_chain(spark, sf_dir), direction)
        return lists.select("id", F.array_join("neighbors", ",").alias("neighbors"))

    return run


for _direction in ("out", "in", "both"):
    QUERIES[f"neighbors_{_direction}"] = _neighbors(_direction)


@query
def line_graph(spark, sf_dir):
    lines = graph.line_graph(trade_graph.order_chain(spark, sf_dir))
    return lines.select("src.src", F.col("src.dst").alias("via"), "dst.dst")


@query
def index_vertices(spark, sf_dir):
    return graph.index_vertices(trade_graph.vertices(spark, sf_dir))


@query
def random_vertex(spark, sf_dir):
    return graph.random_vertex(trade_graph.vertices(spark, sf_dir), seed=7).select("id")


@query
def count_graph(spark, sf_dir):
    chain = trade_graph.order_chain(spark, sf_dir).select("rel_type", "src", "dst")
    return graph.count_graph(graph.graph(None, chain, group_cols=TYPE))


# --- vertex programs -------------------------------------------------------------------------------------------------


@query
def pregel_hops(spark, sf_dir):
    """Hops from the lowest customer of each nation, null where there is no way."""
    chain = trade_graph.order_chain(spark, sf_dir)
    start = first_customers(chain, NATION).withColumn("hops", F.lit(0))
    everyone = graph.vertices_from_edges(chain, group_cols=NATION).join(start, [*NATION, "id"], "left")
    further = pregel.src("hops") + 1
    nearer = pregel.dst("hops").isNull() | (pregel.dst("hops") > further)
    return pregel.pregel(
        graph.Graph(everyone, graph.simplify(chain, NATION), tuple(NATION)),
        to_dst=F.when(pregel.src("hops").isNotNull() & nearer, further),
        combine=F.min(pregel.message()),
        update={"hops": pregel.message()},
    )


@query
def aggregate_messages(spark, sf_dir):
    """Sum of the balances of each customer's predecessors, one per relationship."""
    g = _with_balances(spark, sf_dir)
    sent = pregel.aggregate_messages(
        g, to_dst=pregel.src("balance"), combine=F.sum(pregel.message()), reads=["src"]
    )
    return rounded(sent, "message")


@query
def propagate_max(spark, sf_dir):
    chain = trade_graph.order_chain(spark, sf_dir).select("rel_type", "src", "dst")
    whole = balances(spark, sf_dir).select("id", F.floor("balance").alias("balance"))
    everyone = graph.vertices_from_edges(chain, group_cols=TYPE).join(whole, "id")
    return pregel.propagate_max(graph.Graph(everyone, chain, tuple(TYPE)), "balance")


@query
def collect_successors(spark, sf_dir):
    lists = pregel.collect_successors(graph.graph(None, trade_graph.order_chain(spark, sf_dir)))
    return lists.select("id", F.array_join("successors", ",").alias("successors"))


# --- analyses --------------------------------------------------------------------------------------------------------


@query
def pagerank_to_tolerance(spark, sf_dir):
    return micros(pagerank(trade_graph.order_chain(spark, sf_dir)), "pagerank")


@query
def pagerank_by_type(spark, sf_dir):
    return micros(pagerank(trade_graph.order_chain(spark, sf_dir), group_cols=TYPE), "pagerank")


@query
def connected_components(spark, sf_dir):
    return components.connected_components(trade_graph.order_chain(spark, sf_dir))


@query
def connected_components_by_type(spark, sf_dir):
    return components.connected_components(trade_graph.order_chain(spark, sf_dir), group_cols=TYPE)


@query
def strongly_connected_components(spark, sf_dir):
    return components.strongly_connected_components(trade_graph.order_chain(spark, sf_dir))


@query
def strongly_connected_components_by_type(spark, sf_dir):
    return components.strongly_connected_components(trade_graph.order_chain(spark, sf_dir), group_cols=TYPE)


@query
def triangle_count(spark, sf_dir):
    return triangles.triangle_count(trade_graph.order_chain(spark, sf_dir))


@query
def triangle_count_by_type(spark, sf_dir):
    return triangles.triangle_count(trade_graph.order_chain(spark, sf_dir), TYPE)


@query
def shortest_path_lengths(spark, sf_dir):
    return traversal.shortest_path_lengths(trade_graph.order_chain(spark, sf_dir), group_cols=NATION)


@query
def shortest_path_lengths_to_landmarks(spark, sf_dir):
    chain = trade_graph.order_chain(spark, sf_dir)
    landmarks = first_customers(chain, NATION_AND_TYPE)
    return traversal.shortest_path_lengths(chain, landmarks, group_cols=NATION_AND_TYPE)


@query
def closeness_centrality(spark, sf_dir):
    result = traversal.closeness_centrality(trade_graph.order_chain(spark, sf_dir), group_cols=NATION)
    return rounded(result, "closeness")


@query
def betweenness_centrality(spark, sf_dir):
    result = betweenness.betweenness_centrality(trade_graph.order_chain(spark, sf_dir), group_cols=NATION)
    return rounded(result, "betweenness")


@query
def edge_centrality(spark, sf_dir):
    """Scores of the edges that follow or precede another one, per nation and type; others have none."""
    result = betweenness.edge_centrality(trade_graph.order_chain(spark, sf_dir), NATION_AND_TYPE)
    return rounded(result, "score")


@query
def top_edge(spark, sf_dir):
    return betweenness.top_edge(trade_graph.order_chain(spark, sf_dir), NATION_AND_TYPE)


def _communities(spark, sf_dir):
    """Every walk of 8 orders in a nation's chain split into 3 components."""
    walks = trade_graph.order_walks(spark, sf_dir, 8)
    return betweenness.edge_removal_communities(walks, target_components=3, group_cols=["partition_id", "walk"])


@query
def edge_removal_communities(spark, sf_dir):
    return _communities(spark, sf_dir)[0]


@query
def edge_removal_steps(spark, sf_dir):
    return _communities(spark, sf_dir)[1]


@query
def all_shortest_paths(spark, sf_dir):
    paths = traversal.all_shortest_paths(trade_graph.order_chain(spark, sf_dir), group_cols=NATION_AND_TYPE)
    return paths.withColumn("path", F.array_join("path", ","))


@query
def shortest_paths_to(spark, sf_dir):
    chain = trade_graph.order_chain(spark, sf_dir)
    paths = traversal.shortest_paths_to(chain, first_customers(chain, NATION), NATION)
    return paths.withColumn("path", F.array_join("path", ","))


@query
def shortest_path(spark, sf_dir):
    """From the lowest to the highest customer of each nation, for each relationship type."""
    chain = trade_graph.order_chain(spark, sf_dir)
    ends = chain.groupBy(*NATION_AND_TYPE).agg(
        F.min(F.least("src", "dst")).alias("src"), F.max(F.greatest("src", "dst")).alias("dst")
    )
    paths = traversal.shortest_path(chain, ends, NATION_AND_TYPE)
    return paths.withColumn("path", F.array_join("path", ","))


@query
def reachable(spark, sf_dir):
    chain = trade_graph.order_chain(spark, sf_dir)
    return traversal.reachable(chain, first_customers(chain, NATION_AND_TYPE), group_cols=NATION_AND_TYPE)


# --- recommendations -------------------------------------------------------------------------------------------------


@query
def distinct_users(spark, sf_dir):
    return recommend.distinct_users(trade_graph.ratings(spark, sf_dir))


@query
def distinct_items(spark, sf_dir):
    return recommend.distinct_items(trade_graph.ratings(spark, sf_dir))


@query
def unseen(spark, sf_dir):
    """Pairs of customer and supplier with accepted lines that never had a returned one."""
    lines = trade_graph.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    orders = trade_graph.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    pairs = lines.join(orders, "l_orderkey").select(
        F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item"), (F.col("l_returnflag") == "R").alias("returned")
    )
    return recommend.unseen(pairs.filter("returned"), pairs.filter("not returned").select("user", "item").distinct())


@query
def unseen_counts(spark, sf_dir):
    return recommend.unseen_counts(trade_graph.ratings(spark, sf_dir))


@query
def rating_mse(spark, sf_dir):
    """Error of the prediction "as many lines as this supplier's customers have on average"."""
    ratings = trade_graph.ratings(spark, sf_dir)
    average = ratings.groupBy("item").agg(F.avg("rating").alias("prediction"))
    return rounded(recommend.rating_mse(ratings, ratings.join(average, "item")), "mse")


@query
def rank_candidates(spark, sf_dir):
    scored = trade_graph.ratings(spark, sf_dir).withColumnRenamed("rating", "score")
    return recommend.rank_candidates(scored, 5)


@query
def predict(spark, sf_dir):
    ratings = checkpointed(trade_graph.ratings(spark, sf_dir))
    model = recommend.train_implicit(ratings, reg=0.1)
    return recommend.predict(model, ratings)


@query
def best_unseen(spark, sf_dir):
    """The ten best suppliers that a customer never had, by whole-number factors from balances and nations."""
    def factors(name: str, key: str, prefix: str) -> DataFrame:
        balance, nation = F.floor(F.col(f"{prefix}_acctbal") / 100).cast("double"), F.col(f"{prefix}_nationkey")
        features = F.array(balance, (nation % 5).cast("double"), (nation % 3 - 1).cast("double") * 50)
        return trade_graph.table(spark, sf_dir, name).select(F.col(f"{prefix}_{key}").cast("int").alias("id"), features.alias("features"))
    users, items = factors("customer", "custkey", "c"), factors("supplier", "suppkey", "s")
    return recommend.best_unseen(users.withColumnRenamed("id", "user"), items.withColumnRenamed("id", "item"), trade_graph.ratings(spark, sf_dir))


@query
def recommend_items(spark, sf_dir):
    return recommend.recommend(trade_graph.ratings(spark, sf_dir), reg=0.1)


# --- jobs ------------------------------------------------------------------------------------------------------------


@query
def run_analysis(spark, sf_dir):
    edges = rel.edges_of_type(trade_graph.relationships(spark, sf_dir), "2-HIGH")
    return jobs.run_analysis("triangle_count", edges)


def urgent_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of the customers linked by urgent orders, as a property of all vertices."""
    vertices, relationships = trade_graph.vertices(spark, sf_dir), trade_graph.relationships(spark, sf_dir)
    return jobs.analyze(vertices, relationships, "1-URGENT", "pagerank")


@query
def analyze(spark, sf_dir):
    return micros(urgent_ranks(spark, sf_dir), "pagerank")


@query
def analyze_components(spark, sf_dir):
    """Components of the customers linked by urgent orders, as a property of all vertices; -1 without such an order."""
    vertices, relationships = trade_graph.vertices(spark, sf_dir), trade_graph.relationships(spark, sf_dir)
    return jobs.analyze(vertices, relationships, "1-URGENT", "connected_components").fillna(-1, "connected_components")


@query
def analyze_partitions_components(spark, sf_dir):
    """Components inside each nation; whole numbers stay whole numbers."""
    vertices, relationships = trade_graph.vertices(spark, sf_dir), trade_graph.relationships(spark, sf_dir)
    return jobs.analyze_partitions(vertices, relationships, "Nation", "HAS_CUSTOMER", "3-MEDIUM", "connected_components")


@query
def analyze_partitions(spark, sf_dir):
    """Closeness inside each nation, merged into relationships that hold the customers' balances so far."""
    vertices, relationships = trade_graph.vertices(spark, sf_dir), trade_graph.relationships(spark, sf_dir)
    owned = rel.edges_of_type(relationships, "HAS_CUSTOMER").select(F.col("src").alias("partition_id"), F.col("dst").alias("id"))
    existing = owned.join(balances(spark, sf_dir), "id").select(
        "partition_id", "id", F.lit("closeness_centrality").alias("analysis"), F.col("balance").alias("value")
    )
    merged = jobs.analyze_partitions(
        vertices, relationships, "Nation", "HAS_CUSTOMER", "3-MEDIUM", "closeness_centrality", existing
    )
    return rounded(merged, "value")


RATED = """SELECT o_custkey, l_suppkey, count(*) FROM rated_lines JOIN rated_orders ON l_orderkey = o_orderkey
GROUP BY o_custkey, l_suppkey"""


def _rated_views(spark: SparkSession, sf_dir: str) -> None:
    trade_graph.table(spark, sf_dir, "lineitem").createOrReplaceTempView("rated_lines")
    trade_graph.table(spark, sf_dir, "orders").createOrReplaceTempView("rated_orders")


@query
def recommend_from_query(spark, sf_dir):
    """From SQL text, merged into three ranks that each customer has already."""
    _rated_views(spark, sf_dir)
    old = recommend.rank_candidates(trade_graph.ratings(spark, sf_dir).withColumnRenamed("rating", "score"), 3)
    return jobs.recommend_from_query(spark, RATED, old.select("user", "item", "rank"), reg=0.1)


@query
def recommendation_ranks(spark, sf_dir):
    """How many ranks each customer gets from a job by SQL text with the usual constants: as many as there are
    suppliers it never had, ten at most. Which items they are is for the model to say."""
    _rated_views(spark, sf_dir)
    recommendations, _ = jobs.recommendation_job(spark, RATED)
    return recommendations.groupBy("user").agg(F.count(F.lit(1)).alias("ranks"), F.max("rank").cast("long").alias("last_rank"))


@query
def apply_updates_stream(spark, sf_dir):
    """Order counts applied to all vertices, then counts of finished orders over them, each by one run of the stream."""
    source, target, progress = (scratch_path(spark, name) for name in ("arrived", "vertices", "progress"))
    updates.create_target(trade_graph.vertices(spark, sf_dir), target)
    for arrival, status in (("first", None), ("second", "F")):
        text.write_property_updates(order_counts(spark, sf_dir, status), f"{source}/{arrival}")
        stream = updates.apply_updates_stream(spark, f"{source}/*", target, progress, "orders")
        stream.awaitTermination()
    return updates.read_current(spark, target)


def imported(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table after results of all kinds came in twice: counts of all orders, then of finished ones, for vertices and
    per nation; recommendations by falling, then by rising rating. One batch per file and a base after every few."""
    source, target = scratch_path(spark, "arrived"), scratch_path(spark, "log")
    vertices = trade_graph.vertices(spark, sf_dir)
    homes = trade_graph.table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") * 2 + 1).alias("id"), (F.col("c_nationkey").cast("long") * 2).alias("partition_id"))
    old = homes.select("partition_id", "id", F.lit("balance").alias("analysis"), F.lit(0.0).alias("value"))
    scored = trade_graph.ratings(spark, sf_dir)
    recommended = recommend.rank_candidates(scored.select("user", "item", (-F.col("rating")).alias("score")), 12)
    updates.create_log(target, vertices, old, recommended)
    for status in (None, "F"):
        counts = order_counts(spark, sf_dir, status)
        text.write_results(counts, source, "orders")
        text.write_results(counts.join(homes, "id").select("partition_id", "id", "value"), source, "orders")
        if status:
            best = recommend.rank_candidates(scored.select("user", "item", F.col("rating").alias("score")), 10)
            text.write_results(best.select("user", "item", "rank"), source, jobs.RECOMMENDATIONS)
        updates.import_results_stream(spark, source, target, max_files=40, compact_after=2).awaitTermination()
    return updates.read_table(spark, target, table)


@query
def import_results_vertices(spark, sf_dir):
    return imported(spark, sf_dir, "vertices")


@query
def import_results_partitions(spark, sf_dir):
    return imported(spark, sf_dir, "relationships")


@query
def import_results_recommendations(spark, sf_dir):
    return imported(spark, sf_dir, "recommendations")
