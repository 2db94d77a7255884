import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import brute
from tests.graphs import ALL, CYCLE, DAG, DAG13, PATH, RING, as_map, edge_frame, grouped_frame
from vertexloom.operators import components, traversal
from vertexloom.operators.adjacency import Adjacency
from vertexloom.operators.betweenness import betweenness_centrality, edge_centrality, edge_removal_communities, top_edge
from vertexloom.operators.components import connected_components, strongly_connected_components
from vertexloom.operators.pagerank import pagerank
from vertexloom.operators.traversal import (
    all_shortest_paths,
    closeness_centrality,
    reachable,
    shortest_path,
    shortest_path_lengths,
    shortest_paths_to,
)
from vertexloom.operators.triangles import triangle_count
from vertexloom.plans import registered, trade_graph

ODD_EVEN = {i: (22.0 if i % 2 else 4.0) for i in range(1, 11)}


@pytest.mark.parametrize(
    "edges, expected",
    [
        (PATH, {0: 0, 1: 3, 2: 4, 3: 3, 4: 0}),
        (DAG, {0: 0, 1: 1, 2: 0.5, 3: 0, 4: 1.5}),
        (RING, ODD_EVEN),
        (DAG13, dict(enumerate([0, 3, 1, 0, 1, 0, 7, 12, 12, 13, 12, 9, 4]))),
    ],
)
def test_betweenness_known_values(spark, edges, expected):
    assert as_map(betweenness_centrality(edge_frame(spark, edges))) == expected


@pytest.mark.parametrize(
    "edges, expected",
    [
        (PATH, {0: 0.15, 1: 0.2775, 2: 0.385875, 3: 0.477994, 4: 0.556295}),
        (DAG, {0: 0.15, 1: 0.21375, 2: 0.240844, 3: 0.613622, 4: 0.304594}),
        (RING, {i: (1.298246 if i % 2 else 0.701754) for i in range(1, 11)}),
        (CYCLE, {0: 1.0, 1: 1.0, 3: 1.0}),
    ],
)
def test_pagerank_known_values(spark, edges, expected):
    result = as_map(pagerank(edge_frame(spark, edges), tol=1e-7), 12)
    assert result == pytest.approx(expected, abs=5e-6)


def test_closeness_known_values(spark):
    expected = [0.625, 1, 2, 0, 2, 0.290323, 0.347826, 0.4375, 0.4, 0.5, 0.666667, 1, 2]
    assert as_map(closeness_centrality(edge_frame(spark, DAG13))) == dict(enumerate(expected))


# With hot_rows=1 every vertex of degree 2 or more is handled as a hub.
@pytest.mark.parametrize("hot_rows", [None, 1])
def test_grouped_run_equals_brute_force_per_graph(spark, hot_rows):
    frame = grouped_frame(spark, ALL)
    options = {"group_cols": ["g"], "hot_rows": hot_rows}
    for operator, reference, digits in [
        (connected_components, brute.components, 0),
        (strongly_connected_components, brute.strong_components, 0),
        (triangle_count, brute.triangles, 0),
        (closeness_centrality, brute.closeness, 6),
        (betweenness_centrality, brute.betweenness, 6),
    ]:
        result = as_map(operator(frame, **options), digits)
        expected = {(name, v): x for name, edges in ALL.items() for v, x in reference(edges).items()}
        assert result == pytest.approx(expected, abs=2e-6), operator.__name__


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_pagerank_rounds_and_groups(spark, hot_rows):
    frame = grouped_frame(spark, ALL)
    result = as_map(pagerank(frame, max_iter=7, group_cols=["g"], hot_rows=hot_rows), 12)
    expected = {(n, v): x for n, edges in ALL.items() for v, x in brute.pagerank(edges, 7).items()}
    assert result == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_distances_and_paths(spark, hot_rows):
    frame = grouped_frame(spark, ALL)
    lengths = as_map(shortest_path_lengths(frame, group_cols=["g"], hot_rows=hot_rows))
    assert lengths == {(n, s, t): d for n, e in ALL.items() for (s, t), d in brute.distances(e).items()}
    found = all_shortest_paths(frame, group_cols=["g"], hot_rows=hot_rows).collect()
    expected = [(n, p[0], p[-1], len(p) - 1, p) for n, e in ALL.items() for p in brute.shortest_paths(e)]
    assert sorted((r.g, r.src, r.dst, r.distance, tuple(r.path)) for r in found) == sorted(expected)
    pairs = spark.createDataFrame([("dag13", 1, 3), ("dag13", 3, 1), ("tree", 0, 9), ("ring", 1, 6)], "g string, src long, dst long")
    one = {(r.g, r.src, r.dst): tuple(r.path) for r in shortest_path(frame, pairs, ["g"], hot_rows).collect()}
    lowest = {}
    for name, s, t, _, path in expected:
        lowest[name, s, t] = min(path, lowest.get((name, s, t), path))
    assert one == {k: lowest[k] for k in [("dag13", 1, 3), ("tree", 0, 9), ("ring", 1, 6)]}


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_shortest_path_of_all_pairs(spark, hot_rows):
    frame = grouped_frame(spark, ALL)
    lowest = {}
    for name, edges in ALL.items():
        for path in brute.shortest_paths(edges):
            key = (name, path[0], path[-1])
            lowest[key] = min(path, lowest.get(key, path))
    ids = {(name, v) for name, edges in ALL.items() for e in edges for v in e[:2]}
    every = [(n, v, w) for n, v in ids for m, w in ids if n == m] + [("nowhere", 1, 2), ("tree", 0, 999)]
    pairs = spark.createDataFrame(every + every[:5], "g string, src long, dst long")
    found = shortest_path(frame, pairs, ["g"], hot_rows).collect()
    assert len(found) == len(lowest)
    assert {(r.g, r.src, r.dst): tuple(r.path) for r in found} == {k: tuple(v) for k, v in lowest.items()}
    assert all(r.distance == len(r.path) - 1 for r in found)
    assert shortest_path(frame, pairs.limit(0), ["g"]).count() == 0


def test_batches_give_the_same_result(spark):
    edges = edge_frame(spark, RING)
    assert as_map(betweenness_centrality(edges, max_pairs=25)) == ODD_EVEN
    assert as_map(closeness_centrality(edges, max_pairs=25)) == as_map(closeness_centrality(edges))
    assert shortest_path_lengths(edges, max_pairs=25).count() == 100


def test_landmarks_sources_and_targets(spark):
    edges = edge_frame(spark, DAG13)
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id long")
    to_three = as_map(shortest_path_lengths(edges, landmarks=ids(3)))
    assert to_three == {k: d for k, d in brute.distances(DAG13).items() if k[1] == 3}
    assert {tuple(r) for r in reachable(edges, ids(5), ids(3, 0)).collect()} == {(5, 3)}
    paths = all_shortest_paths(edges, ids(1), ids(3)).collect()
    assert sorted(r.path for r in paths) == [[1, 2, 3], [1, 4, 3]]
    assert sorted(r.path for r in shortest_paths_to(edges, ids(4)).collect()) == [[0, 1, 4], [1, 4]]


def test_isolated_vertices_and_empty_edges(spark):
    vertices = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    edges = edge_frame(spark, [(1, 2)])
    empty = edge_frame(spark, [])
    assert as_map(connected_components(edges, vertices)) == {1: 1, 2: 1, 9: 9}
    assert as_map(strongly_connected_components(edges, vertices)) == {1: 1, 2: 2, 9: 9}
    assert as_map(betweenness_centrality(edges, vertices)) == {1: 0, 2: 0, 9: 0}
    assert as_map(closeness_centrality(edges, vertices)) == {1: 2.0, 2: 0, 9: 0}
    assert as_map(connected_components(empty, vertices)) == {1: 1, 2: 2, 9: 9}
    for operator in (pagerank, connected_components, strongly_connected_components, triangle_count,
                     closeness_centrality, betweenness_centrality, shortest_path_lengths, all_shortest_paths,
                     edge_centrality, top_edge):
        assert operator(empty).count() == 0, operator.__name__


def test_long_path_components(spark):
    n = 300
    edges = spark.range(n).selectExpr("id as src", "id + 1 as dst")
    assert set(as_map(connected_components(edges)).values()) == {0}


def rounds_of(monkeypatch) -> list[int]:
    """Collects the seeds of the outer rounds of the search for strong components."""
    seeds: list[int] = []
    original = components.first_origin

    def counted(vertices, edges, seed, *rest):
        seeds.append(seed)
        return original(vertices, edges, seed, *rest)
    monkeypatch.setattr(components, "first_origin", counted)
    return seeds


def test_strong_components_of_a_long_path(spark, monkeypatch):
    seeds = rounds_of(monkeypatch)
    edges = spark.range(60).selectExpr("id AS src", "id + 1 AS dst")
    assert as_map(strongly_connected_components(edges)) == {v: v for v in range(61)}
    assert not seeds  # peeled off


def test_strong_components_of_a_chain_of_cycles(spark, monkeypatch):
    seeds = rounds_of(monkeypatch)
    n = 40
    edges = [(2 * i, 2 * i + 1) for i in range(n)] + [(2 * i + 1, 2 * i) for i in range(n)] + [(2 * i + 1, 2 * i + 2) for i in range(n - 1)]
    assert as_map(strongly_connected_components(edge_frame(spark, edges))) == {v: v - v % 2 for v in range(2 * n)}
    assert len(seeds) <= 12


def test_search_takes_one_row_for_64_roots(spark):
    """All distances of a graph with more roots than fit a row, two groups of unequal size, a row per vertex and block."""
    random = np.random.default_rng(4)
    graphs = {"large": [tuple(map(int, e)) for e in random.integers(0, 150, (400, 2))], "small": [(0, 1), (1, 2), (2, 0), (2, 9)]}
    frame = grouped_frame(spark, graphs)
    expected = {(n, s, t): d for n, e in graphs.items() for (s, t), d in brute.distances(e).items()}
    assert as_map(shortest_path_lengths(frame, group_cols=["g"])) == expected
    assert as_map(closeness_centrality(frame, group_cols=["g"])) == pytest.approx(
        {(n, v): x for n, e in graphs.items() for v, x in brute.closeness(e).items()}, abs=1e-6)
    sources = spark.createDataFrame([("large", 3), ("small", 9), ("small", 77)], "g string, id long")
    reached = {tuple(row) for row in reachable(frame, sources, group_cols=["g"]).collect()}
    ends = {("large", 3), ("small", 9)}
    assert reached == {(n, s, t) for n, s, t in expected if (n, s) in ends} | {("small", 77, 77)}

    simple = traversal.simple_edges(frame, ["g"])
    everyone = traversal.all_vertices(frame, None, ["g"])
    blocks = traversal.in_blocks(everyone, ["g"])
    adjacency = Adjacency(simple, "src", ["g"])
    for last in traversal.sweep(adjacency, blocks, ["g"], tally=True):
        assert last.count() <= 3 * everyone.count()  # all roots fit into three blocks
    adjacency.release()
    assert last.agg(F.sum("n")).first()[0] == len(expected) and last.agg(F.sum("total")).first()[0] == sum(expected.values())


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_edge_scores_equal_the_line_graph(spark, hot_rows):
    """Two-way edges, self-loops, parallel edges and edges that stand alone; more roots than one row holds."""
    random = np.random.default_rng(6)
    graphs = {**ALL, "dense": [tuple(map(int, e)) for e in random.integers(0, 12, (60, 2))], "alone": [(1, 2), (5, 6)],
              "wide": [(i, i + 1) for i in range(70)]}
    found = as_map(edge_centrality(grouped_frame(spark, graphs), ["g"], hot_rows=hot_rows))
    expected = {(name, *edge): score for name, edges in graphs.items() for edge, score in brute.edge_centrality(edges).items()}
    assert found == pytest.approx(expected, abs=2e-6)


def test_communities_of_the_query_equal_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    walks: dict = {}
    for row in trade_graph.order_walks(spark, folder, 8).collect():
        walks.setdefault((row.partition_id, row.walk), []).append((row.src, row.dst))
    steps: dict = {}
    for row in sorted(registered.edge_removal_steps(spark, folder).collect(), key=lambda row: row.step):
        steps.setdefault((row.partition_id, row.walk), []).append((row.src, row.dst))
    for walk, edges in walks.items():
        for removals in range(len(edges) + 1):
            expected, parts = brute.communities(edges, removals)
            if len(expected) < removals or len(set(parts.values())) >= 3:
                break
        assert steps.get(walk, []) == expected


def test_edge_centrality_and_communities(spark):
    edges = edge_frame(spark, DAG)
    assert as_map(edge_centrality(edges)) == pytest.approx(brute.edge_centrality(DAG), abs=2e-6)
    # Two directed triangles and a bridge; three edges tie for the first step, the lowest goes. The third removal splits.
    two = [(1, 2), (2, 3), (3, 1), (11, 12), (12, 13), (13, 11), (3, 11)]
    communities, removals = edge_removal_communities(edge_frame(spark, two), target_components=2)
    steps, labels = brute.communities(two, 3)
    assert [(r.src, r.dst) for r in removals.orderBy("step").collect()] == steps
    assert as_map(communities) == labels and len(set(labels.values())) == 2


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_grouped_communities_equal_brute_force(spark, hot_rows):
    graphs = {name: ALL[name] for name in ("dag", "ring", "tree", "cycle")}
    frame = grouped_frame(spark, graphs)
    communities, removals = edge_removal_communities(frame, max_removals=3, group_cols=["g"], hot_rows=hot_rows)
    removed = {(r.g, r.step): (r.src, r.dst) for r in removals.collect()}
    labels = as_map(communities)
    for name, edges in graphs.items():
        steps, expected = brute.communities(edges, 3)
        assert {s: e for (g, s), e in removed.items() if g == name} == dict(enumerate(steps, 1))
        assert {v: c for (g, v), c in labels.items() if g == name} == expected
