"""Searches that hold whole graphs in a task (``functions.packs``)."""

import pytest
from pyspark.sql import functions as F

from tests import brute
from tests.graphs import ALL, as_map, grouped_frame
from vertexloom.functions import packs
from vertexloom.operators import betweenness, components, searches, traversal

# A hub with more edges than are met one by one, more than 64 vertices, and ways back from its leaves.
HUB = [(0, i) for i in range(1, 90)] + [(i, 0) for i in range(1, 90, 3)] + [(i, i + 1) for i in range(1, 89, 2)]
# A path of many levels.
LONG = [(i, i + 1) for i in range(70)]
GRAPHS = {**ALL, "hub": HUB, "long": LONG}
OPERATORS = {
    "closeness": (traversal.closeness_centrality, brute.closeness),
    "lengths": (traversal.shortest_path_lengths, brute.distances),
    "betweenness": (betweenness.betweenness_centrality, brute.betweenness),
    "edges": (betweenness.edge_centrality, brute.edge_centrality),
}


def expected(reference):
    rows = {}
    for name, edges in GRAPHS.items():
        for key, value in reference(edges).items():
            rows[(name, *key) if isinstance(key, tuple) else (name, key)] = value
    return rows


@pytest.fixture
def no_joins(monkeypatch):
    """Graphs that fit a task take no round of joins per level."""
    def fail(*args, **options):
        raise AssertionError("searched by joins")

    monkeypatch.setattr(traversal, "sweep", fail)
    monkeypatch.setattr(betweenness, "sweep", fail)


@pytest.mark.parametrize("name", OPERATORS)
def test_whole_graphs_are_searched_in_tasks(spark, no_joins, monkeypatch, name):
    for pace, value in (("EDGE_BITS", 500.0), ("ROWS", 500.0)):  # several ranges of columns
        monkeypatch.setattr(traversal, pace, value)
    monkeypatch.setattr(betweenness, "EDGE_ROOTS", 500.0)
    monkeypatch.setattr(packs, "FEWEST_EDGES", 16)  # some share packs, some have their own
    operator, reference = OPERATORS[name]
    assert as_map(operator(grouped_frame(spark, GRAPHS), group_cols=["g"])) == pytest.approx(expected(reference), abs=2e-6)


@pytest.mark.parametrize("name", OPERATORS)
def test_large_graphs_are_searched_by_joins_beside_packed_ones(spark, monkeypatch, name):
    monkeypatch.setattr(packs, "PACK_EDGES", 12)
    operator, reference = OPERATORS[name]
    few = {key: edges for key, edges in GRAPHS.items() if key not in ("hub", "long")}
    rows = {key: value for key, value in expected(reference).items() if key[0] in few}
    assert as_map(operator(grouped_frame(spark, few), group_cols=["g"])) == pytest.approx(rows, abs=2e-6)


def test_all_paths_are_listed_in_tasks(spark, no_joins):
    found = traversal.all_shortest_paths(grouped_frame(spark, GRAPHS), group_cols=["g"]).collect()
    rows = [(n, p[0], p[-1], len(p) - 1, p) for n, e in GRAPHS.items() for p in brute.shortest_paths(e)]
    assert sorted((r.g, r.src, r.dst, r.distance, tuple(r.path)) for r in found) == sorted(rows)


@pytest.mark.parametrize("batch", [1, 7])
def test_small_batches_leave_nothing_out(monkeypatch, batch):
    monkeypatch.setattr(searches, "BATCH", batch)
    edges = sorted({(n, a, b) for n, e in GRAPHS.items() for a, b in e if a != b})
    columns = dict(zip(("g", "src", "dst"), map(list, zip(*edges))))
    pack = packs.Pack.read(packs._pack(["g"], packs.pa.table(columns)).to_pylist()[0])
    width = int(pack.sizes.max())
    paths = [tuple(r.values()) for b in searches.paths_between(pack, 0, width) for r in b.to_pylist()]
    rows = [(n, p[0], p[-1], len(p) - 1, list(p)) for n, e in GRAPHS.items() for p in brute.shortest_paths(e)]
    assert sorted(paths) == sorted(rows)
    lengths = [tuple(r.values()) for b in searches.distances(pack, 0, width) for r in b.to_pylist()]
    assert sorted(lengths) == sorted((n, *pair, d) for n, e in GRAPHS.items() for pair, d in brute.distances(e).items() if d)


def test_names_as_ids_and_nulls(spark):
    named = [(a if a is None else f"v{a:02}", b if b is None else f"v{b:02}") for a, b in ALL["mixed"]]
    edges = spark.createDataFrame(named, "src string, dst string")
    assert as_map(traversal.closeness_centrality(edges)) == {f"v{k:02}": round(x, 6) for k, x in brute.closeness(ALL["mixed"]).items()}
    with_null = edges.unionByName(spark.createDataFrame([(None, "v01"), ("v01", None)], "src string, dst string"))
    joined = as_map(betweenness.edge_centrality(with_null, hot_rows=1))
    assert as_map(betweenness.edge_centrality(with_null)) == joined


def test_communities_are_split_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(betweenness, "_communities_by_joins", None)
    frame = grouped_frame(spark, GRAPHS)
    found, removals = betweenness.edge_removal_communities(frame, max_removals=3, group_cols=["g"])
    assert found.columns == ["g", "id", "community"] and removals.columns == ["g", "step", "src", "dst", "score"]
    wanted = {name: brute.communities(edges, 3) for name, edges in GRAPHS.items()}
    assert as_map(found) == {(name, v): part for name, (_, parts) in wanted.items() for v, part in parts.items()}
    steps = {(r.g, r.step): (r.src, r.dst) for r in removals.collect()}
    assert steps == {(name, i): edge for name, (edges, _) in wanted.items() for i, edge in enumerate(edges, 1)}
    found, removals = betweenness.edge_removal_communities(grouped_frame(spark, ALL), target_components=3, group_cols=["g"])
    wanted = {}
    for name, edges in ALL.items():
        for removed in range(len(edges) + 1):
            steps, parts = brute.communities(edges, removed)
            if len(set(parts.values())) >= 3 or len(steps) < removed:
                break
        wanted |= {(name, v): part for v, part in parts.items()}
    assert as_map(found) == wanted


def test_half_a_millionth_is_rounded_up(spark):
    """As Spark rounds: a score ending in a five in the seventh place."""
    assert searches.np.floor(0.0078125 * 1e6 + 0.5) / 1e6 == spark.range(1).select(F.round(F.lit(0.0078125), 6)).first()[0]


def test_strong_components_in_tasks_and_beside_joins(spark, monkeypatch):
    wanted = {(n, v): c for n, edges in GRAPHS.items() for v, c in brute.strong_components(edges).items()}
    monkeypatch.setattr(packs, "PACK_EDGES", 12)  # the ring and the hub take a round of joins
    assert as_map(components.strongly_connected_components(grouped_frame(spark, GRAPHS), group_cols=["g"])) == wanted
    monkeypatch.undo()
    monkeypatch.setattr(components, "first_origin", None)
    assert as_map(components.strongly_connected_components(grouped_frame(spark, GRAPHS), group_cols=["g"])) == wanted
