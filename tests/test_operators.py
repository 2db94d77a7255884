import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import brute
from tests.graphs import ALL, DAG, as_map, edge_frame, grouped_frame
from vertexloom.functions.ordering import with_next, with_position
from vertexloom.functions.skew import join_spread
from vertexloom.operators import graph, pregel, recommend, upserts
from vertexloom.plans import jobs
from vertexloom.sources import relationships as rel
from vertexloom.sources import text
from vertexloom.streaming import updates


def rows(df):
    return sorted(tuple(row) for row in df.collect())


# Three harbours own ships; ships pass cargo on. Ship 31 belongs to two harbours, ship 40 to none, ship 32 passes cargo to itself.
OWNED = {"n": [11, 12, 13, 14, 31], "m": [21, 22, 23], "s": [31, 32, 33]}
PASSED = [(11, 12), (12, 13), (13, 11), (13, 14), (14, 31), (21, 22), (22, 21), (22, 23), (31, 32), (32, 32), (32, 33), (33, 40), (40, 11), (11, 12)]
HARBOURS = {"n": 1, "m": 2, "s": 3}


@pytest.fixture(scope="module")
def harbours(spark):
    ships = sorted({ship for own in OWNED.values() for ship in own} | {40})
    vertices = [(i, "Harbour") for i in HARBOURS.values()] + [(ship, "Ship") for ship in ships]
    relationships = [(HARBOURS[h], ship, "OWNS") for h, own in OWNED.items() for ship in own] + [(a, b, "PASSES_TO") for a, b in PASSED]
    return (
        spark.createDataFrame(vertices, "id long, label string"),
        spark.createDataFrame(relationships, "src long, dst long, rel_type string"),
    )


def inside(harbour):
    """The partition of a harbour: all edges that its ships are the source of."""
    return [(a, b) for a, b in PASSED if a in OWNED[harbour]]


def test_next_and_position_span_slices(spark):
    n = 1000  # nearly all rows in one group
    df = spark.range(n).selectExpr("CASE WHEN id < 7 THEN 0 ELSE 1 END AS g", "(id * 37) % 1000 AS k")
    nexts = with_next(df, ["g"], ["k"], F.col("k"), "after").collect()
    for group in (0, 1):
        keys = sorted(r.k for r in nexts if r.g == group)
        assert {r.k: r.after for r in nexts if r.g == group} == dict(zip(keys, [*keys[1:], None]))
    assert rows(with_position(df.select("k"), ["k"], "at")) == [(i, i) for i in range(n)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_spread_equals_plain_join(spark, how):
    many = spark.range(60).selectExpr("CASE WHEN id < 40 THEN 1 ELSE id % 5 END AS k", "id")
    one = spark.createDataFrame([(1, "a"), (2, "b"), (7, "c")], "k long, name string")
    expected = rows(many.join(one, "k", how).select(*sorted(many.join(one, "k", how).columns)))
    spread = join_spread(many, one, ["k"], how, hot_rows=5)
    assert rows(spread.select(*sorted(spread.columns))) == expected


def test_graph_projections(spark):
    edges = edge_frame(spark, [(1, 2), (1, 2), (2, 2), (3, 1)])
    vertices = spark.createDataFrame([(1, "a"), (9, "z")], "id long, name string")
    g = graph.graph(vertices, edges, {"name": F.lit("new")})
    assert rows(g.vertices.select("id", "name")) == [(1, "a"), (2, "new"), (3, "new"), (9, "z")]
    attributes = graph.triplets(g).select("src", "dst", "src_attr.name", F.col("dst_attr.name").alias("other"))
    assert rows(attributes) == [(1, 2, "a", "new"), (1, 2, "a", "new"), (2, 2, "new", "new"), (3, 1, "new", "a")]
    removed = graph.remove_edges(g, edge_frame(spark, [(1, 2)]))
    assert rows(removed.edges) == [(2, 2), (3, 1)] and removed.vertices.count() == 4
    assert rows(graph.canonicalize(edges)) == [(1, 2), (1, 2), (1, 3), (2, 2)]
    assert rows(graph.simplify(edges)) == [(1, 2), (2, 2), (3, 1)]
    assert rows(graph.neighbors(edges, "both")) == [(1, [2, 3]), (2, [1, 2]), (3, [1])]
    assert rows(graph.count_graph(g)) == [(4, 4)]
    lists = graph.Graph(spark.createDataFrame([(1, [5, 6]), (2, [6, 7]), (3, [])], "id long, xs array<int>"), edges)
    assert rows(graph.merge_end_lists(lists, "xs", "ys").edges)[0] == (1, 2, [5, 6, 7])
    same = [rows(graph.random_vertex(g.vertices.select("id"), 3)) for _ in range(2)]
    assert same[0] == same[1] and len(same[0]) == 1


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_line_graph(spark, hot_rows):
    lines = graph.line_graph(edge_frame(spark, DAG), hot_rows=hot_rows)
    found = {((r.src.src, r.src.dst), (r.dst.src, r.dst.dst)) for r in lines.collect()}
    assert found == {((0, 1), (1, 2)), ((0, 1), (1, 4)), ((0, 4), (4, 3)), ((1, 2), (2, 3)), ((1, 4), (4, 3))}


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_propagate_max(spark, hot_rows):
    frame = grouped_frame(spark, ALL)
    value = F.when(F.col("id") % 3 == 0, -F.col("id")).otherwise(F.col("id") * 7 % 11)
    vertices = graph.vertices_from_edges(frame, {"x": value}, ["g"])
    result = as_map(pregel.propagate_max(graph.Graph(vertices, frame, ("g",)), "x", hot_rows))
    x = lambda v: -v if v % 3 == 0 else v * 7 % 11
    for name, edges in ALL.items():
        reach = brute.distances(edges)
        for v in brute.vertices(edges):
            assert result[name, v] == max(0, *[x(s) for (s, t) in reach if t == v], 0)


def test_pregel_messages_both_ways_and_limit(spark):
    edges = edge_frame(spark, [(0, 1), (1, 2), (2, 3)])
    g = graph.graph(None, edges, {"seen": F.when(F.col("id") == 2, 0)})
    hop = lambda end: pregel.src("seen") + 1 if end == "dst" else pregel.dst("seen") + 1
    arguments = dict(
        to_src=F.when(pregel.src("seen").isNull(), hop("src")), to_dst=F.when(pregel.dst("seen").isNull(), hop("dst")),
        combine=F.min(pregel.message()), update={"seen": pregel.message()},
    )
    assert as_map(pregel.pregel(g, **arguments)) == {0: 2, 1: 1, 2: 0, 3: 1}
    assert as_map(pregel.pregel(g, max_iter=1, **arguments)) == {0: None, 1: 1, 2: 0, 3: 1}
    assert rows(pregel.collect_successors(graph.graph(None, edges))) == [(0, [1]), (1, [2]), (2, [3]), (3, [])]


def test_text_forms(spark, tmp_path):
    (tmp_path / "edges.txt").write_text("# header\n\n3 1\n1\t2 extra\n")
    assert rows(text.read_edge_list(spark, str(tmp_path / "edges.txt"), canonical=True)) == [(1, 2), (1, 3)]
    (tmp_path / "bad.txt").write_text("1 2\n7\n")
    with pytest.raises(Exception, match="expected 2 fields: 7"):
        text.read_edge_list(spark, str(tmp_path / "bad.txt")).collect()
    result = spark.createDataFrame([(0, 0.001), (1, 0.002), (3, 0.003)], "id long, value double")
    folder = str(tmp_path / "updates")
    for _ in range(2):  # overwrites
        assert text.write_property_updates(result, folder) == 3
    assert rows(text.read_property_updates(spark, folder)) == [(0, 0.001), (1, 0.002), (3, 0.003)]
    assert text.write_property_updates(result.filter("id > 9"), folder) == 0
    (tmp_path / "recs.csv").write_text("# c\n1,5,1\n1,7,2\n")
    assert rows(text.read_recommendations(spark, str(tmp_path / "recs.csv"))) == [(1, 5, 1), (1, 7, 2)]
    (tmp_path / "ratings.csv").write_text("1,5,2.5\n2,7\n")
    ratings, bad = text.read_ratings(spark, str(tmp_path / "ratings.csv")), text.read_edge_list(spark, str(tmp_path / "bad.txt"))
    for pruned in (ratings, ratings.select("user"), bad.select("src")):
        with pytest.raises(Exception, match="expected . fields"):
            pruned.collect()
        with pytest.raises(Exception, match="expected . fields"):
            pruned.count()


def test_upserts(spark):
    vertices = spark.createDataFrame([(1, 5.0), (2, 6.0)], "id long, p double")
    result = spark.createDataFrame([(1, 9.0)], "id long, value double")
    assert rows(upserts.set_property(vertices, result, "p")) == [(1, 9.0), (2, 6.0)]
    assert rows(upserts.set_property(vertices, result, "q")) == [(1, 5.0, 9.0), (2, 6.0, None)]
    stray = spark.createDataFrame([(8, 1.0)], "id long, value double")
    with pytest.raises(Exception, match="no vertex with id 8"):
        upserts.set_property(vertices, stray, "p").collect()
    with pytest.raises(Exception, match="no vertex with id 8"):
        upserts.set_property(vertices, stray, "p").count()
    with pytest.raises(Exception, match="no vertex with id 8"):
        upserts.set_property(vertices, stray, "q").select("id").collect()
    twice = spark.createDataFrame([(1, 3.0), (1, 4.0)], "id long, value double")
    for unknown in ("raise", "ignore"):
        assert rows(upserts.set_property(vertices, twice, "p", unknown=unknown)) == [(1, 4.0), (2, 6.0)]
    assert rows(upserts.set_property(vertices, stray, "p", unknown="ignore")) == [(1, 5.0), (2, 6.0)]
    assert rows(upserts.unknown_ids(vertices, stray)) == [(8,)]
    hundred = spark.range(100).selectExpr("1000L AS partition_id", "id", "0.001D AS value")
    once = upserts.upsert_partition_relationships(spark.createDataFrame([], "partition_id long, id long, analysis string, value double"), hundred, "a")
    assert upserts.upsert_partition_relationships(once, hundred, "a").count() == 100
    again = hundred.unionByName(hundred.selectExpr("partition_id", "id", "0.002D AS value"))
    assert rows(upserts.upsert_partition_relationships(once, again, "a").groupBy("value").count()) == [(0.002, 100)]
    large = spark.createDataFrame([(1, 2, 2**53 + 1)], "partition_id long, id long, component long")
    longs = spark.createDataFrame([(1, 3, "a", 2**53 + 3)], "partition_id long, id long, analysis string, value long")
    assert rows(upserts.upsert_partition_relationships(longs, large, "a")) == [(1, 2, "a", 2**53 + 1), (1, 3, "a", 2**53 + 3)]
    with pytest.raises(ValueError, match="existing values are double"):
        upserts.upsert_partition_relationships(once, large, "a")
    old = spark.createDataFrame([(1, 50, 1), (1, 51, 2), (2, 50, 1)], "user long, item long, rank int")
    new = spark.createDataFrame([(1, 60, 1), (1, 61, 1), (1, 51, 2), (1, 70, 3)], "user long, item long, rank int")
    assert rows(upserts.upsert_recommendations(old, new)) == [(1, 51, 2), (1, 60, 1), (1, 70, 3), (2, 50, 1)]


def test_recommendations(spark):
    data = [(u, i, float(2 + (u * i) % 9)) for u in range(15) for i in range(15, 45) if (u * 7 + i * 3) % 5 < (4 if u else 5)]
    ratings = spark.createDataFrame(data, "user int, item int, rating double")
    seen = {(u, i) for u, i, _ in data}
    items = sorted({i for _, i in seen})
    # With the constants of a job all scores are 0.0 here, and the lowest unrated ids remain.
    lowest = {(u, i, rank) for u in range(15) for rank, i in enumerate([i for i in items if (u, i) not in seen][:4], 1)}
    assert {tuple(r) for r in recommend.recommend(ratings, n=4).collect()} == lowest
    model = recommend.train_implicit(ratings, reg=0.1, iterations=5)
    assert recommend.predict(model, ratings).count() == len(data)
    users, products = ({r.id: np.array(r.features, float) for r in f.collect()} for f in (model.userFactors, model.itemFactors))
    expected = set()
    for u, own in users.items():
        score = {i: float(np.float32(sum(float(x) for x in own * other))) for i, other in products.items() if (u, i) not in seen}
        expected |= {(u, i, rank) for rank, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:4], 1)}
    assert {tuple(r) for r in recommend.recommend(ratings, n=4, reg=0.1, iterations=5).collect()} == expected
    assert recommend.recommend(ratings.limit(0)).collect() == []
    ratings.createOrReplaceTempView("some_ratings")
    old = spark.createDataFrame([(99, 5, 1), (3, 44, 9)], "user int, item int, rank int")
    merged, error = jobs.recommendation_job(spark, "SELECT user, item, rating FROM some_ratings", old, n=4, reg=0.1, iterations=5)
    assert {tuple(r) for r in merged.collect()} == expected | {(99, 5, 1), (3, 44, 9)}
    shown = {(r.user, r.item): r.prediction for r in recommend.predict(model, ratings).collect()}
    assert error.first().mse == pytest.approx(np.mean([(rating - shown[u, i]) ** 2 for u, i, rating in data]))
    with pytest.raises(ValueError):
        rel.ratings_from_query(spark, "SELECT 1, 2")


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_best_unseen_items_are_exact(spark, block):
    """Ties, zero and negative factors, users who have seen all or nothing, unknown and repeated pairs, null factors."""
    random = np.random.default_rng(block)
    users = {u: random.integers(-3, 4, 3).astype(float).tolist() for u in range(40)} | {40: [0.0] * 3}
    items = {i: (random.integers(-2, 3, 3) * (1 + i % 4)).astype(float).tolist() for i in range(60)} | {60: [0.0] * 3}
    seen = {(u, i) for u in range(40) for i in range(61) if random.random() < 0.3} | {(7, i) for i in range(61)} | {(99, 1), (3, 999)}
    seen -= {(8, i) for i in range(61)}
    frames = [spark.createDataFrame(list(x.items()), f"{name} int, features array<double>") for name, x in (("user", users), ("item", items))]
    pairs = spark.createDataFrame([*seen, *seen, (None, 3), (3, None)], "user int, item int")
    found = [tuple(r) for r in recommend.best_unseen(*frames, pairs, 5, block).collect()]
    expected = set()
    for u, own in users.items():
        score = {i: sum(a * b for a, b in zip(own, other)) for i, other in items.items() if (u, i) not in seen}
        expected |= {(u, i, rank, score[i]) for rank, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:5], 1)}
    assert len(found) == len(expected) and set(found) == expected


def test_partitions_in_one_job_equal_single_runs(spark, harbours):
    vertices, relationships = harbours
    parts = rel.partition_edges(vertices, relationships, "Harbour", "OWNS", "PASSES_TO")
    assert rows(parts) == sorted((HARBOURS[h], a, b) for h in OWNED for a, b in inside(h))
    merged = jobs.analyze_partitions(vertices, relationships, "Harbour", "OWNS", "PASSES_TO", "betweenness_centrality")
    expected = {(HARBOURS[h], ship): value for h in OWNED for ship, value in brute.betweenness(inside(h)).items()}
    assert {(r.partition_id, r.id): r.value for r in merged.collect()} == pytest.approx(expected)


def test_jobs_by_key(spark, harbours):
    """Analyses by their keys on the edges of one type, beside plain definitions."""
    vertices, relationships = harbours
    passed = sorted(set(PASSED))
    expected = {
        "strongly_connected_components": brute.strong_components(passed),
        "betweenness_centrality": brute.betweenness(passed),
        "edge_betweenness": split_in_two(passed),
    }
    for name, values in expected.items():
        result = jobs.analyze(vertices, relationships, "PASSES_TO", name)
        found = {r.id: r[name] for r in result.collect()}
        assert found == pytest.approx({**dict.fromkeys(HARBOURS.values()), **values}), name
    with pytest.raises(ValueError):
        jobs.run_analysis("no_such_analysis", relationships)


def split_in_two(edges):
    removals = 0
    while True:
        steps, parts = brute.communities(edges, removals)
        if len(steps) < removals or len(set(parts.values())) >= 2:
            return parts
        removals += 1


def test_update_stream(spark, tmp_path):
    source, target, progress = (str(tmp_path / name) for name in ("in", "table", "progress"))
    updates.create_target(spark.createDataFrame([(1,), (2,), (3,)], "id long"), target)
    batches = [[(1, 1.0), (2, 2.0)], [(2, 5.0)], []]
    for number, batch in enumerate(batches):
        if batch:
            text.write_property_updates(spark.createDataFrame(batch, "id long, value double"), f"{source}/{number}")
        updates.apply_updates_stream(spark, f"{source}/*", target, progress, "score").awaitTermination()
    assert rows(updates.read_current(spark, target)) == [(1, 1.0), (2, 5.0), (3, None)]


def test_results_are_routed_by_path(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "log")
    start = {
        "vertices": spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.5)], "id long, rank double"),
        "relationships": spark.createDataFrame([(7, 1, "degree", 1.0), (7, 2, "degree", 1.0)], "partition_id long, id long, analysis string, value double"),
        "recommendations": spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "user int, item int, rank int"),
    }
    updates.create_log(target, **start)
    with pytest.raises(FileExistsError):
        updates.create_log(target, **start)

    def send(analysis, kind, *data):
        text.write_results(spark.createDataFrame(list(data), kind).coalesce(1), source, analysis)

    def state():
        return [rows(updates.read_table(spark, target, name)) for name in updates.TABLES]

    def run(**options):
        updates.import_results_stream(spark, source, target, **options).awaitTermination()
        return state()

    pairs, in_partitions = "id long, value double", "partition_id long, id long, value double"
    send("rank", pairs, (1, 2.0), (3, 4.0))
    send("degree", in_partitions, (7, 2, 5.0), (8, 2, 6.0))
    send("collaborative_filtering", "user long, item long, rank int", (1, 12, 2), (2, 10, 1))
    first = run()
    assert first == [
        [(1, 2.0), (2, 0.5), (3, 4.0)],
        [(7, 1, "degree", 1.0), (7, 2, "degree", 5.0), (8, 2, "degree", 6.0)],
        [(1, 10, 1), (1, 12, 2), (2, 10, 1)]]
    assert run() == first  # nothing new came in
    send("hops", pairs, (2, 9.0))
    send("rank", pairs, (1, 7.0), (1, 6.0))
    send("hops", in_partitions, (7, 2, 3.0))
    second = run(max_files=1, compact_after=2)
    assert second[0] == [(1, 7.0, None), (2, 0.5, 9.0), (3, 4.0, None)]
    assert updates.read_table(spark, target, "vertices").columns == ["id", "rank", "hops"]
    assert second[1] == sorted([*first[1], (7, 2, "hops", 3.0)]) and second[2] == first[2]
    updates.compact(spark, target)
    assert state() == second
    assert updates.read_table(spark, target, "recommendations").dtypes == start["recommendations"].dtypes
    updates.compact(spark, target)
    assert state() == second


def test_batch_that_comes_again(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "log")
    updates.create_log(target, spark.range(3))
    text.write_results(spark.createDataFrame([(1, 1.0)], "id long, value double"), source, "n")
    updates.import_results_stream(spark, source, target).awaitTermination()
    expected = [(0, None), (1, 1.0), (2, None)]
    lines = spark.createDataFrame([("1 1.0", 5, "f")], "value string, file_time long, file_path string")
    again = updates.partial(updates.by_parameters, "n", None)
    updates.append_changes(target, "raise", 9, again, lines, 0)
    assert rows(updates.read_current(spark, target)) == expected
    assert updates.compact(spark, target) == 1
    updates.append_changes(target, "raise", 9, again, lines, 0)  # its changes are in the base
    assert updates.current_version(spark, target) == 1
    assert rows(updates.read_current(spark, target)) == expected

    text.write_results(spark.createDataFrame([(5, 1.0)], "id long, value double"), source, "n")
    for _ in range(2):  # an unknown vertex fails its batch, and again at the next start
        with pytest.raises(Exception, match="no vertex with id 5"):
            updates.import_results_stream(spark, source, target).awaitTermination()
    assert rows(updates.read_current(spark, target)) == expected
    updates.import_results_stream(spark, source, target, unknown="ignore").awaitTermination()
    assert rows(updates.read_current(spark, target)) == expected
    spark.range(1).selectExpr("'1 2.0' AS value").write.text(f"{source}/elsewhere")
    with pytest.raises(Exception, match="no table for results in"):
        updates.import_results_stream(spark, source, target).awaitTermination()


def test_a_batch_writes_only_what_changed(spark, tmp_path):
    target = tmp_path / "log"
    updates.create_log(str(target), spark.range(200_000).selectExpr("id", "rand() AS score"))
    lines = spark.createDataFrame([("7 1.0", 5, "f")], "value string, file_time long, file_path string")
    updates.append_changes(str(target), "raise", 9, updates.partial(updates.by_parameters, "n", None), lines, 0)
    size = {kind: sum(f.stat().st_size for f in target.glob(f"{kind}=*/**/*.parquet")) for kind in ("base", "delta")}
    assert size["delta"] * 100 < size["base"]
    assert updates.read_current(spark, str(target)).filter("n = 1").count() == 1


def test_users_skip_leaves_that_hold_nothing_better(monkeypatch):
    """Every score as by the whole product; a user meets few of the leaves of a large block."""
    random = np.random.default_rng(3)
    factors = random.uniform(-1, 1, (20_000, 3))
    ids, own = random.permutation(20_000).astype(np.int32), random.uniform(-1, 1, (300, 3))
    hidden = [random.choice(ids, 40, replace=False) if u % 3 else None for u in range(300)]
    met, scores = [np.array([], np.int32)] * 300, [np.array([])] * 300
    frame = recommend.pd.DataFrame({"user": range(300), "features": list(own), "met": met, "scores": scores, "hidden": hidden})
    found = recommend.pd.concat(recommend._meet(5, False, ids, factors, None, iter([frame]))).sort_values("user")
    products = sum(own[:, k : k + 1] * factors[:, k] for k in range(3))
    for u, (names, values) in enumerate(zip(found["met"], found["scores"])):
        free = ~np.isin(ids, [] if hidden[u] is None else hidden[u])
        best = np.lexsort((ids[free], -products[u, free]))[:5]
        assert list(names) == list(ids[free][best]) and list(values) == list(products[u, free][best])
    assert {len(leaf) <= recommend.LEAF for leaf in recommend._leaves(factors)} == {True}
    assert sorted(np.concatenate(recommend._leaves(factors))) == list(range(20_000))


def test_training_blocks_grow_with_the_ratings(spark):
    """A task's share of the ratings stays the same; small trainings keep the blocks they had."""
    assert [recommend.training_blocks(n) for n in (0, 40_000_000, 216_000_000, 10**10)] == [10, 10, 54, 64]
    ratings = spark.createDataFrame([(u, i, 1.0 + (u * i) % 4) for u in range(6) for i in range(5)], "user int, item int, rating double")
    assert recommend.train_implicit(ratings, iterations=3).userFactors.count() == 6
