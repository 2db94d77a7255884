"""DuckDB SQL for the registered queries, over views of the same tables."""

from __future__ import annotations

CHAIN = """chain AS (
  SELECT partition_id, src, dst, rel_type FROM (
    SELECT c_nationkey::BIGINT * 2 AS partition_id, o_custkey * 2 + 1 AS src, o_orderpriority AS rel_type,
           lead(o_custkey * 2 + 1) OVER (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey) AS dst
    FROM orders JOIN customer ON o_custkey = c_custkey) WHERE dst IS NOT NULL)"""
VERTICES = """vtx AS (
  SELECT n_nationkey::BIGINT * 2 AS id, 'Nation' AS label, n_name AS name FROM nation
  UNION ALL SELECT c_custkey * 2 + 1, 'Customer', c_name FROM customer)"""
RELATIONSHIPS = """rels AS (
  SELECT src, dst, rel_type FROM chain
  UNION ALL SELECT c_nationkey::BIGINT * 2, c_custkey * 2 + 1, 'HAS_CUSTOMER' FROM customer)"""
BALANCES = "bal AS (SELECT c_custkey * 2 + 1 AS id, c_acctbal AS balance FROM customer)"
RATINGS = """rat AS (
  SELECT o_custkey::INTEGER AS "user", l_suppkey::INTEGER AS item, count(*)::DOUBLE AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


def graph(groups: list[str], source: str = "chain") -> tuple[str, str]:
    """Distinct edges ``e`` without self-loops and vertices ``v`` with the group columns packed into ``g``."""
    packed = f"({', '.join(groups)})" if groups else "0"
    if len(groups) > 1:
        packed = "struct_pack(" + ", ".join(f"{name} := {name}" for name in groups) + ")"
    elif groups:
        packed = groups[0]
    return (
        f"e AS MATERIALIZED (SELECT DISTINCT {packed} AS g, src, dst FROM {source} WHERE src <> dst)",
        f"v AS MATERIALIZED (SELECT {packed} AS g, src AS id FROM {source} UNION SELECT {packed}, dst FROM {source})",
    )


def ungroup(groups: list[str], alias: str = "g") -> str:
    if not groups:
        return ""
    if len(groups) == 1:
        return f"{alias} AS {groups[0]}, "
    return "".join(f"{alias}.{name} AS {name}, " for name in groups)


# Breadth-first: a pair that has a distance keeps it.
DISTANCES = """d(g, s, v, d) USING KEY (g, s, v) AS (
    SELECT g, id, id, 0 FROM v UNION
    SELECT d.g, d.s, e.dst, min(d.d) + 1 FROM d JOIN e ON e.g = d.g AND e.src = d.v
      LEFT JOIN recurring.d AS old ON old.g = d.g AND old.s = d.s AND old.v = e.dst WHERE old.g IS NULL GROUP BY d.g, d.s, e.dst)"""
# Distances of the few roots in root(g, id) only.
ROOT_DISTANCES = DISTANCES.replace("FROM v UNION", "FROM root UNION")
BACKWARD_ROOT_DISTANCES = ROOT_DISTANCES.replace("e.src", "e.near").replace("e.dst", "e.src").replace("e.near", "e.dst")
# Breadth-first levels with path counts; a new level excludes all pairs reached before, by the distances.
COUNTS = """sg(g, s, v, l, n) AS (
    SELECT g, id, id, 0, 1.0::DOUBLE FROM v UNION ALL
    SELECT sg.g, sg.s, e.dst, any_value(sg.l) + 1, sum(sg.n) FROM sg JOIN e ON e.g = sg.g AND e.src = sg.v
      JOIN d ON d.g = sg.g AND d.s = sg.s AND d.v = e.dst AND d.d = sg.l + 1 GROUP BY sg.g, sg.s, e.dst),
  bc AS MATERIALIZED (
    SELECT a.g, b.s AS id, sum(a.n * b.n / st.n) AS x FROM sg a
      JOIN sg b ON b.g = a.g AND b.s = a.v AND a.l > 0 AND b.l > 0
      JOIN sg st ON st.g = a.g AND st.s = a.s AND st.v = b.v AND st.l = a.l + b.l GROUP BY a.g, b.s)"""


def pagerank_rounds(source: str, groups: str, tol: float = 1e-4) -> str:
    """CTE r(it, g, id, rank, gain); a vertex passes on only a gain above ``tol``, and rounds end when none is."""
    return f"""pe AS MATERIALIZED (SELECT {groups} AS g, src, dst FROM {source}),
  w AS MATERIALIZED (
    SELECT g, src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY g, src) AS p, false AS own FROM pe
    UNION ALL (SELECT g, src, src, 0.0, true FROM pe UNION SELECT g, dst, dst, 0.0, true FROM pe)),
  r(it, g, id, rank, gain) AS (
    SELECT 0, g, src, 0.15::DOUBLE, 0.15::DOUBLE FROM w WHERE own UNION ALL
    SELECT any_value(r.it) + 1, r.g, w.dst,
           max(CASE WHEN own THEN rank END) + 0.85 * sum(CASE WHEN own OR gain <= {tol} THEN 0 ELSE gain * p END),
           0.85 * sum(CASE WHEN own OR gain <= {tol} THEN 0 ELSE gain * p END)
    FROM r JOIN w ON w.g = r.g AND w.src = r.id WHERE (SELECT max(gain) FROM r) > {tol} GROUP BY r.g, w.dst)"""
LAST = "(SELECT * FROM r WHERE it = (SELECT max(it) FROM r)) AS r"
MICROS = "floor(rank * 1e6 + 0.318309886)::DOUBLE AS pagerank_micros"


def reach(directed: bool) -> str:
    edges = "e" if directed else "(SELECT g, src, dst FROM e UNION SELECT g, dst, src FROM e)"
    return f"""reach(g, s, v) AS (
    SELECT g, id, id FROM v UNION SELECT reach.g, reach.s, x.dst FROM reach JOIN {edges} x ON x.g = reach.g AND x.src = reach.v)"""


def weak_components(groups: list[str]) -> str:
    return (
        with_(CHAIN, *graph(groups), reach(False))
        + f"SELECT {ungroup(groups)}v AS id, min(s) AS component FROM reach GROUP BY g, v"
    )


def strong_components(groups: list[str]) -> str:
    return (
        with_(CHAIN, *graph(groups), reach(True))
        + f"SELECT {ungroup(groups, 'a.g')}a.v AS id, min(a.s) AS component FROM reach a "
        "JOIN reach b ON a.g = b.g AND a.s = b.v AND a.v = b.s GROUP BY a.g, a.v"
    )


def triangle_counts(groups: list[str], source: str = "chain", value: str = "triangle_count") -> str:
    return f"""u AS MATERIALIZED (SELECT DISTINCT g, least(src, dst) AS a, greatest(src, dst) AS b FROM e),
  t AS (SELECT x.g, x.a, x.b, y.b AS c FROM u x JOIN u y ON y.g = x.g AND y.a = x.b JOIN u z ON z.g = x.g AND z.a = x.a AND z.b = y.b),
  corner AS (SELECT g, unnest([a, b, c]) AS id FROM t)
  SELECT {ungroup(groups, 'v.g')}v.id, count(corner.id) AS {value} FROM v LEFT JOIN corner ON corner.g = v.g AND corner.id = v.id
  GROUP BY v.g, v.id"""


BOTH = ["partition_id", "rel_type"]
NATION = ["partition_id"]
FIRST = "root AS MATERIALIZED (SELECT g, min(id) AS id FROM v GROUP BY g)"
# Betweenness of edges as vertices of the line graph, by shortest paths of the graph itself: a pair of vertices (s, t)
# stands for indegree(s) * outdegree(t) pairs of edges, less the edge (t, s), which is no pair.
EDGE_SCORES = with_(CHAIN, *graph(BOTH), DISTANCES, COUNTS.split(",\n  bc AS")[0], f"""es AS MATERIALIZED (
    SELECT DISTINCT {{'partition_id': partition_id, 'rel_type': rel_type}} AS g, src, dst FROM chain),
  ins AS MATERIALIZED (SELECT g, dst AS id, count(*) AS n FROM es GROUP BY ALL),
  outs AS MATERIALIZED (SELECT g, src AS id, count(*) AS n FROM es GROUP BY ALL),
  weight AS MATERIALIZED (
    SELECT sg.g, sg.s, sg.v, sg.l, sg.n, ins.n * outs.n - (es.g IS NOT NULL)::INTEGER AS w FROM sg
      JOIN ins ON ins.g = sg.g AND ins.id = sg.s JOIN outs ON outs.g = sg.g AND outs.id = sg.v
      LEFT JOIN es ON es.g = sg.g AND es.src = sg.v AND es.dst = sg.s WHERE sg.l > 0),
  ec AS MATERIALIZED (
    SELECT a.g, e.src, e.dst, sum(a.n * b.n / st.n * st.w) AS x FROM sg a JOIN e ON e.g = a.g AND e.src = a.v
      JOIN sg b ON b.g = a.g AND b.s = e.dst JOIN weight st ON st.g = a.g AND st.s = a.s AND st.v = b.v AND st.l = a.l + 1 + b.l
    GROUP BY ALL),
  scored AS MATERIALIZED (
    SELECT es.g, es.src, es.dst, round(coalesce(x, 0), 6) AS score FROM es LEFT JOIN ec ON ec.g = es.g AND ec.src = es.src AND ec.dst = es.dst
    WHERE EXISTS (SELECT 1 FROM es f WHERE f.g = es.g AND f.src = es.dst) OR EXISTS (SELECT 1 FROM es f WHERE f.g = es.g AND f.dst = es.src))""")
# Shortest paths grow from their source along increasing distance; path ends at v.
PATHS = """p(g, s, v, l, path) AS (
    SELECT g, s, v, 0, [v] FROM d WHERE d = 0 UNION ALL
    SELECT p.g, p.s, e.dst, p.l + 1, list_append(p.path, e.dst) FROM p JOIN e ON e.g = p.g AND e.src = p.v
      JOIN d ON d.g = p.g AND d.s = p.s AND d.v = e.dst AND d.d = p.l + 1)"""
# ... or from their target backwards.
PATHS_BACK = """p(g, s, v, l, path) AS (
    SELECT g, s, v, 0, [v] FROM d WHERE d = 0 UNION ALL
    SELECT p.g, p.s, e.src, p.l + 1, list_prepend(e.src, p.path) FROM p JOIN e ON e.g = p.g AND e.dst = p.v
      JOIN d ON d.g = p.g AND d.s = p.s AND d.v = e.src AND d.d = p.l + 1)"""


def ranked(score: str, n: int) -> str:
    return (
        f'SELECT "user", item, rank FROM (SELECT "user", item, row_number() OVER '
        f'(PARTITION BY "user" ORDER BY {score} DESC, item)::INTEGER AS rank FROM rat) WHERE rank <= {n}'
    )


def order_counts(condition: str = "true") -> str:
    return f"SELECT o_custkey * 2 + 1 AS id, count(*)::DOUBLE AS value FROM orders WHERE {condition} GROUP BY 1"


ORACLES: dict[str, str] = {
    "read_edge_list": with_(CHAIN) + "SELECT src, dst FROM chain",
    "read_edge_list_canonical": with_(CHAIN) + "SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM chain",
    "read_property_updates": order_counts(),
    "write_property_updates": f"SELECT count(*) AS written, count(*) AS read, sum(value) AS total FROM ({order_counts()})",
    "read_ratings": with_(RATINGS) + "SELECT * FROM rat",
    "read_recommendations": with_(RATINGS)
    + f'SELECT "user"::BIGINT AS "user", item::BIGINT AS item, rank FROM ({ranked("rating", 10)})',
    "vertex_scan": with_(VERTICES) + "SELECT * FROM vtx",
    "vertex_scan_by_label": with_(VERTICES) + "SELECT * FROM vtx WHERE label = 'Customer'",
    "edges_of_type": with_(CHAIN) + "SELECT src, dst FROM chain WHERE rel_type = '1-URGENT'",
    "edges_of_type_distinct": with_(CHAIN)
    + "SELECT DISTINCT src, dst FROM chain WHERE rel_type = '1-URGENT' AND src <> dst",
    "partition_edges": with_(CHAIN) + "SELECT partition_id, src, dst FROM chain WHERE rel_type = '2-HIGH'",
    "ratings_from_query": 'SELECT o_custkey::INTEGER AS "user", l_suppkey::INTEGER AS item, sum(l_quantity)::DOUBLE AS rating '
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "set_property": with_(VERTICES, BALANCES)
    + f"SELECT vtx.id, label, name, coalesce(value, balance) AS balance FROM vtx LEFT JOIN bal ON vtx.id = bal.id "
    f"""LEFT JOIN ({order_counts("o_orderstatus = 'F'")}) n ON vtx.id = n.id""",
    "unknown_ids": with_(VERTICES)
    + f"SELECT id + 2 AS id FROM ({order_counts()}) WHERE id + 2 NOT IN (SELECT id FROM vtx)",
    "upsert_partition_relationships": with_(
        CHAIN,
        "new AS (SELECT partition_id, src AS id, 'degree' AS analysis, count(*)::BIGINT AS value FROM chain GROUP BY 1, 2)",
        "old AS (SELECT partition_id, dst AS id, CASE WHEN dst % 4 = 1 THEN 'degree' ELSE 'other' END AS analysis, "
        "min(src) AS value FROM chain GROUP BY 1, 2)",
    )
    + "SELECT partition_id, id, analysis, coalesce(new.value, old.value) AS value "
    "FROM old FULL JOIN new USING (partition_id, id, analysis)",
    "upsert_recommendations": with_(RATINGS, f"old AS ({ranked('-rating', 12)})", f"new AS ({ranked('rating', 10)})")
    + 'SELECT "user", coalesce(new.item, old.item) AS item, rank FROM old FULL JOIN new USING ("user", rank)',
    "vertices_from_edges": with_(CHAIN, *graph([])) + "SELECT id, 1 AS score FROM v",
    "build_graph": with_(CHAIN, VERTICES, RELATIONSHIPS)
    + "SELECT id, coalesce(label, 'unknown') AS label, coalesce(name, '') AS name FROM "
    "(SELECT src AS id FROM rels UNION SELECT dst FROM rels) FULL JOIN (SELECT * FROM vtx WHERE label = 'Nation') USING (id)",
    "map_vertices": with_(BALANCES) + "SELECT id, round(balance * 2 + id, 6) AS balance FROM bal",
    "map_edges": with_(CHAIN) + "SELECT src, dst, upper(rel_type) AS rel_type, dst - src AS gap FROM chain",
    "triplets": with_(CHAIN, BALANCES)
    + "SELECT src, dst, rel_type, a.balance AS src_balance, b.balance AS dst_balance "
    "FROM chain JOIN bal a ON src = a.id JOIN bal b ON dst = b.id",
    "map_triplets": with_(CHAIN, BALANCES)
    + "SELECT src, dst, rel_type, round(a.balance - b.balance, 6) AS difference "
    "FROM chain JOIN bal a ON src = a.id JOIN bal b ON dst = b.id",
    "merge_end_lists": with_(
        CHAIN, "ends AS MATERIALIZED (SELECT src AS id, rel_type FROM chain UNION SELECT dst, rel_type FROM chain)"
    )
    + "SELECT c.src, c.dst, string_agg(DISTINCT ends.rel_type, ',' ORDER BY ends.rel_type) AS types "
    "FROM (SELECT DISTINCT src, dst FROM chain) c JOIN ends ON ends.id = c.src OR ends.id = c.dst GROUP BY 1, 2",
    "remove_edges": with_(CHAIN)
    + "SELECT src, dst, rel_type FROM chain c WHERE NOT EXISTS "
    "(SELECT 1 FROM chain x WHERE x.rel_type = '5-LOW' AND x.src = c.src AND x.dst = c.dst)",
    "canonicalize": with_(CHAIN) + "SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM chain",
    "simplify": with_(CHAIN) + "SELECT DISTINCT src, dst FROM chain",
    "line_graph": with_(CHAIN, "s AS MATERIALIZED (SELECT DISTINCT src, dst FROM chain)")
    + "SELECT a.src, a.dst AS via, b.dst FROM s a JOIN s b ON a.dst = b.src",
    "index_vertices": with_(VERTICES) + 'SELECT id, row_number() OVER (ORDER BY id) - 1 AS "index" FROM vtx',
    "random_vertex": with_(VERTICES) + "SELECT id FROM vtx ORDER BY md5('7:' || id), id LIMIT 1",
    "count_graph": with_(CHAIN, *graph(["rel_type"]))
    + "SELECT v.g AS rel_type, count(*) AS vertices, any_value(n) AS edges FROM v "
    "JOIN (SELECT rel_type, count(*) AS n FROM chain GROUP BY 1) c ON c.rel_type = v.g GROUP BY v.g",
    "pregel_hops": with_(CHAIN, *graph(NATION), FIRST, ROOT_DISTANCES)
    + "SELECT v.g AS partition_id, v.id, d.d::INTEGER AS hops FROM v LEFT JOIN d ON d.g = v.g AND d.v = v.id",
    "aggregate_messages": with_(CHAIN, BALANCES)
    + "SELECT dst AS id, round(sum(balance), 6) AS message FROM chain JOIN bal ON bal.id = src GROUP BY 1",
    "propagate_max": with_(CHAIN, BALANCES, *graph(["rel_type"]), reach(True))
    + "SELECT g AS rel_type, v AS id, greatest(0, max(floor(balance)))::BIGINT AS balance "
    "FROM reach JOIN bal ON bal.id = reach.s GROUP BY g, v",
    "collect_successors": with_(CHAIN)
    + "SELECT v.id, coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst), '') AS successors "
    "FROM (SELECT src AS id FROM chain UNION SELECT dst FROM chain) v "
    "LEFT JOIN (SELECT DISTINCT src, dst FROM chain) c ON c.src = v.id GROUP BY 1",
    "pagerank_to_tolerance": with_(CHAIN, pagerank_rounds("chain", "0")) + f"SELECT id, {MICROS} FROM {LAST}",
    "pagerank_by_type": with_(CHAIN, pagerank_rounds("chain", "rel_type")) + f"SELECT g AS rel_type, id, {MICROS} FROM {LAST}",
    "connected_components": weak_components([]),
    "connected_components_by_type": weak_components(["rel_type"]),
    "strongly_connected_components": strong_components([]),
    "strongly_connected_components_by_type": strong_components(["rel_type"]),
    "triangle_count": with_(CHAIN, *graph([])) .rstrip() + ", " + triangle_counts([]),
    "triangle_count_by_type": with_(CHAIN, *graph(["rel_type"])).rstrip() + ", " + triangle_counts(["rel_type"]),
    "shortest_path_lengths": with_(CHAIN, *graph(NATION), DISTANCES)
    + "SELECT g AS partition_id, s AS src, v AS dst, d::INTEGER AS distance FROM d",
    "shortest_path_lengths_to_landmarks": with_(CHAIN, *graph(BOTH), FIRST, BACKWARD_ROOT_DISTANCES)
    + f"SELECT {ungroup(BOTH)}v AS src, s AS dst, d::INTEGER AS distance FROM d",
    "closeness_centrality": with_(CHAIN, *graph(NATION), DISTANCES)
    + "SELECT g AS partition_id, s AS id, round(CASE WHEN sum(d) > 0 THEN count(*) / sum(d) ELSE 0.0 END, 6) AS closeness "
    "FROM d GROUP BY g, s",
    "betweenness_centrality": with_(CHAIN, *graph(NATION), DISTANCES, COUNTS)
    + "SELECT v.g AS partition_id, v.id, round(coalesce(x, 0), 6) AS betweenness FROM v LEFT JOIN bc ON bc.g = v.g AND bc.id = v.id",
    "edge_centrality": EDGE_SCORES + f"SELECT {ungroup(BOTH)}src, dst, score FROM scored",
    "top_edge": EDGE_SCORES
    + f"SELECT {ungroup(BOTH)}src, dst, score FROM scored QUALIFY row_number() OVER (PARTITION BY g ORDER BY score DESC, src, dst) = 1",
    "all_shortest_paths": with_(CHAIN, *graph(BOTH), DISTANCES, PATHS)
    + f"SELECT {ungroup(BOTH)}s AS src, v AS dst, l::INTEGER AS distance, array_to_string(path, ',') AS path FROM p WHERE l > 0",
    "shortest_paths_to": with_(CHAIN, *graph(NATION), FIRST, BACKWARD_ROOT_DISTANCES, PATHS_BACK)
    + "SELECT g AS partition_id, v AS src, s AS dst, l::INTEGER AS distance, array_to_string(path, ',') AS path FROM p WHERE l > 0",
    "shortest_path": with_(CHAIN, *graph(BOTH), FIRST, ROOT_DISTANCES, PATHS)
    + f"SELECT {ungroup(BOTH, 'p.g')}p.s AS src, p.v AS dst, any_value(l)::INTEGER AS distance, "
    "array_to_string(min(path), ',') AS path "
    "FROM p JOIN (SELECT g, max(id) AS id FROM v GROUP BY g) t ON t.g = p.g AND t.id = p.v WHERE l > 0 GROUP BY p.g, p.s, p.v",
    "reachable": with_(CHAIN, *graph(BOTH), FIRST, reach(True).replace("FROM v UNION", "FROM root UNION"))
    + f"SELECT {ungroup(BOTH)}s AS src, v AS dst FROM reach",
    "distinct_users": 'SELECT DISTINCT o_custkey::INTEGER AS "user" FROM orders JOIN lineitem ON l_orderkey = o_orderkey',
    "distinct_items": "SELECT DISTINCT l_suppkey::INTEGER AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    "unseen": 'SELECT o_custkey AS "user", l_suppkey AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey '
    "GROUP BY 1, 2 HAVING NOT bool_or(l_returnflag = 'R')",
    "unseen_counts": with_(RATINGS)
    + 'SELECT "user", (SELECT count(DISTINCT item) FROM rat) - count(*) AS unseen FROM rat GROUP BY "user"',
    "rating_mse": with_(RATINGS)
    + "SELECT round(avg((rating - m) ** 2), 6) AS mse FROM rat JOIN (SELECT item, avg(rating) AS m FROM rat GROUP BY 1) USING (item)",
    "best_unseen": with_(RATINGS, """scored AS (
    SELECT c_custkey::INTEGER AS "user", s_suppkey::INTEGER AS item,
           floor(c_acctbal / 100) * floor(s_acctbal / 100) + (c_nationkey % 5) * (s_nationkey % 5)
           + (c_nationkey % 3 - 1) * 50.0 * (s_nationkey % 3 - 1) * 50.0 AS score
    FROM customer, supplier WHERE (c_custkey, s_suppkey) NOT IN (SELECT "user", item FROM rat))""")
    + """SELECT "user", item, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item)::INTEGER AS rank, score::DOUBLE AS score
    FROM scored QUALIFY rank <= 10""",
    "recommendation_ranks": with_(RATINGS)
    + 'SELECT "user", least(10, unseen) AS ranks, least(10, unseen) AS last_rank FROM '
    '(SELECT "user", (SELECT count(DISTINCT item) FROM rat) - count(*) AS unseen FROM rat GROUP BY "user") WHERE unseen > 0',
    "rank_candidates": with_(RATINGS) + ranked("rating", 5),
    "run_analysis": with_(CHAIN, "typed AS (SELECT src, dst FROM chain WHERE rel_type = '2-HIGH')", *graph([], "typed")).rstrip()
    + ", "
    + triangle_counts([]),
    "analyze": with_(
        CHAIN, VERTICES, "typed AS (SELECT src, dst FROM chain WHERE rel_type = '1-URGENT')",
        pagerank_rounds("typed", "0"),
    )
    + f"SELECT vtx.id, label, name, {MICROS} FROM vtx LEFT JOIN {LAST} ON r.id = vtx.id",
    "analyze_partitions": with_(
        CHAIN, BALANCES, "typed AS (SELECT partition_id, src, dst FROM chain WHERE rel_type = '3-MEDIUM')",
        *graph(NATION, "typed"), DISTANCES,
        "owned AS (SELECT c_nationkey::BIGINT * 2 AS g, c_custkey * 2 + 1 AS id, c_acctbal AS balance FROM customer)",
        "close AS (SELECT g, s AS id, CASE WHEN sum(d) > 0 THEN count(*) / sum(d) ELSE 0.0 END AS c FROM d GROUP BY g, s)",
    )
    + "SELECT g AS partition_id, id, 'closeness_centrality' AS analysis, round(coalesce(c, balance), 6) AS value "
    "FROM owned FULL JOIN close USING (g, id)",
    "analyze_components": with_(
        CHAIN, VERTICES, "typed AS (SELECT src, dst FROM chain WHERE rel_type = '1-URGENT')", *graph([], "typed"), reach(False)
    )
    + "SELECT vtx.id, label, name, coalesce(c.component, -1) AS connected_components FROM vtx "
    "LEFT JOIN (SELECT v AS id, min(s) AS component FROM reach GROUP BY v) c ON c.id = vtx.id",
    "analyze_partitions_components": with_(
        CHAIN, "typed AS (SELECT partition_id, src, dst FROM chain WHERE rel_type = '3-MEDIUM')", *graph(NATION, "typed"), reach(False)
    )
    + "SELECT g AS partition_id, v AS id, 'connected_components' AS analysis, min(s) AS value FROM reach GROUP BY g, v",
    "apply_updates_stream": with_(VERTICES)
    + f"SELECT vtx.id, label, name, coalesce(f.value, n.value) AS orders FROM vtx LEFT JOIN ({order_counts()}) n ON n.id = vtx.id "
    f"""LEFT JOIN ({order_counts("o_orderstatus = 'F'")}) f ON f.id = vtx.id""",
    "import_results_partitions": f"""WITH homes AS (SELECT c_custkey * 2 + 1 AS id, c_nationkey::BIGINT * 2 AS partition_id FROM customer)
SELECT partition_id, id, 'balance' AS analysis, 0.0::DOUBLE AS value FROM homes
UNION ALL SELECT partition_id, id, 'orders', coalesce(f.value, n.value)
FROM ({order_counts()}) n JOIN homes USING (id) LEFT JOIN ({order_counts("o_orderstatus = 'F'")}) f USING (id)""",
}
ORACLES["import_results_vertices"] = ORACLES["apply_updates_stream"]
ORACLES["import_results_recommendations"] = ORACLES["upsert_recommendations"]
for _direction, _pairs in {
    "out": "SELECT src AS id, dst AS other FROM chain",
    "in": "SELECT dst AS id, src AS other FROM chain",
    "both": "SELECT src AS id, dst AS other FROM chain UNION ALL SELECT dst, src FROM chain",
}.items():
    ORACLES[f"neighbors_{_direction}"] = with_(CHAIN) + (
        "SELECT id, string_agg(other::VARCHAR, ',' ORDER BY other) AS neighbors "
        f"FROM (SELECT DISTINCT * FROM ({_pairs})) GROUP BY id"
    )
