"""Level-by-level traversal: distances, closeness, reachability and shortest paths.

All of these ignore parallel edges and self-loops and count hops along directed edges. Searches from all vertices hold
graphs whole in the tasks where they fit (``functions.packs``) and join level by level where they don't, or where one of
the limits of the joins, ``hot_rows`` or ``max_pairs``, is given.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.ordering import with_position
from vertexloom.functions.packs import packed, search_packs
from vertexloom.functions.rounds import checkpointed, measure, row_count, settle, union_all
from vertexloom.functions.skew import join_spread
from vertexloom.operators import searches
from vertexloom.operators.adjacency import Adjacency
from vertexloom.operators.graph import simplify, vertices_from_edges

MAX_PAIRS = 2_000_000_000  # (root, vertex) rows that one batch of roots may reach, which bounds the state on disk
HUB_EDGES = 10_000  # hubs are split finer than in other loops: each of their edges meets as many rows as there are roots
EDGE_BITS = 1e10  # edges times roots that a task searches with bits
ROWS = 2e8  # pairs of vertices that a task lists
PATH_EDGES = 1e8  # edges times roots that a task lists paths for


def simple_edges(edges: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    return simplify(edges.filter(F.col("src") != F.col("dst")), group_cols)


def all_vertices(edges: DataFrame, vertices: DataFrame | None, groups: list[str]) -> DataFrame:
    ends = vertices_from_edges(edges, group_cols=groups)
    return ends if vertices is None else ends.unionByName(vertices.select(*groups, "id")).distinct()


def root_batches(
    roots: DataFrame, vertices: DataFrame, groups: list[str], max_pairs: int | None
) -> Iterator[DataFrame]:
    """Split ``roots`` by a hash of their id so that roots x vertices of their group stays below ``max_pairs``."""
    many = roots.select(*groups, F.lit(1).alias("r"), F.lit(0).alias("v"))
    sizes = many.unionByName(vertices.select(*groups, F.lit(0).alias("r"), F.lit(1).alias("v")))
    sizes = sizes.groupBy(*groups).agg(F.sum("r").alias("r"), F.sum("v").alias("v"))
    pairs = measure(sizes, pairs=F.sum(F.col("r").cast("double") * F.col("v")))["pairs"] or 0
    batches = int(pairs // (max_pairs or MAX_PAIRS)) + 1
    if batches == 1:
        yield roots
        return
    for batch in range(batches):
        yield roots.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == batch)


BLOCK = 64  # roots that share a row: one bit of a long each
KEPT_LEVELS = 32  # frames of levels that are kept apart; more are put together, so that plans stay small


def in_blocks(roots: DataFrame, groups: list[str]) -> DataFrame:
    """``(groups, id, block, bit)``: roots numbered in order, 64 to a block."""
    placed = with_position(roots.select(*groups, "id"), [*groups, "id"], "_place")
    block, bit = F.floor(F.col("_place") / BLOCK).alias("block"), (F.col("_place") % BLOCK).cast("int").alias("bit")
    return checkpointed(placed.select(*groups, "id", block, bit))


def sweep(adjacency: Adjacency, blocks: DataFrame, group_cols: Sequence[str] = (), tally: bool = False) -> Iterator[DataFrame]:
    """Breadth-first search from all roots at once, 64 of them in a row.

    Frame h that comes out holds ``(groups, id, block, seen, bits)`` for every vertex and block met so far: in ``seen``
    the roots of the block at up to h hops from ``id``, in ``bits`` those at exactly h. With ``tally`` there are also the
    number ``n`` of roots and the sum ``total`` of their distances. A round joins the rows with new bits with the resting
    edges, ors them per vertex and block before the shuffle and takes out what was seen. The last frame has new bits.
    """
    keys = [*group_cols, "id", "block"]
    first = blocks.groupBy(*keys).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    state = first.select(*keys, F.col("bits").alias("seen"), "bits")
    if tally:
        state = state.withColumns({"n": F.bit_count("bits").cast("long"), "total": F.lit(0).cast("long")})
    state, found = settle(state, new=F.count_if(F.col("bits") != 0))
    hops = 0
    while found["new"]:
        yield state
        hops += 1
        frontier = state.filter(F.col("bits") != 0).select(*keys, "bits")
        reached = adjacency.attach(frontier).withColumnRenamed(adjacency.far, "id").groupBy(*keys).agg(F.bit_or("bits").alias("bits"))
        merged = state.drop("bits").join(reached, keys, "full_outer")
        seen = F.coalesce("seen", F.lit(0).cast("long"))
        merged = merged.withColumn("bits", F.coalesce("bits", F.lit(0).cast("long")).bitwiseAND(F.bitwise_not(seen)))
        columns = [*keys, seen.bitwiseOR(F.col("bits")).alias("seen"), "bits"]
        if tally:
            fresh, none = F.bit_count("bits").cast("long"), F.lit(0).cast("long")
            columns += [(F.coalesce("n", none) + fresh).alias("n"), (F.coalesce("total", none) + hops * fresh).alias("total")]
        state, found = settle(merged.select(*columns), new=F.count_if(F.col("bits") != 0))


def new_bits(frame: DataFrame) -> DataFrame:
    """The rows of a frame of ``sweep`` that have roots at exactly its number of hops."""
    return frame.filter(F.col("bits") != 0).drop("seen")


def with_roots(rows: DataFrame, blocks: DataFrame, bits: str) -> DataFrame:
    """One row per vertex and root from one row per vertex and block; ``root`` takes the place of ``block`` and ``bits``."""
    listed = blocks.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bit", "id"))).alias("_roots"))
    here = F.filter("_roots", lambda root: F.getbit(bits, root.bit) == 1)
    kept = [name for name in rows.columns if name not in ("block", "bits", "seen")]
    pairs = rows.join(listed, "block").select(*kept, F.explode(here).alias("_root"))
    return pairs.select(*kept, F.col("_root.id").alias("root"))


def shortest_path_lengths(
    edges: DataFrame,
    landmarks: DataFrame | None = None,
    vertices: DataFrame | None = None,
    group_cols: Sequence[str] = (),
    max_pairs: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """``(src, dst, distance int)``: hops from each vertex ``src`` to each landmark ``dst`` it can reach.

    ``landmarks`` is a frame with ``id`` (and ``group_cols``); by default all vertices. A vertex is at distance 0 from
    itself; unreachable pairs are absent. Landmarks are handled in batches of at most ``max_pairs`` pairs, 64 to a row; one
    row per pair comes up only in the result. Without landmarks the rows come straight from the tasks that hold the graphs:
    no pair is written before the result is.
    """
    groups = list(group_cols)
    simple = checkpointed(simple_edges(edges, groups))
    everyone = checkpointed(all_vertices(edges, vertices, groups))
    if landmarks is not None:
        return _lengths_by_joins(simple, landmarks.select(*groups, "id").distinct(), everyone, groups, max_pairs, hot_rows)
    if max_pairs or hot_rows:
        return _lengths_by_joins(simple, everyone, everyone, groups, max_pairs, hot_rows)
    packs, rest = packed(simple, groups)
    parts = [everyone.select(*groups, F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("distance"))]
    if packs is not None:
        schema = ", ".join(f"`{name}` {kind}" for name, kind in parts[0].dtypes)
        parts.append(search_packs(packs, searches.distances, schema, ROWS, by_vertices=True))
    if rest is not None:
        ends = checkpointed(vertices_from_edges(rest, group_cols=groups))
        parts.append(_lengths_by_joins(rest, ends, ends, groups, None, None).filter(F.col("distance") > 0))
    return union_all(parts)


def _lengths_by_joins(
    simple: DataFrame, roots: DataFrame, everyone: DataFrame, groups: list[str], max_pairs: int | None, hot_rows: int | None
) -> DataFrame:
    adjacency = Adjacency(simple, "dst", groups, hot_rows or HUB_EDGES)
    parts = []
    try:
        for batch in root_batches(roots, everyone, groups, max_pairs):
            blocks = in_blocks(batch, groups)
            levels: list[DataFrame] = []
            for hops, frame in enumerate(sweep(adjacency, blocks, groups)):
                levels.append(new_bits(frame).withColumn("hops", F.lit(hops)))
                if len(levels) > KEPT_LEVELS:
                    levels = [checkpointed(union_all(levels))]
            if levels:
                pairs = with_roots(union_all(levels), blocks, "bits")
                parts.append(pairs.select(*groups, F.col("id").alias("src"), F.col("root").alias("dst"), F.col("hops").alias("distance")))
    finally:
        adjacency.release()
    if not parts:
        nobody = everyone.select(*groups, F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("distance"))
        return nobody.filter(F.lit(False))
    return union_all(parts)


def closeness_centrality(
    edges: DataFrame,
    vertices: DataFrame | None = None,
    group_cols: Sequence[str] = (),
    max_pairs: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """``(id, closeness double)``: number of vertices that ``id`` reaches over the sum of their distances.

    ``id`` itself counts as reached (at distance 0), so this is the reciprocal of a mean over R(id) that includes the
    zero. A vertex that reaches only itself has 0.0. Every end point is listed, and every row of ``vertices`` if given.
    The search goes back from the reached vertices, so what a vertex reaches is counted where it is; by joins, one row per
    vertex and 64 reached ones.
    """
    groups = list(group_cols)
    simple = checkpointed(simple_edges(edges, groups))
    everyone = checkpointed(all_vertices(edges, vertices, groups))
    none = F.lit(0).cast("long")
    parts = [everyone.withColumns({"n": none, "total": none})]
    packs, rest = packed(simple, groups, 0 if max_pairs or hot_rows else None)
    if packs is not None:
        schema = ", ".join(f"`{name}` {kind}" for name, kind in parts[0].dtypes)
        sums = search_packs(packs, searches.closeness_sums, schema, EDGE_BITS).groupBy(*groups, "id")
        parts.append(checkpointed(sums.agg((F.sum("n") + 1).alias("n"), F.sum("total").alias("total"))))
    if rest is not None:
        ends = everyone if packs is None else checkpointed(vertices_from_edges(rest, group_cols=groups))
        adjacency = Adjacency(rest, "dst", groups, hot_rows or HUB_EDGES)
        try:
            for batch in root_batches(ends, ends, groups, max_pairs):
                last = None
                for last in sweep(adjacency, in_blocks(batch, groups), groups, tally=True):
                    pass
                if last is not None:
                    sums = last.groupBy(*groups, "id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
                    parts.append(checkpointed(sums))
        finally:
            adjacency.release()
    sums = union_all(parts).groupBy(*groups, "id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    value = F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(F.lit(0.0))
    return sums.select(*groups, "id", value.alias("closeness"))


def reachable(
    edges: DataFrame,
    sources: DataFrame,
    targets: DataFrame | None = None,
    group_cols: Sequence[str] = (),
    hot_rows: int | None = None,
) -> DataFrame:
    """``(src, dst)`` for every source and every vertex it reaches along directed edges, itself included.

    With ``targets`` (a frame with ``id``) only those destinations are listed: an empty result means "no path".
    """
    groups = list(group_cols)
    simple = checkpointed(simple_edges(edges, groups))
    blocks = in_blocks(sources.select(*groups, "id").distinct(), groups)
    adjacency = Adjacency(simple, "src", groups, hot_rows or HUB_EDGES)
    last = blocks.withColumn("seen", F.lit(0).cast("long"))
    try:
        for last in sweep(adjacency, blocks, groups):
            pass
    finally:
        adjacency.release()
    found = last.select(*groups, "id", "block", "seen")
    if targets is not None:
        found = found.join(targets.select(*groups, "id").distinct(), [*groups, "id"], "left_semi")
    pairs = with_roots(found, blocks, "seen")
    return pairs.select(*groups, F.col("root").alias("src"), F.col("id").alias("dst"))


def _extend_paths(
    edges: DataFrame,
    sources: DataFrame | None,
    targets: DataFrame | None,
    groups: list[str],
    hot_rows: int | None,
) -> DataFrame:
    """Grow paths from their sources, one hop a round, along edges that come one hop nearer to the target."""
    simple = checkpointed(simple_edges(edges, groups))
    to_target = shortest_path_lengths(simple, targets, group_cols=groups, hot_rows=hot_rows or HUB_EDGES)
    starts = to_target.filter(F.col("distance") > 0)
    if sources is not None:
        wanted = sources.select(*groups, F.col("id").alias("src")).distinct()
        starts = starts.join(wanted, [*groups, "src"], "left_semi")

    head = [*groups, "from", "to", "distance"]
    open_paths = checkpointed(
        starts.select(
            *groups, F.col("src").alias("from"), F.col("dst").alias("to"), "distance",
            F.col("src").alias("id"), F.col("distance").alias("left"), F.array("src").alias("path"),
        )
    )
    remaining = to_target.select(
        *groups, F.col("src").alias("dst"), F.col("dst").alias("to"), (F.col("distance") + 1).alias("left")
    )
    adjacency = Adjacency(simple, "src", groups, hot_rows or HUB_EDGES)
    finished = [open_paths.filter(F.lit(False)).select(*head, "path")]
    while row_count(open_paths):
        nearer = adjacency.attach(open_paths).drop("src").join(remaining, [*groups, "dst", "to", "left"])
        longer = checkpointed(
            nearer.select(
                *head, F.col("dst").alias("id"), (F.col("left") - 1).alias("left"),
                F.concat("path", F.array("dst")).alias("path"),
            )
        )
        finished.append(longer.filter(F.col("left") == 0).select(*head, "path"))
        open_paths = longer.filter(F.col("left") > 0)
    adjacency.release()
    result = union_all(finished)
    return result.select(*groups, F.col("from").alias("src"), F.col("to").alias("dst"), "distance", "path")


def all_shortest_paths(
    edges: DataFrame,
    sources: DataFrame | None = None,
    targets: DataFrame | None = None,
    group_cols: Sequence[str] = (),
    hot_rows: int | None = None,
) -> DataFrame:
    """``(src, dst, distance, path)``: one row per shortest path between any two distinct vertices.

    ``path`` lists the ids from ``src`` to ``dst``. ``sources`` and ``targets`` (frames with ``id``) restrict the ends.
    Only edges that lie on a shortest path are followed, so no partial path is ever dropped. Without such restrictions the
    rows come straight from the tasks that hold the graphs.
    """
    groups = list(group_cols)
    if sources is not None or targets is not None or hot_rows:
        return _extend_paths(edges, sources, targets, groups, hot_rows)
    simple = checkpointed(simple_edges(edges, groups))
    packs, rest = packed(simple, groups)
    if packs is None:
        return _extend_paths(simple, None, None, groups, None)
    kinds = dict(simple.dtypes)
    schema = ", ".join(f"`{name}` {kinds[name]}" for name in (*groups, "src", "dst")) + f", distance int, path array<{kinds['src']}>"
    paths = search_packs(packs, searches.paths_between, schema, PATH_EDGES)
    return paths if rest is None else paths.unionByName(_extend_paths(rest, None, None, groups, None))


def shortest_paths_to(
    edges: DataFrame, destinations: DataFrame, group_cols: Sequence[str] = (), hot_rows: int | None = None
) -> DataFrame:
    """All shortest paths from every vertex to each of ``destinations``."""
    return _extend_paths(edges, None, destinations, list(group_cols), hot_rows)


def shortest_path(
    edges: DataFrame, pairs: DataFrame, group_cols: Sequence[str] = (), hot_rows: int | None = None
) -> DataFrame:
    """One shortest path per ``(src, dst)`` in ``pairs``: of several, the one whose id sequence is the smallest.

    Pairs without a path, and pairs of a vertex with itself, are absent. Paths that lose the tie are not enumerated.

    The search goes from both ends. A round takes, for each pair on its own, the end with fewer vertices on its last
    level one level on, so no vertex beyond the level where the two meet is looked at; a pair leaves when they meet or
    one end has nowhere to go. A vertex carries the smallest sequence between it and its end: all sequences of a level
    are equally long, so the smallest through a vertex is the smallest to it followed by the smallest from it.
    """
    groups = list(group_cols)
    pair = [*groups, "src", "dst"]
    named = [*groups, "_from", "_to"]
    simple = checkpointed(simple_edges(edges, groups))
    ends = pairs.select(*pair).filter(F.col("src") != F.col("dst")).distinct().toDF(*named)
    both = [
        ends.select("*", F.lit(forward).alias("forward"), F.col(end).alias("id"), F.array(end).alias("path"))
        for forward, end in ((True, "_from"), (False, "_to"))
    ]
    last, left = settle(union_all(both), rows=F.count(F.lit(1)))
    seen = [last.select(*named, "forward", "id")]
    found = []
    leaving = Adjacency(simple, "src", groups, hot_rows or HUB_EDGES)
    entering = Adjacency(simple, "dst", groups, hot_rows or HUB_EDGES)
    try:
        while left["rows"]:
            sizes = last.groupBy(*named).agg(F.count_if("forward").alias("ahead"), F.count_if(~F.col("forward")).alias("back"))
            sizes = sizes.filter((F.col("ahead") > 0) & (F.col("back") > 0))
            moves = F.col("forward") == (F.col("ahead") <= F.col("back"))
            dealt = checkpointed(
                join_spread(last, sizes, named, rows=left["rows"], hot_rows=hot_rows)
                .withColumn("moves", moves).drop("ahead", "back")
            )
            waiting = dealt.filter(~F.col("moves")).drop("moves")
            moving = dealt.filter("moves").drop("moves")
            ahead = leaving.attach(moving.filter("forward")).drop("src").withColumnRenamed("dst", "id")
            ahead = ahead.withColumn("path", F.concat("path", F.array("id")))
            back = entering.attach(moving.filter(~F.col("forward"))).drop("dst").withColumnRenamed("src", "id")
            back = back.withColumn("path", F.concat(F.array("id"), "path"))
            level = ahead.unionByName(back).groupBy(*named, "forward", "id").agg(F.min("path").alias("path"))
            level = checkpointed(level.join(union_all(seen), [*named, "forward", "id"], "left_anti"))
            seen.append(level.select(*named, "forward", "id"))

            other = waiting.select(*named, "id", F.col("path").alias("half"))
            whole = F.when(F.col("forward"), F.concat("path", F.slice("half", F.lit(2), F.size("half") - 1)))
            whole = whole.otherwise(F.concat("half", F.slice("path", F.lit(2), F.size("path") - 1)))
            met = level.join(other, [*named, "id"]).groupBy(*named).agg(F.min(whole).alias("path"))
            found.append(checkpointed(met))
            last = level.unionByName(waiting).join(found[-1], named, "left_anti")
            last, left = settle(last, rows=F.count(F.lit(1)))
    finally:
        leaving.release()
        entering.release()
    if not found:
        found = [ends.select(*named, F.array("_from").alias("path")).filter(F.lit(False))]
    result = union_all(found).withColumn("distance", F.size("path") - 1)
    return result.select(*groups, F.col("_from").alias("src"), F.col("_to").alias("dst"), "distance", "path")
