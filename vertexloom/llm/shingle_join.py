"""Jaccard join of shingle sets with set-relation skipping.

Sets that are equal are one set. Shingles are ordered from rare to frequent, and two sets that are similar enough share
one among the first few of each (prefix filter): these make inverted lists. A list is read in blocks by position: blocks
whose sizes or whose places leave too little room for the overlap are skipped. Every set of a list is first compared
with one leading set; its overlap with the leader bounds its overlap with any other set of which the leader's is known, so
the answers of a set follow from those of a similar one but for the pairs that the bounds leave open (after Wang, Qin,
Lin, Zhang, Chang: "Leveraging set relations in exact and dynamic set similarity join", 2017).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import arrow_map, drop_stored, exact, numbered, row_key, slices, stored
from vertexloom.llm.linking import bloom_filter, components, maybe_in, runs
from vertexloom.llm.shingles import mixed, shingle_sets

SHARE, OF = 80, 100  # sets link from this share of their union
BUCKET_BITS = 20  # shingles are counted in this many bits of their hash
CHUNK = 1024  # counts in one row, so that they are summed by many tasks
LEADERS = 8  # further sets of a list that lead it in each round
FEW = 100  # rounds end when fewer than one in so many of the pairs links
BLOCK = 1024  # sets of a list that are held against as many others at once
SKIP = 64  # sets of a list that are skipped together

DESCRIBED = "doc_id long, row long, n long, node long, chunk int, counts binary"
PREFIXES = "row long, node long, n long, prefix array<long>"
SHARED = "key long, node long, n long, place long, leader long, leader_n long, leader_place long"
LISTED = f"deal long, led boolean, {SHARED}"


def least_overlap(a, b):
    """Smallest intersection of sets of ``a`` and ``b`` shingles that link."""
    return -(-(a + b) * SHARE // (OF + SHARE))


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n + (-n * SHARE // OF) + 1  # n - ceil(share * n) + 1


def linked_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, row)``, one row per row of ``docs``; ``row`` is a hash of id and text.

    ``n_shingles`` is the number of distinct shingles of five lower-cased words; a text with fewer words has its whole
    sequence as its only one; a null text and one without words have none and link with nothing. ``component_id`` is the
    smallest id that is reachable by links. Rows with equal ids are compared each for itself; a row with a null id takes
    part but names no component unless all its ids are null. Other columns are not read.
    """
    rows = exact(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    described = stored(arrow_map(rows, _describe, DESCRIBED), "described")
    known = described.filter("chunk IS NULL").select("doc_id", "row", "n", "node")
    order = _bucket_order(described.filter("chunk IS NOT NULL").select("chunk", "counts"))

    # One row per distinct set goes on.
    first = known.filter("n > 1").groupBy("node").agg(F.min("row").alias("row"))
    prefixes = arrow_map(rows.select("row", "text"), _prefixes(order), PREFIXES)
    single = prefixes.join(first, ["node", "row"]).dropDuplicates(["node", "row"]).select("node", "n", "prefix")
    listed = arrow_map(single, _lists, LISTED).repartition("deal").sortWithinPartitions("deal", "key", "node")
    shared = stored(arrow_map(listed, _led, SHARED), "shared")
    first_pairs = shared.filter("node <> leader").filter(_possible("n", "place", "leader_n", "leader_place")).select(
        F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    sets = _sets(rows, first, shared)
    overlaps = _overlaps(sets, stored(first_pairs, "first_pairs"))

    # Groups grow by more leaders per list until a round finds hardly any link: one pair in FEW, or so few that they would
    # cost no more pairs than were compared so far, were they all in one group. Then all pairs still open are looked at.
    links = overlaps.filter(F.col("overlap") >= least_sql("n_a", "n_b")).select("a", "b")
    groups, compared, seed, size = components(links), overlaps, 0, overlaps.count()
    while True:
        pairs = stored(_led_pairs(shared, groups, compared, range(seed, seed + LEADERS)), "led_pairs")
        more = _overlaps(sets, pairs)
        fresh = stored(more.filter(F.col("overlap") >= least_sql("n_a", "n_b")).select("a", "b"), "fresh")
        found, asked = fresh.count(), pairs.count()
        if not found:
            break
        groups, compared, seed, size = _joined(groups, fresh), compared.unionByName(more), seed + LEADERS, size + asked
        if found * FEW < asked or found * found <= size:
            break
    more = _overlaps(sets, stored(_open_pairs(shared, compared, groups), "open_pairs"))
    everything = _joined(groups, more.filter(F.col("overlap") >= least_sql("n_a", "n_b")).select("a", "b"))
    drop_stored(sets, shared)

    # Ids of a component: the smallest over all its documents, equal sets included.
    nodes = known.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("lowest"))
    nodes = nodes.join(everything.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = nodes.groupBy("component").agg(F.min("lowest").alias("component_id"))
    of_node = nodes.select("node", "component").join(named, "component").select("node", "component_id")
    component = F.when((F.col("n") > 0) & F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return known.join(of_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "row")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of linked documents the one with the smallest id, all
    columns unchanged. Documents without words stay; of rows equal in id and text one stays."""
    plain, names = numbered(docs), docs.columns
    linked = linked_documents(docs)
    grouped = linked.filter("n_shingles > 0").groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("row")).select("row")
    keep = grouped.unionByName(linked.filter("n_shingles = 0").select("row")).distinct()
    doc_id, text = F.col(f"_c{names.index('doc_id')}").cast("long"), F.coalesce(f"_c{names.index('text')}", F.lit(""))
    kept = plain.withColumn("row", row_key(doc_id, text)).join(keep, "row")
    return kept.dropDuplicates(["row"]).drop("row").toDF(*names)


def least_sql(a: str, b: str):
    return F.ceil((F.col(a) + F.col(b)) * SHARE / F.lit(float(OF + SHARE)) - 1e-9)


def _possible(n: str, place: str, other_n: str, other_place: str):
    """Whether sizes and places of a shared shingle leave room for a link."""
    room = F.least(F.col(n) - F.col(place), F.col(other_n) - F.col(other_place))
    return room >= least_sql(n, other_n)


def _node(found: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and a 64 bit name of each set: the mixed sum of its mixed hashes."""
    n = np.bincount(owner, minlength=texts)
    total = np.zeros(texts, dtype=np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        starts = np.cumsum(n[some]) - n[some]
        total[some] = np.add.reduceat(mixed(found + np.uint64(1)), starts)
    return n, mixed(total + mixed(n.astype(np.uint64))).view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and name of every set, and at the end how many sets of the task have shingles in each bucket."""
    names = ["doc_id", "row", "n", "node", "chunk", "counts"]
    counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for batch in slices(batches, "text", 1_000_000):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        found, owner = shingle_sets(texts)
        counts += np.bincount((found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
        n, node = _node(found, owner, len(texts))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(node),
             pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.binary())], names)
    parts = counts.reshape(-1, CHUNK)
    used = np.flatnonzero(parts.any(axis=1))
    none = pa.nulls(len(used), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [none, none, none, none, pa.array(used.astype(np.int32)), pa.array([parts[i].tobytes() for i in used], pa.binary())], names)


def _bucket_order(parts: DataFrame) -> np.ndarray:
    """Place of each bucket in the order of falling rarity: at most 2 ** BUCKET_BITS numbers for any input."""
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])
    counts = np.zeros((1 << BUCKET_BITS) // CHUNK * CHUNK, dtype=np.int64).reshape(-1, CHUNK)
    for row in arrow_map(parts.repartition("chunk"), total, "chunk int, counts binary").toLocalIterator():
        counts[row["chunk"]] = np.frombuffer(row["counts"], dtype=np.int64)
    place = np.empty(counts.size, dtype=np.uint32)
    place[np.argsort(counts.ravel(), kind="stable")] = np.arange(counts.size, dtype=np.uint32)
    return place


def _ordered(found: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Hashes with their bucket replaced by its place: still one number per shingle, now rare ones first."""
    low = np.uint64(64 - BUCKET_BITS)
    return (order[(found >> low).astype(np.int64)].astype(np.uint64) << low) | (found & np.uint64((1 << (64 - BUCKET_BITS)) - 1))


def _prefixes(order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found, owner = shingle_sets(texts)
            n, node = _node(found, owner, len(texts))
            keys = _ordered(found, order)
            keys = keys[np.lexsort((keys, owner))]
            place = np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n)
            length = np.where(n > 0, prefix_length(n), 0)
            kept = (keys[place < np.repeat(length, n)] ^ np.uint64(1 << 63)).view(np.int64)  # signed numbers in the same order
            offsets = np.append(0, np.cumsum(length)).astype(np.int32)
            some = np.flatnonzero(n > 1)  # a single shingle links only with an equal set
            arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept))
            made = pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(node), pa.array(n, pa.int64()), arrays], ["row", "node", "n", "prefix"])
            yield made.take(pa.array(some))
    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inverted lists of a task. The first set of a list there leads the others, which need not meet the rest of the list
    in one task; ``led`` marks a leader that has such followers."""
    made = [np.empty((0, 4), dtype=np.int64)]
    for batch in batches:
        prefix = batch.column("prefix")
        length = prefix.value_lengths().to_numpy()
        first = np.repeat(np.cumsum(length) - length, length)
        made.append(np.stack([
            prefix.flatten().to_numpy(), np.repeat(batch.column("node").to_numpy(), length), np.repeat(batch.column("n").to_numpy(), length),
            np.arange(len(first)) - first], axis=1))
    rows = np.concatenate(made)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    opens = np.append(True, rows[1:, 0] != rows[:-1, 0])[: len(rows)]
    leader = np.flatnonzero(opens)[np.cumsum(opens) - 1] if len(rows) else np.empty(0, np.int64)
    led = opens & np.append(~opens[1:], False)[: len(rows)]
    deal = np.where(opens, rows[:, 0], mixed((rows[:, 0] ^ rows[:, 1]).view(np.uint64)).view(np.int64))
    for at in range(0, len(rows), 50_000):
        part = slice(at, at + 50_000)
        lead = rows[leader[part]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(deal[part]), pa.array(led[part]), *[pa.array(rows[part, i]) for i in range(4)],
             *[pa.array(lead[:, i], mask=opens[part]) for i in (1, 2, 3)]],
            ["deal", "led", "key", "node", "n", "place", "leader", "leader_n", "leader_place"])


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of two sets or more. Rows come sorted by key: the first without a leader leads the others, and itself."""
    names = ["key", "node", "n", "place"]
    leads = ["leader", "leader_n", "leader_place"]
    last = None
    for batch in batches:
        free = batch.column("leader").is_null()
        followers = batch.filter(batch.column("leader").is_valid())
        if followers.num_rows:
            yield followers.select([*names, *leads])
        own = batch.filter(free)
        if not own.num_rows:
            continue
        columns = [own.column(name).to_numpy(zero_copy_only=False) for name in (*names, "led")]
        if last is not None:
            columns = [np.append(x, y) for x, y in zip(last, columns)]
        key, led = columns[0], columns[4].astype(bool)
        opens = np.append(True, key[1:] != key[:-1])
        leader = np.flatnonzero(opens)[np.cumsum(opens) - 1]
        last = [column[leader[-1] : leader[-1] + 1] for column in columns]
        last[4] = np.zeros(1, dtype=bool)  # a leader's own row is given where it has followers or company in this batch
        kept = np.flatnonzero(~opens | led | np.append(~opens[1:], False))
        if len(kept):
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(column[kept]) for column in columns[:4]], *[pa.array(column[leader[kept]]) for column in columns[1:4]]],
                [*names, *leads])


def _sets(rows: DataFrame, first: DataFrame, shared: DataFrame) -> DataFrame:
    """``(node, n, hashes)`` of all sets that stand in a list with another, made once more from their texts; a filter of
    fixed size keeps most other texts from being looked at, the join does so exactly."""
    wanted = stored(first.join(shared.select("node").distinct(), "node"), "wanted")
    made = arrow_map(rows.select("row", "text"), _whole_sets(bloom_filter(wanted.select("row"))), "row long, node long, n long, hashes array<long>")
    made = made.join(wanted, ["row", "node"], "left_semi").dropDuplicates(["row", "node"])
    return stored(made.select("node", "n", "hashes"), "sets")


def _overlaps(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, n_a, n_b, overlap)`` of pairs of nodes."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("in_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("in_b"))
    both = pairs.join(left, "a").join(right, "b")
    overlap = F.size(F.array_intersect("in_a", "in_b")).cast("long")
    return stored(both.select("a", "b", "n_a", "n_b", overlap.alias("overlap")), "overlaps")


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (``id, component``) after further links: only the components that they join are looked at."""
    linked = links
    for end in ("a", "b"):
        own = groups.select(F.col("id").alias(end), F.col("component").alias("own"))
        linked = linked.join(own, end, "left").withColumn(end, F.coalesce("own", end)).drop("own")
    joined = components(linked.select("a", "b"))
    moved = groups.join(joined.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    alone = joined.join(groups.select("id"), "id", "left_anti")  # ids that had no link before
    return stored(moved.select("id", F.coalesce("to", "component").alias("component")).unionByName(alone), "groups")


def _whole_sets(bloom: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            own = batch.filter(pa.array(maybe_in(bloom, batch.column("row").to_numpy())))
            texts = own.column("text").cast(pa.binary()).to_pylist()
            if not texts:
                continue
            found, owner = shingle_sets(texts)
            n, node = _node(found, owner, len(texts))
            arrays = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([own.column("row"), pa.array(node), pa.array(n, pa.int64()), arrays], ["row", "node", "n", "hashes"])
    return run


def _mixed(shared: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of lists with their component, and ``(key, m)`` of the lists that hold more than one."""
    grouped = shared.join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    lists = grouped.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("low"), F.max("component").alias("high"))
    return grouped, lists.filter("low <> high AND m > 2").select("key", "m")


def _led_pairs(shared: DataFrame, groups: DataFrame, known: DataFrame, seeds: range) -> DataFrame:
    """Pairs of a set and one that leads its list, for sets not yet connected; a few leaders per list, others each time."""
    grouped, lists = _mixed(shared, groups)
    kept = grouped.join(lists.select("key"), "key").select("key", "node", "n", "place", "component")
    chosen = [F.min(F.struct(F.xxhash64(F.lit(seed), "node").alias("h"), "node", "n", "place", "component")) for seed in seeds]
    leaders = kept.groupBy("key").agg(F.array(*chosen).alias("leaders")).select("key", F.explode("leaders").alias("l"))
    joined = kept.join(leaders.select("key", F.col("l.node").alias("ln"), F.col("l.n").alias("lm"), F.col("l.place").alias("lp"), F.col("l.component").alias("lc")), "key")
    pairs = joined.filter("component <> lc").filter(_possible("n", "place", "lm", "lp"))
    pairs = pairs.select(F.least("ln", "node").alias("a"), F.greatest("ln", "node").alias("b")).distinct()
    return pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")


def _open_pairs(shared: DataFrame, overlaps: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of a list that are not known to be connected and that neither places nor the leader's overlaps rule out."""
    known = overlaps.select("a", "b", "overlap")  # of leaders and others
    both_ways = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"), "overlap"))
    grouped, mixed_lists = _mixed(shared, groups)
    mixed_lists = mixed_lists.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    kept = grouped.join(mixed_lists, "key")
    # The leader itself overlaps with itself in full; a member that was not compared with it has an unknown overlap, -1.
    measured = kept.join(both_ways.withColumnRenamed("a", "leader").withColumnRenamed("b", "node"), ["leader", "node"], "left")
    rows = measured.withColumn("overlap", F.when(F.col("node") == F.col("leader"), F.col("n")).otherwise(F.coalesce("overlap", F.lit(-1))))
    # A pair is looked at in the first list that has both, so a set takes the keys of its other open lists along.
    keys = kept.groupBy("node").agg(F.collect_set("key").alias("keys"))
    rows = rows.join(keys, "node").withColumn("earlier", F.filter("keys", lambda key: key < F.col("key"))).drop("keys")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    groups_by = ["key", "low", "high"]
    dealt = rows.select(*groups_by, "block", "place", "node", "n", "leader", "overlap", "component", "earlier")
    dealt = dealt.repartition(*groups_by).sortWithinPartitions(*groups_by, "place")
    found = arrow_map(dealt, _skip(groups_by), "a long, b long").distinct()
    return found.join(known, ["a", "b"], "left_anti")


def _skip(groups_by: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        size = 0
        for rows in runs(batches, groups_by):
            pairs = _block_pairs(rows)
            if len(pairs):
                found.append(pairs)
                size += len(pairs)
            if size > 100_000:
                yield _pair_batch(found)
                found, size = [], 0
        yield _pair_batch(found)
    return run


def _pair_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _meeting(n: np.ndarray, room: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether a link is possible between SKIP sets of ``left`` and SKIP of ``right``, by the least and greatest size and the
    greatest room behind the shared shingle of each. Rows come by rising place, so the last blocks leave least room."""
    def ends(at: np.ndarray) -> list[np.ndarray]:
        starts = np.arange(0, len(at), SKIP)
        return [np.minimum.reduceat(n[at], starts), np.maximum.reduceat(n[at], starts), np.maximum.reduceat(room[at], starts)]

    least, most, space = (x[:, None] for x in ends(left))
    least_right, most_right, space_right = ends(right)
    sizes = (most_right * OF >= least * SHARE) & (least_right * SHARE <= most * OF)
    return sizes & (np.minimum(space, space_right) >= least_overlap(least, least_right))


def _block_pairs(rows: pa.Table) -> np.ndarray:
    """Open pairs between two blocks of a list, whose rows come by rising place."""
    low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    names = ("block", "place", "node", "n", "leader", "overlap", "component")
    block, place, node, n, leader, overlap, component = (rows.column(name).to_numpy() for name in names)
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    if not len(left) or not len(right) or (component == component[0]).all():
        return np.empty((0, 2), dtype=np.int64)
    room = n - place
    meeting = _meeting(n, room, left, right)
    if not meeting.any():
        return np.empty((0, 2), dtype=np.int64)
    earlier = _members(rows.column("earlier"))
    result = []
    for step in np.flatnonzero(meeting.any(axis=1)):
        i = left[step * SKIP : (step + 1) * SKIP]
        j = right[np.repeat(meeting[step], SKIP)[: len(right)]]
        need = least_overlap(n[i][:, None], n[j])
        # |x n y| <= |l n y| + |x \\ l|, and the same with x and y exchanged, where both overlaps with one leader l are known.
        known = (overlap[j] >= 0) & (overlap[i] >= 0)[:, None] & (leader[j] == leader[i][:, None])
        bound = np.minimum(overlap[j] + (n[i] - overlap[i])[:, None], overlap[i][:, None] + (n[j] - overlap[j]))
        open_ = (np.minimum(room[i][:, None], room[j]) >= need) & (~known | (bound >= need)) & (component[i][:, None] != component[j])
        open_ &= earlier[i] @ earlier[j].T == 0
        a, b = np.nonzero(open_)
        a, b = node[i[a]], node[j[b]]
        result.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
    return np.concatenate(result) if result else np.empty((0, 2), dtype=np.int64)


def _members(lists: pa.ChunkedArray) -> np.ndarray:
    """One row per list, with a 1 in the column of each of its numbers that another list has too."""
    sizes = np.array([len(own or ()) for own in lists.to_pylist()], dtype=np.int64)
    flat = np.concatenate([np.array(own or (), dtype=np.int64) for own in lists.to_pylist()])
    values, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    row, column = np.repeat(np.arange(len(sizes)), sizes), place[column]
    result = np.zeros((len(sizes), max(1, len(shared))), dtype=np.float32)
    result[row[column >= 0], column[column >= 0]] = 1
    return result
