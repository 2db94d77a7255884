"""Rows that link, and the groups they form: runs of equal keys in sorted batches, connected components, filters of ids."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import arrow_map, stored

LINKS_PER_TASK = 500_000
FEW_LINKS = 20_000  # so many links or fewer are left to one task
BLOOM_BITS = 25  # of a filter of ids: 4 MB, whatever the input


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches in which rows of a key stand together. Key columns have no nulls."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(key).to_numpy(zero_copy_only=False) for key in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        if last is not None and tuple(column[0] for column in columns) != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if start:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
        last = tuple(column[-1] for column in columns)
    if held:
        yield pa.Table.from_batches(held)


def roots(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Smallest index that each of ``size`` indices is connected to by the pairs ``(a, b)``."""
    root = np.arange(size)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
    return root


def _rank(ids: np.ndarray, seed: int) -> np.ndarray:
    """A shuffled order of ids, another one for every seed (the finishing steps of splitmix64)."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def _forest(seed: int):
    """Replace a task's links by ``(id, root, rank)``: the id of lowest rank in its group in the task."""
    def grouped(links: np.ndarray) -> np.ndarray:
        ids, index = np.unique(links, return_inverse=True)
        order = np.argsort(_rank(ids, seed), kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        a, b = place[index.reshape(links.shape)].T
        root = roots(a, b, len(ids))
        own = np.flatnonzero(root != np.arange(len(ids)))
        return np.stack([ids[order[own]], ids[order[root[own]]]], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.empty((0, 2), dtype=np.int64)], 0
        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1))
            size += batch.num_rows
            if size > LINKS_PER_TASK:
                held, size = [grouped(np.concatenate(held))], 0
        found = grouped(np.concatenate(held))
        rank = _rank(found[:, 1], seed).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(rank)], ["id", "root", "rank"])
    return run


def components(links: DataFrame) -> DataFrame:
    """``(id, component)``: the smallest id that is connected with ``id``, for all ids in the two columns of ``links``.

    A round replaces the links of each task by stars. Ids that are a star's centre in some task go on to the next round,
    linked with the first centre of each id that they share; all other ids hang on their first centre. "First" is by an
    order that is shuffled anew every round, so a constant share of the ids is expected to go in each, on long paths too.
    Links are dealt out evenly, whatever their ids, and minima combine before the shuffle: no hub meets in one task. Only
    when few links are left, a fixed number, one task ends the search.
    """
    a, b = links.columns
    links = stored(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b"), "links")
    hanging: list[DataFrame] = []
    while size := links.count():
        dealt = links.repartition(1 if size < FEW_LINKS else max(4, size // LINKS_PER_TASK + 1))
        forest = stored(arrow_map(dealt, _forest(len(hanging)), "id long, root long, rank long"), "forest")
        best = forest.groupBy("id").agg(F.min(F.struct("rank", "root"))["root"].alias("best"))
        chosen = stored(best.join(forest.select(F.col("root").alias("id")).distinct().withColumn("centre", F.lit(True)), "id", "left"), "chosen")
        hanging.append(chosen.filter(F.col("centre").isNull()).select("id", "best"))
        shared = forest.join(chosen, "id").filter("root <> best").select(F.col("root").alias("a"), F.col("best").alias("b"))
        centres = chosen.filter("centre").select(F.col("id").alias("a"), F.col("best").alias("b"))
        links = stored(shared.unionByName(centres).distinct(), "links")
    if not hanging:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    final = hanging[-1].select("id", F.col("best").alias("root"))
    for earlier in reversed(hanging[:-1]):
        later = final.select(F.col("id").alias("best"), "root")
        followed = earlier.join(later, "best", "left").select("id", F.coalesce("root", "best").alias("root"))
        final = stored(followed.unionByName(final), "followed")
    members = final.unionByName(final.select(F.col("root").alias("id"), "root").distinct())
    names = members.groupBy("root").agg(F.min("id").alias("component"))
    return stored(members.join(names, "root").select("id", "component"), "components")


def bloom_filter(ids: DataFrame) -> np.ndarray:
    """Bits at two hashes of every id in the only column. The size is fixed: a full filter lets everything pass."""
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << BLOOM_BITS, dtype=bool)
        for batch in batches:
            own[_places(batch.column(0).to_numpy())] = True
        packed = np.packbits(own).reshape(-1, 1 << 12)
        used = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([packed[i].tobytes() for i in used], pa.binary())], ["part", "bits"])
    result = np.zeros(((1 << BLOOM_BITS) // 8 >> 12, 1 << 12), dtype=np.uint8)
    for row in arrow_map(ids.coalesce(8), bits, "part long, bits binary").toLocalIterator():
        result[row["part"]] |= np.frombuffer(row["bits"], dtype=np.uint8)
    return result.ravel()


def maybe_in(bloom: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """False for ids that are surely not in the filter."""
    at = _places(ids)
    return (bloom[at >> 3] >> (7 - (at & 7)) & 1).astype(bool).reshape(2, -1).all(axis=0)


def _places(ids: np.ndarray) -> np.ndarray:
    first = _rank(ids.astype(np.int64), 0)
    return np.concatenate([first >> np.uint64(63 - BLOOM_BITS), first & np.uint64((1 << BLOOM_BITS) - 1)]).astype(np.int64)
