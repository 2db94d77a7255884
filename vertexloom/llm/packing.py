"""Best-fit packing of documents into sequences by linear grouping.

Spark tokenises, counts lengths and ranks the pieces of each length. The plan needs no more than the histogram of
lengths (at most ``size`` numbers) and says for runs of ranks where they go, so it is as small for any input.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm.common import arrow_map, exact, slices, stored
from vertexloom.llm.pieces import encoder

GROUPS = (512, 1024, 2048)  # numbers of sizes that large lengths are rounded up to; the best plan of them is taken
SMALL = 1 / 4  # lengths up to this part of a sequence are small: best-fit places them in what is left

PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


@dataclass
class Bins:
    """``count`` sequences with the same lengths in the same places."""

    count: int
    lengths: list[int] = field(default_factory=list)


# ---- the plan, from a histogram ----


def rounded(histogram: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Linear grouping: the lengths in falling order, cut into groups of equal numbers of pieces.

    Returns per group its ``(length, count)`` runs in falling order; the first length is what the group is rounded to.
    """
    total = sum(histogram.values())
    per_group = max(1, -(-total // groups))
    result: list[list[tuple[int, int]]] = []
    room = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if len(histogram) <= groups:
            result.append([(length, left)])
            continue
        while left:
            if not room:
                result.append([])
                room = per_group
            taken = min(left, room)
            result[-1].append((length, taken))
            left, room = left - taken, room - taken
    return result


def configuration(sizes: list[int], counts: list[int], first: int, capacity: int) -> dict[int, int]:
    """The fullest set of pieces that holds one of size ``first``: ``{index of size: number}``.

    Subset sums as the bits of one integer, one layer per size; walked back through the layers.
    """
    room = capacity - sizes[first]
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for i in range(len(sizes)):
        available = counts[i] - (i == first)
        layers.append(reach)
        for _ in range(min(available, room // sizes[i])):
            reach |= (reach << sizes[i]) & mask
        if reach >> room & 1:
            break
    filled = reach.bit_length() - 1
    chosen = {first: 1}
    for i in range(len(layers) - 1, -1, -1):
        while not layers[i] >> filled & 1:
            chosen[i] = chosen.get(i, 0) + 1
            filled -= sizes[i]
    return chosen


def fill(histogram: dict[int, int], capacity: int, groups: int) -> list[Bins]:
    """Pack rounded lengths by few configurations, each used as often as it can, then put actual lengths in."""
    members = rounded(histogram, groups)
    merged: dict[int, list[tuple[int, int]]] = {}
    for group in members:
        merged.setdefault(group[0][0], []).extend(group)
    sizes = sorted(merged, reverse=True)
    queues = [list(reversed(merged[size])) for size in sizes]  # the largest actual lengths are at the end
    counts = [sum(n for _, n in queue) for queue in queues]
    result: list[Bins] = []
    first = 0
    while first < len(sizes):
        if not counts[first]:
            first += 1
            continue
        chosen = configuration(sizes, counts, first, capacity)
        times = min(counts[i] // number for i, number in chosen.items())
        runs = [Bins(times)]
        for i, number in sorted(chosen.items()):
            counts[i] -= times * number
            for _ in range(number):
                runs = _substituted(runs, queues[i])
        result.extend(runs)
    return result


def _substituted(runs: list[Bins], queue: list[tuple[int, int]]) -> list[Bins]:
    """Put one more actual length into every sequence of ``runs``, from the end of ``queue``."""
    result = []
    for run in runs:
        left = run.count
        while left:
            length, available = queue.pop()
            taken = min(left, available)
            if available > taken:
                queue.append((length, available - taken))
            result.append(Bins(taken, [*run.lengths, length]))
            left -= taken
    return result


def best_fit(bins: list[Bins], histogram: dict[int, int], capacity: int) -> dict[int, int]:
    """Place small lengths, the longest first, where the least room is left; returns what found no room.

    Of sequences with the same room the one that has had it for longest is taken.
    """
    by_room: dict[int, deque[Bins]] = {}
    for run in bins:
        by_room.setdefault(capacity - sum(run.lengths), deque()).append(run)
    rooms = sorted(by_room)
    bins.clear()
    left_over: dict[int, int] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                left_over[length] = left
                break
            room = rooms[at]
            run = by_room[room].popleft()
            if not by_room[room]:
                del by_room[room], rooms[at]
            number = 1 if left < run.count else min(room // length, left // run.count)
            used = min(left, run.count)
            if used < run.count:
                _put(by_room, rooms, room, Bins(run.count - used, run.lengths))
            _put(by_room, rooms, room - number * length, Bins(used, [*run.lengths, *[length] * number]))
            left -= used * number
    bins.extend(run for runs in by_room.values() for run in runs)
    return left_over


def _put(by_room: dict[int, deque[Bins]], rooms: list[int], room: int, run: Bins) -> None:
    if room not in by_room:
        by_room[room] = deque()
        insort(rooms, room)
    by_room[room].append(run)


def plan(
    histogram: dict[int, int], capacity: int, groups: tuple[int, ...] = GROUPS, small: float = SMALL
) -> list[Bins]:
    """All sequences for a histogram of lengths between 1 and ``capacity``."""
    border = int(capacity * small)
    plans = []
    for number in groups:
        bins = fill({length: n for length, n in histogram.items() if length > border}, capacity, number)
        rest = best_fit(bins, {length: n for length, n in histogram.items() if length <= border}, capacity)
        plans.append(bins + fill(rest, capacity, number))
    return min(plans, key=lambda bins: sum(run.count for run in bins))


def placements(bins: list[Bins]) -> dict[int, np.ndarray]:
    """Per length, rows ``(first rank, first sequence, offset)``: ranks from one row's to the next go to successive
    sequences, at the same offset."""
    ranks: dict[int, int] = {}
    result: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for run in bins:
        offset = 0
        for length in run.lengths:
            rank = ranks.get(length, 0)
            result.setdefault(length, []).append((rank, sequence, offset))
            ranks[length] = rank + run.count
            offset += length
        sequence += run.count
    return {length: np.array(rows, dtype=np.int64) for length, rows in result.items()}


# ---- the job ----


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """One row per piece: a document's ids and ``end_id``; longer ones are cut so that all but the first piece are full.

    A null text counts as empty; rows with equal or null ``doc_id`` are documents of their own (``copy`` tells them
    apart); other columns are not read.
    """
    rows = exact(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, "text"):
            found = []
            encoded = library.encode(batch.column("text").to_pylist())
            for doc_id, copy, ids in zip(batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist(), encoded):
                ids += end
                total = len(ids) // 4
                starts = [0, *range(total % size or size, total, size), total]
                for piece, (start, stop) in enumerate(zip(starts, starts[1:])):
                    found.append((doc_id, copy, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(zip(*found), kinds)],
                ["doc_id", "copy", "piece", "start", "length", "ids_crc32"])
    return arrow_map(rows, run, PIECES)


def pack(pieces: DataFrame, size: int = 2048, rows_per_bucket: int = 100_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: as few sequences of at most ``size`` tokens as the plan finds.

    Pieces of one length are interchangeable, so each gets a rank among those of its length and the plan says where runs
    of ranks go. Ranks are counted in buckets by hash, so a length that a third of all pieces have is spread. An empty
    table gives an empty result.
    """
    pieces = stored(pieces, "pieces")
    histogram = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not histogram:
        return pieces.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long")).drop("copy")
    where = placements(plan(histogram, size))
    buckets = max(64, sum(histogram.values()) // rows_per_bucket)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(buckets)))
    counts = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "copy", "piece")
    ranked = keyed.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["length", "bucket"])
    return arrow_map(
        ranked.select("doc_id", "copy", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank")),
        _place(where), PLACED).drop("copy")


def _place(where: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            borders = np.flatnonzero(np.diff(lengths[order])) + 1
            for own in np.split(order, borders) if len(order) else []:
                rows = where[int(lengths[own[0]])]
                run_of = rows[np.searchsorted(rows[:, 0], ranks[own], side="right") - 1]
                sequence[own] = run_of[:, 1] + ranks[own] - run_of[:, 0]
                offset[own] = run_of[:, 2]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.array(sequence), pa.array(offset)],
                ["doc_id", "copy", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for all documents, one row per piece."""
    return pack(token_pieces(docs, tokenizer_path, end_id, size), size)
