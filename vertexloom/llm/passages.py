"""Near-duplicate passages by exact runs and compact windows.

A text is its sequence of shingles, a run is ``LEAST`` of them in a row. Under a min-hash function, the node of the
Cartesian tree over the hashes at place c with extent [l, r] stands for all subsequences within [l, r] that hold c: they
share c's hash as signature (Deng, Li, Feng: "Near-duplicate sequence search at scale for large language model
memorization evaluation", 2022). So the runs of a text fall into windows of consecutive starts with one signature each.

Equal runs have equal signatures under every function. The runs of windows whose first signature stands in two documents
are dealt by a hash of their whole content: every run but that of one document has its source then, without any comparison.
Of the runs that are left, no two in different documents are equal. Those that share a signature under any function are
held against each other, all with all, in blocks; a block is first thinned by the number of shared shingles. The first
functions come first: what lies in a passage that they found is not looked for under the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import arrow_map, drop_stored, exact, numbered, row_key, slices, stored
from vertexloom.llm.linking import bloom_filter, maybe_in, runs
from vertexloom.llm.shingles import _power, mixed, shingles, words

SIZE = 5  # words in a shingle
LEAST = 46  # shingles of the shortest passage: 50 words
SIMILAR = 0.8
MISSED = 1e-4  # chance that two runs just at the threshold agree under no min-hash function and are never compared
FUNCTIONS = math.ceil(math.log(MISSED) / math.log(1 - SIMILAR))
EARLY = 2  # functions whose passages are known before the others are tried
BLOCK = 4096  # windows of one signature that one task holds against as many others
CHUNK = 1024  # windows that are held against as many others at once
COLUMNS = 4096  # shingles that are counted at once
SMALL = 64  # lists of so many windows or fewer are held against each other many at a time
ROWS = 10_000  # windows that are taken at a time

SIGNED = "key long, low long, high long, open boolean, m long"
RUNS = "run long, row long, start int, lead long, lead_start int"
FOUND = "row long, start int, n int, lead long, lead_start int, similarity double"
WINDOWS = "key long, row long, start int, open long, content binary"


# ---- windows of a batch of texts ----


def nodes(values: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(c, l, r)`` of the Cartesian tree's nodes with an extent of at least ``least``, for all segments at once, in order of
    place. Extents are given as far as runs of ``least`` around c reach.

    A run's node is its smallest value, of equal ones the leftmost. The next run has another node if its smallest value
    differs or if the node is the value that is left behind.
    """
    keep = high - low >= least
    low, high = low[keep], high[keep]
    if not len(low):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    smallest, width = values, 1
    while 2 * width <= least:
        smallest, width = np.minimum(smallest[:-width], smallest[width:]), 2 * width
    if width < least:
        smallest = np.minimum(smallest[: width - least], smallest[least - width :])
    n = high - low - least + 1
    end = np.cumsum(n)
    start = np.arange(end[-1]) + np.repeat(low - (end - n), n)
    own = smallest[start]
    opens = np.append(True, (own[1:] != own[:-1]) | (values[start[:-1]] == own[:-1]))
    opens[end[:-1]] = True
    at = np.flatnonzero(opens)
    first, last, own = start[at], start[np.append(at[1:], len(start)) - 1], own[at]
    c = last.copy()
    ahead = np.flatnonzero(values[last] != own)
    spots = np.minimum(last[ahead][:, None] + np.arange(least), len(values) - 1)
    c[ahead] += (values[spots] == own[ahead][:, None]).argmax(axis=1)
    return c, first, last + least - 1


def starts_of(tree: tuple[np.ndarray, np.ndarray, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """``(first start, c)`` of the runs of starts whose subsequence of ``least`` shingles has the node at c, sorted."""
    c, left, _ = tree
    start = np.maximum(left, c - least + 1)
    order = np.argsort(start, kind="stable")
    return start[order], c[order]


def signed(values: np.ndarray, low: np.ndarray, high: np.ndarray, function: int) -> tuple[np.ndarray, ...]:
    """``(key, first start, last start, anchor)`` of the windows of all segments under one function, in order of place."""
    long = high - low >= LEAST
    low, high = low[long], high[long]
    own = mixed(values ^ np.uint64((function + 1) * 0xD1342543DE82EF95 % (1 << 64)))
    start, c = starts_of(nodes(own, low, high, LEAST), LEAST)
    if not len(start):
        return own[:0].view(np.int64), start, start, c
    segment = np.searchsorted(low, start, side="right") - 1
    end = np.minimum(np.append(start[1:], high[-1]) - 1, high[segment] - LEAST)
    return own[c].view(np.int64), start, end, c


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(shingles, low, high)``: all shingles in order of place, and each text's range of them."""
    hashes, document, _, _ = words(texts)
    found, owner = shingles(hashes, document, SIZE)
    return found, np.searchsorted(owner, np.arange(len(texts))), np.searchsorted(owner, np.arange(len(texts)), side="right")


def _per_key(made: list[np.ndarray]) -> pa.RecordBatch:
    """Lowest and highest row of each key of a task, whether a start is open there and the number of windows, from
    ``(key, row, open)``."""
    rows = np.concatenate(made) if made else np.empty((0, 3), dtype=np.int64)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    at = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0])[: len(rows)])
    last = np.append(at[1:], len(rows)) - 1 if len(at) else at
    some = np.maximum.reduceat(rows[:, 2], at) > 0 if len(at) else np.empty(0, bool)
    columns = [rows[at, 0], rows[at, 1], rows[last, 1], some, last - at + 1]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "low", "high", "open", "m"])


def _shared(parts: DataFrame, name: str) -> DataFrame:
    """``(key, m)``: the keys that stand in two documents, with an open start, and how many windows have them."""
    keys = parts.groupBy("key").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("open").alias("open"), F.sum("m").alias("m"))
    return stored(keys.filter("low <> high AND open").select("key", "m"), name)


# ---- equal runs ----


def _first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made: list[np.ndarray] = []
    for batch in slices(batches, "text", 1_000_000):
        values, low, high = sequences(batch.column("text").cast(pa.binary()).to_pylist())
        key, start, _, _ = signed(values, low, high, 0)
        row = batch.column("row").to_numpy()[_owner(low, high, start)]
        made.append(np.stack([key, row, np.ones(len(key), dtype=np.int64)], axis=1))
    yield _per_key(made)


def _owner(low: np.ndarray, high: np.ndarray, start: np.ndarray) -> np.ndarray:
    long = np.flatnonzero(high - low >= LEAST)
    return long[np.searchsorted(low[long], start, side="right") - 1] if len(start) else np.empty(0, np.int64)


def run_hashes(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of the ``LEAST`` shingles from each start on."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power("up", len(values)), out=total[1:])
    return mixed((total[start + LEAST] - total[start]) * _power("down", len(values))[start]).view(np.int64)


def _equal_runs(bloom: np.ndarray):
    """Runs that may stand in two documents. The first document of a task that has a run is the source of the others there;
    its own runs have no source yet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [np.empty((0, 3), dtype=np.int64)]
        for batch in slices(batches, "text", 1_000_000):
            values, low, high = sequences(batch.column("text").cast(pa.binary()).to_pylist())
            key, first, last, _ = signed(values, low, high, 0)
            keep = maybe_in(bloom, key)
            first, n = first[keep], (last - first + 1)[keep]
            start = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
            if len(start):
                owner = _owner(low, high, start)
                made.append(np.stack([run_hashes(values, start), batch.column("row").to_numpy()[owner], start - low[owner]], axis=1))
        rows = np.concatenate(made)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        leader = _leaders(rows[:, 0])
        for at in range(0, len(rows), 50_000):
            own, lead = rows[at : at + 50_000], rows[leader[at : at + 50_000]]
            none = own[:, 1] == lead[:, 1]
            yield _run_batch(own, lead, none)
    return run


def _leaders(run: np.ndarray) -> np.ndarray:
    opens = np.append(True, run[1:] != run[:-1])[: len(run)]
    return np.flatnonzero(opens)[np.cumsum(opens) - 1] if len(run) else np.empty(0, np.int64)


def _run_batch(own: np.ndarray, lead: np.ndarray, none: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(own[:, 2].astype(np.int32)),
               pa.array(lead[:, 1], mask=none), pa.array(lead[:, 2].astype(np.int32), mask=none)]
    return pa.RecordBatch.from_arrays(columns, ["run", "row", "start", "lead", "lead_start"])


def _first_of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without a source, sorted by run, row and start: the first document of a run is the source of the others."""
    last = np.empty((0, 3), dtype=np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(name).to_numpy().astype(np.int64) for name in ("run", "row", "start")], axis=1)
        rows = np.concatenate([last, rows])
        leader = _leaders(rows[:, 0])
        other = np.flatnonzero(rows[:, 1] != rows[leader, 1])  # a passage that repeats within the first document has no source there
        other = other[other >= len(last)]
        last = rows[leader[-1] :][:1]
        if len(other):
            yield _run_batch(rows[other], rows[leader[other]], np.zeros(len(other), dtype=bool))


def _joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages that the runs of each document add up to; rows come sorted by document and start."""
    for table in runs(batches, ["row"]):
        start, lead, source = (table.column(name).to_numpy().astype(np.int64) for name in ("start", "lead", "lead_start"))
        fresh = np.append(True, start[1:] != start[:-1])
        start, lead, source = start[fresh], lead[fresh], source[fresh]
        cuts = np.flatnonzero((np.diff(start) != 1) | (np.diff(lead) != 0) | (np.diff(source) != 1)) + 1
        first, end = np.append(0, cuts), np.append(cuts, len(start))
        made: list[list[int]] = []
        for a, b in zip(first.tolist(), end.tolist()):
            n, before = b - a, made[-1] if made else None
            # Text that repeats itself has runs that all point to the same few of its source.
            if before and before[2] == lead[a] and before[0] + before[1] == start[a] and before[3] <= source[a] and source[a] + n <= before[3] + before[4]:
                before[1] += n
            else:
                made.append([int(start[a]), n, int(lead[a]), int(source[a]), n])
        row = table.column("row")[0].as_py()
        yield pa.RecordBatch.from_arrays(
            [pa.array([row] * len(made), pa.int64()), pa.array([x[0] for x in made], pa.int32()), pa.array([x[1] + LEAST - 1 for x in made], pa.int32()),
             pa.array([x[2] for x in made], pa.int64()), pa.array([x[3] for x in made], pa.int32()), pa.array(np.ones(len(made)))],
            ["row", "start", "n", "lead", "lead_start", "similarity"])


# ---- windows of what is left ----


def _left(batch: pa.RecordBatch, functions: range) -> Iterator[tuple[np.ndarray, ...]]:
    """Per function ``(key, owner, first, n, open)`` of the windows without runs that have an equal source, and the
    shingles and where each text begins among them. ``open`` has a bit per start: not set where at least ``SIMILAR`` of
    the run lie in a passage that is known."""
    values, low, high = sequences(batch.column("text").cast(pa.binary()).to_pylist())
    gone, known = np.zeros(len(values) + 1, dtype=np.int64), np.zeros(len(values) + 1, dtype=np.int64)
    edge = LEAST - int(np.ceil(SIMILAR * LEAST))
    for i, spans in enumerate(batch.column("spans").to_pylist()):
        for span in spans or ():
            a, n = low[i] + span["start"], span["n"]
            if span["equal"]:
                gone[a] += 1
                gone[a + n - LEAST + 1] -= 1
            if n >= LEAST - edge:
                known[max(low[i], a - edge)] += 1
                known[min(high[i], a + n - LEAST + 1 + edge)] -= 1
    gone, known = np.cumsum(gone) > 0, np.cumsum(known) > 0
    gone_before, known_before = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(known))
    for function in functions:
        key, first, last, _ = signed(values, low, high, function)
        n = last - first + 1
        n_gone, n_known = (before[last + 1] - before[first] for before in (gone_before, known_before))
        plain = (n_gone == 0) & ((n_known == 0) | (n_known == n))
        mask = np.where(n_known[plain] > 0, np.uint64(0), (np.uint64(1) << n[plain].astype(np.uint64)) - np.uint64(1)).view(np.int64)
        window, at, size = np.flatnonzero(plain), first[plain], n[plain]
        other = np.flatnonzero(~plain & (n_gone < n))
        if len(other):
            m = n[other]
            start = np.arange(m.sum()) + np.repeat(first[other] - (np.cumsum(m) - m), m)
            own = np.repeat(other, m)[~gone[start]]
            start = start[~gone[start]]
            cut = np.flatnonzero(np.append(True, (np.diff(start) != 1) | (np.diff(own) != 0)))
            run = np.diff(np.append(cut, len(start)))
            bit = (start - np.repeat(start[cut], run)).astype(np.uint64)
            bits = np.bitwise_or.reduceat(np.where(known[start], np.uint64(0), np.uint64(1) << bit), cut).view(np.int64)
            window, at, size, mask = (np.append(x, y) for x, y in ((window, own[cut]), (at, start[cut]), (size, run), (mask, bits)))
        if len(at):
            yield key[window], _owner(low, high, at), at, size, mask, values, low


def _left_keys(functions: range):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[np.ndarray] = []
        for batch in slices(batches, "text", 1_000_000):
            for key, owner, _, _, mask, _, _ in _left(batch, functions):
                made.append(np.stack([key, batch.column("row").to_numpy()[owner], mask != 0], axis=1))
        yield _per_key(made)
    return run


def _left_windows(bloom: np.ndarray, functions: range):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            short = None
            for key, owner, first, n, mask, values, low in _left(batch, functions):
                keep = np.flatnonzero(maybe_in(bloom, key))
                owner, first, n = owner[keep], first[keep], n[keep]
                short = (values >> np.uint64(32)).astype("<u4") if short is None else short
                content = [short[a : a + m + LEAST - 1].tobytes() for a, m in zip(first.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[keep]), batch.column("row").take(pa.array(owner)), pa.array((first - low[owner]).astype(np.int32)),
                     pa.array(mask[keep]), pa.array(content, pa.binary())],
                    ["key", "row", "start", "open", "content"])
    return run


# ---- runs that are alike ----


def _before(x: np.ndarray) -> np.ndarray:
    """Place of the same number further left, -1 without one."""
    order = np.argsort(x, kind="stable")
    result = np.full(len(x), -1)
    same = np.flatnonzero(x[order][1:] == x[order][:-1])
    result[order[same + 1]] = order[same]
    return result


def _counting(p: np.ndarray, before: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts ``[a, b)`` of the runs in which the shingles at the places ``p`` count."""
    low = np.maximum(np.maximum(before[p], p - LEAST) + 1, 0)
    return np.minimum(low, starts), np.maximum(np.minimum(p + 1, starts), np.minimum(low, starts))


def _distinct(before: np.ndarray, starts: int) -> np.ndarray:
    """The number of different shingles in each run."""
    a, b = _counting(np.arange(len(before)), before, starts)
    return np.cumsum(np.bincount(a, minlength=starts + 1) - np.bincount(b, minlength=starts + 1))[:starts]


def run_similarities(x: np.ndarray, y: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The similarity of every run of ``x`` with every run of ``y``; ``same`` tells which of their shingles are equal.

    A shingle counts at its first place in a run: for the starts after its last place before, up to itself.
    """
    starts_x, starts_y = len(x) - LEAST + 1, len(y) - LEAST + 1
    if same.sum(axis=0).max() <= 1 and same.sum(axis=1).max() <= 1 and _all_differ(x) and _all_differ(y):
        total = np.zeros((len(x) + 1, len(y) + 1), dtype=np.int32)
        np.cumsum(same, axis=0, out=total[1:, 1:])
        np.cumsum(total, axis=1, out=total)
        rows = total[LEAST:] - total[:-LEAST]
        both = rows[:, LEAST:] - rows[:, :-LEAST]
        return both / (2 * LEAST - both)
    before_x, before_y = _before(x), _before(y)

    p, q = np.nonzero(same)
    (a, b), (c, d) = _counting(p, before_x, starts_x), _counting(q, before_y, starts_y)
    wide = starts_y + 1
    corner = lambda i, j: np.bincount(i * wide + j, minlength=(starts_x + 1) * wide)
    both = (corner(a, c) - corner(a, d) - corner(b, c) + corner(b, d)).reshape(starts_x + 1, wide)
    both = both.cumsum(axis=0).cumsum(axis=1)[:starts_x, :starts_y]
    return both / (_distinct(before_x, starts_x)[:, None] + _distinct(before_y, starts_y) - both)


def _all_differ(x: np.ndarray) -> bool:
    return len(set(x.tolist())) == len(x)


def alike(x: np.ndarray, y: np.ndarray, open_: np.ndarray, least: float = 0.0) -> list[tuple[int, int, int, int, float]]:
    """``(start, end, source start, source end, similarity)`` of passages of ``x`` with open starts that are alike one of
    ``y``. No run with fewer than ``least`` shingles of ``y`` can be."""
    same = x[:, None] == y
    held = np.append(0, np.cumsum(same.any(axis=1)))
    if not ((held[LEAST:] - held[:-LEAST] >= least) & open_).any():
        return []
    held = np.append(0, np.cumsum(same.any(axis=0)))
    if (held[LEAST:] - held[:-LEAST]).max() < least:
        return []
    scores = run_similarities(x, y, same)
    best = scores.argmax(axis=1)
    score = scores[np.arange(len(scores)), best]
    hits = np.flatnonzero((score >= SIMILAR) & open_)
    found = []
    for part in np.split(hits, np.flatnonzero(np.diff(hits) != 1) + 1) if len(hits) else ():
        top = part[np.argmax(score[part])]
        spans = [(part[0], part[-1] + LEAST, best[part].min(), best[part].max() + LEAST), (top, top + LEAST, best[top], best[top] + LEAST)]
        for a, b, c, d in spans:
            shared = np.flatnonzero(same[a:b, c:d].any(axis=1))  # less ends that the other does not have
            a, b = int(a + shared[0]), int(a + shared[-1] + 1)
            shared = np.flatnonzero(same[a:b, c:d].any(axis=0))
            c, d = int(c + shared[0]), int(c + shared[-1] + 1)
            if (result := similarity(x[a:b], y[c:d])) >= SIMILAR:
                found.append((a, b, c, d, result))
                break
    return found


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    one, two = set(a.tolist()), set(b.tolist())
    both = len(one & two)
    return both / max(1, len(one) + len(two) - both)


def _of_runs(size: np.ndarray, before: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """The number of different shingles in each run of many windows, all runs in order of place, or only of those shingles that
    ``counts`` has. ``before`` is the place of the same shingle further left in its window, -1 without one."""
    n = size - LEAST + 1
    first = np.cumsum(n + 1) - n - 1
    window = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size)
    last = n[window]
    low = np.minimum(np.maximum(before, place - LEAST) + 1, last)
    low = np.maximum(low, 0)
    high = np.maximum(np.minimum(place + 1, last), low)
    if counts is not None:
        window, low, high = window[counts], low[counts], high[counts]
    slots = int((n + 1).sum())
    total = np.cumsum(np.bincount(first[window] + low, minlength=slots) - np.bincount(first[window] + high, minlength=slots))
    inside = np.ones(slots, dtype=bool)
    inside[first + n] = False
    return total[inside]


def _repeats(order: np.ndarray, same: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Place of the same shingle further left in its window, -1 without one: of all places in an ``order`` in which equal
    shingles stand together, and which of them are the ``same`` as the one before."""
    window = np.repeat(np.arange(len(size)), size)
    begin = np.cumsum(size) - size
    again = np.flatnonzero(same & (window[order[1:]] == window[order[:-1]]))
    before = np.full(len(order), -1)
    before[order[again + 1]] = order[again] - begin[window[order[again]]]
    return before


def _presence(contents: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which windows hold each shingle that several have, and the line of each shingle there; the last line is empty."""
    sizes = np.array([len(x) for x in contents])
    values, line, count = np.unique(np.concatenate(contents), return_inverse=True, return_counts=True)
    several = np.flatnonzero(count > 1)
    order = np.full(len(values), len(several))
    order[several] = np.arange(len(several))
    line = order[line]
    present = np.zeros((len(several) + 1, len(contents)), dtype=np.uint8)
    present[line, np.repeat(np.arange(len(sizes)), sizes)] = 1
    present[-1] = 0
    return present, np.split(line, np.cumsum(sizes)[:-1])


def _overlaps(present: np.ndarray) -> np.ndarray:
    """The number of shingles that every two windows share."""
    total = np.zeros((present.shape[1], present.shape[1]), dtype=np.float32)
    for at in range(0, len(present), COLUMNS):
        part = present[at : at + COLUMNS].astype(np.float32)
        total += part.T @ part
    return total


def _block_matches(table: pa.Table) -> list[tuple]:
    """Passages of two blocks of windows with one signature, each with a source in a document further up in the order.

    A window goes through the sources until no start is open, ``CHUNK`` windows and sources at a time.
    """
    result: list[tuple] = []
    for at in range(0, table.num_rows, CHUNK):
        own = table.slice(at, CHUNK)
        mask = own.column("open").to_numpy().copy()
        for before in range(0, at, CHUNK):
            if mask.any():
                _chunk_matches(pa.concat_tables([table.slice(before, CHUNK), own]), np.append(np.zeros(CHUNK, np.int64), mask), CHUNK, result, mask)
        _chunk_matches(own, mask, 0, result, mask)
    return result


def _chunk_matches(table: pa.Table, mask: np.ndarray, sources: int, result: list[tuple], left: np.ndarray) -> None:
    """Note what windows have from the first ``sources`` ones, or from any if there are none such, and which of their starts
    are ``left`` open. A source is looked at if it has enough shingles of one of the runs that are still open."""
    row, start = (table.column(name).to_numpy().astype(np.int64) for name in ("row", "start"))
    block = table.column("block").to_numpy()
    if row.min() == row.max() or not mask.any():
        return
    contents = [np.frombuffer(x, dtype="<u4") for x in table.column("content").to_pylist()]
    size = np.array([len(x) for x in contents])
    flat = np.concatenate(contents)
    code = (np.repeat(np.arange(len(size)), size).astype(np.uint64) << np.uint64(32)) | flat
    order = np.argsort(code, kind="stable")
    before = _repeats(order, code[order][1:] == code[order][:-1], size)
    distinct = _of_runs(size, before)
    run_ends = np.cumsum(size - LEAST + 1)
    least = np.minimum.reduceat(distinct, run_ends - (size - LEAST + 1))
    begin = np.cumsum(size) - size
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    present, lines = _presence(contents)
    # Runs of m and n different shingles that are alike share SIMILAR / (1 + SIMILAR) * (m + n) or more, and so do their windows.
    possible = _overlaps(present) >= SIMILAR / (1 + SIMILAR) * (least[:, None] + least) - 1e-3
    possible &= row < row[:, None]
    if low != high:
        possible &= block != block[:, None]
    if sources:
        possible[:, sources:] = False
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i in np.flatnonzero((mask != 0) & possible.any(axis=1)).tolist():
        x = contents[i]
        open_ = _open_starts(mask[i], len(x))
        others = np.flatnonzero(possible[i])
        a, b = _counting(np.arange(len(x)), before[begin[i] : begin[i] + len(x)], len(open_))
        at = np.arange(len(open_))[:, None]
        held = ((a <= at) & (at < b)).astype(np.float32) @ present[lines[i][:, None], others].astype(np.float32)
        own = distinct[run_ends[i] - len(open_) : run_ends[i], None]
        enough = held >= np.maximum(SIMILAR * own, SIMILAR / (1 + SIMILAR) * (own + least[others])) - 1e-3
        next_ = 0
        while open_.any():
            candidates = np.flatnonzero(enough[open_, next_:].any(axis=0))
            if not len(candidates):
                break
            for candidate in candidates.tolist():
                j = others[next_ + candidate]
                if found := alike(x, contents[j], open_, SIMILAR / (1 + SIMILAR) * (least[i] + least[j]) - 1e-3):
                    break
            _take_over(result, open_, found, row, start, i, j)
            next_ += candidate + 1
        left[i - sources] = np.bitwise_or.reduce(bits[: len(open_)][open_], initial=np.uint64(0)).view(np.int64)


def _few_matches(table: pa.Table, first: np.ndarray) -> list[tuple]:
    """What ``_block_matches`` finds in each of many small lists, that begin at ``first``: the shingles that windows of a list
    share are counted for all lists at once."""
    row, start, mask = (table.column(name).to_numpy().astype(np.int64) for name in ("row", "start", "open"))
    contents = [np.frombuffer(x, dtype="<u4") for x in table.column("content").to_pylist()]
    m = np.diff(np.append(first, len(row)))
    list_ = np.repeat(np.arange(len(m)), m)
    window = np.repeat(np.arange(len(row)), [len(x) for x in contents])
    spot = np.concatenate([np.arange(len(x)) for x in contents])
    code = (list_[window].astype(np.uint64) << np.uint64(32)) | np.concatenate(contents)
    order = np.argsort(code, kind="stable")  # of equal shingles of a list, those of the first window first
    code, window, spot = code[order], window[order], spot[order]
    again = np.append(False, (code[1:] == code[:-1]) & (window[1:] == window[:-1]))
    repeats = np.zeros(len(row), dtype=bool)
    repeats[window[again]] = True
    size = np.array([len(x) for x in contents])
    runs_of = size - LEAST + 1
    least = np.minimum.reduceat(_of_runs(size, _repeats(order, code[1:] == code[:-1], size)), np.cumsum(runs_of) - runs_of)
    code, window, spot = code[~again], window[~again], spot[~again]

    # A place per list and two of its windows, with the number of shingles they share.
    place = np.cumsum(m * m) - m * m
    shared = np.zeros(int((m * m).sum()), dtype=np.int64)

    def meetings() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A shingle of a window and the place of that window and an earlier one that has it too."""
        at, step = np.arange(len(code)), 0
        while len(at):
            step += 1
            at = at[at + step < len(code)]
            at = at[code[at + step] == code[at]]
            i, j = window[at + step], window[at]
            yield at + step, place[list_[i]] + (i - first[list_[i]]) * m[list_[i]] + j - first[list_[i]]
    for _, met in meetings():
        shared += np.bincount(met, minlength=len(shared))
    some = np.flatnonzero(shared)
    own = np.searchsorted(place, some, side="right") - 1
    i, j = first[own] + (some - place[own]) // m[own], first[own] + (some - place[own]) % m[own]
    bound = SIMILAR / (1 + SIMILAR) * (least[i] + least[j]) - 1e-3
    possible = (shared[some] >= bound) & (row[j] < row[i]) & (mask[i] != 0)
    some, i, j, bound = some[possible], i[possible], j[possible], bound[possible]

    # The runs of a window that hold enough shingles of the other; where shingles repeat in it, all may.
    pair = np.full(len(shared), -1)
    pair[some] = np.arange(len(some))
    held = np.zeros((len(some), size.max() + 1), dtype=np.int16)
    for at, met in meetings():
        at, met = at[pair[met] >= 0], met[pair[met] >= 0]
        held[pair[met], spot[at] + 1] = 1
    np.cumsum(held, axis=1, out=held)
    starts = np.arange(held.shape[1] - LEAST)
    enough = (held[:, LEAST:] - held[:, :-LEAST] >= bound[:, None]) | repeats[i][:, None]
    enough &= mask[i].view(np.uint64)[:, None] >> np.minimum(starts, 63).astype(np.uint64) & np.uint64(1) > 0
    result: list[tuple] = []
    last = -1
    for at in np.flatnonzero(enough.any(axis=1)).tolist():
        a, b = int(i[at]), int(j[at])
        if a != last:
            open_, last = _open_starts(mask[a], len(contents[a])), a
        if (enough[at, : len(open_)] & open_).any():
            _take_over(result, open_, alike(contents[a], contents[b], open_, bound[at]), row, start, a, b)
    return result


def _open_starts(mask: np.int64, size: int) -> np.ndarray:
    return (np.array([mask]).view(np.uint64) >> np.arange(size - LEAST + 1, dtype=np.uint64) & np.uint64(1)).astype(bool)


def _take_over(result: list[tuple], open_: np.ndarray, found: list[tuple], row: np.ndarray, start: np.ndarray, i: int, j: int) -> None:
    """Note the passages that window ``i`` has from window ``j``; starts that lie in them by four fifths are no longer open."""
    s = np.arange(len(open_))
    for a, b, c, d, score in found:
        result.append((int(row[i]), int(start[i] + a), b - a, int(row[j]), int(start[j] + c), score))
        open_ &= np.minimum(b, s + LEAST) - np.maximum(a, s) < SIMILAR * LEAST


def _whole_lists(batches: Iterator[pa.RecordBatch], groups: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole lists, of about ``ROWS`` rows unless a list has more, and where each list begins."""
    held: list[pa.RecordBatch] = []

    def cut() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(max(0, table.num_rows - 1), dtype=bool)
        for group in groups:
            column = table.column(group).to_numpy()
            change |= column[1:] != column[:-1]
        return table, np.append(0, np.flatnonzero(change) + 1)

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= ROWS:
            table, first = cut()
            if len(first) > 1:
                yield table.slice(0, first[-1]), first[:-1]
            held = table.slice(first[-1]).to_batches()  # the last list may go on
            size = 0
    if held:
        yield cut()


def _thinned(table: pa.Table, first: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """The lists less windows without a run that could be alike one of another row, and less lists without such a run that is
    open.

    Runs of m and n different shingles that are alike share ``SIMILAR`` of each and ``SIMILAR / (1 + SIMILAR) * (m + n)``. So many
    of a run must stand in other rows of the list.
    """
    size = pc.binary_length(table.column("content")).to_numpy().astype(np.int64) // 4
    flat = np.frombuffer(b"".join(table.column("content").to_pylist()), dtype="<u4")
    m = np.diff(np.append(first, table.num_rows))
    list_, window = np.repeat(np.arange(len(m)), m), np.repeat(np.arange(len(size)), size)
    # Equal shingles of a list next to each other, in order of place: the place takes the low bits of a hash.
    bits = np.uint64(len(flat).bit_length())
    code = mixed((list_[window].astype(np.uint64) << np.uint64(32)) | flat) >> bits << bits
    code |= np.arange(len(flat), dtype=np.uint64)
    code.sort()
    place = (code & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
    code >>= bits
    same, own = code[1:] == code[:-1], window[place]
    opens = np.flatnonzero(np.append(True, ~same))
    count = np.diff(np.append(opens, len(code)))
    row = table.column("row").to_numpy()
    elsewhere = np.zeros(len(flat), dtype=bool)
    elsewhere[place] = np.repeat(row[own[opens]] != row[own[opens + count - 1]], count)
    before = _repeats(place, same, size)
    distinct, shared = _of_runs(size, before), _of_runs(size, before, elsewhere)

    n = size - LEAST + 1
    at = np.cumsum(n) - n
    fewest = np.minimum.reduceat(np.minimum.reduceat(distinct, at), first)
    window = np.repeat(np.arange(len(size)), n)
    enough = shared >= np.maximum(SIMILAR * distinct, SIMILAR / (1 + SIMILAR) * (distinct + fewest[list_[window]])) - 1e-3
    bit = (np.arange(len(window)) - at[window]).astype(np.uint64)
    open_ = table.column("open").to_numpy().view(np.uint64)[window] >> bit & np.uint64(1) > 0
    wanted = np.bincount(list_, np.logical_or.reduceat(enough & open_, at)) > 0
    keep = np.logical_or.reduceat(enough, at) & wanted[list_]
    m = np.bincount(list_[keep], minlength=len(m))
    m = m[m > 0]
    return table.filter(pa.array(keep)), np.cumsum(m) - m


def _matches(groups: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in FOUND.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64()]
        for table, first in _whole_lists(batches, groups):
            table, first = _thinned(table, first)
            if not table.num_rows:
                continue
            found: list[tuple] = []
            m = np.diff(np.append(first, table.num_rows))
            few = m <= SMALL
            few &= table.column("low").to_numpy()[first] == table.column("high").to_numpy()[first]
            for at, n in zip(first[~few].tolist(), m[~few].tolist()):
                found += _block_matches(table.slice(at, n))
            if few.any():
                small = table.filter(pa.array(np.repeat(few, m)))
                found += _few_matches(small, np.cumsum(m[few]) - m[few])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), kinds)], names)
    return run


# ---- the job ----


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, row)``; ``row`` is a hash of both: equal rows are one, equal ids with different texts are not."""
    rows = exact(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("row", row_key(F.col("doc_id"), F.col("text")))


def equal_passages(rows: DataFrame) -> DataFrame:
    """Passages of equal runs: of each run that stands in several documents, one keeps it and is the others' source."""
    text = rows.select("row", "text")
    bloom = bloom_filter(_shared(arrow_map(text, _first_keys, SIGNED), "first_keys").select("key"))
    found = stored(arrow_map(text, _equal_runs(bloom), RUNS), "runs")
    firsts = found.filter("lead IS NULL").select("run", "row", "start")
    firsts = arrow_map(firsts.repartition("run").sortWithinPartitions("run", "row", "start"), _first_of_all, RUNS)
    pairs = found.filter("lead IS NOT NULL").unionByName(firsts).select("row", "start", "lead", "lead_start")
    equal = stored(arrow_map(pairs.repartition("row").sortWithinPartitions("row", "start", "lead", "lead_start"), _joined_runs, FOUND), "equal")
    drop_stored(found)
    return equal


def alike_passages(rows: DataFrame, equal: DataFrame) -> DataFrame:
    """Passages of runs that are alike, among the runs that have no equal source.

    The first functions find nearly all; what lies in a passage that they found is not looked for under the others.
    """
    spans = equal.select("row", "start", "n", F.lit(True).alias("equal"))
    text = stored(_with_spans(rows.select("row", "text"), spans), "texts")
    first = _alike_under(text, range(EARLY))
    spans = first.select("row", "start", "n", F.lit(False).alias("equal"))
    more = _with_spans(text.withColumnRenamed("spans", "earlier"), spans)
    none = F.array().cast(more.schema["spans"].dataType)
    more = more.select("row", "text", F.concat(F.coalesce("earlier", none), F.coalesce("spans", none)).alias("spans"))
    more = stored(more, "texts")
    drop_stored(text)
    second = _alike_under(more, range(EARLY, FUNCTIONS))
    drop_stored(more)
    return first.unionByName(second)


def _with_spans(text: DataFrame, spans: DataFrame) -> DataFrame:
    """The small side is hashed, so that texts need no sorting."""
    spans = spans.groupBy("row").agg(F.collect_set(F.struct("start", "n", "equal")).alias("spans"))
    return text.join(spans.hint("shuffle_hash"), "row", "left")


def _alike_under(text: DataFrame, functions: range) -> DataFrame:
    """Passages of runs that are alike and agree in one of some min-hash functions."""
    keys = _shared(arrow_map(text, _left_keys(functions), SIGNED), "left_keys")
    frequent = stored(keys.filter(F.col("m") > BLOCK).select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "frequent")
    # The content of a window is dealt once: the windows of rare keys, nearly all, need no join.
    left = arrow_map(text, _left_windows(bloom_filter(keys.select("key")), functions), WINDOWS)
    dealt = left.join(frequent, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row", "start"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    groups = ["key", "low", "high"]
    dealt = dealt.repartition(*groups).sortWithinPartitions(*groups, "row", "start")
    return stored(arrow_map(dealt, _matches(groups), FOUND).distinct(), "alike")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, start, n_words, source_doc_id, source_start, similarity, row)``: a passage and its partner elsewhere.

    Every run of 50 words that stands in several documents is in a row for each of them but one, which is its source. Other
    runs of 50 words with a shingle similarity of at least 0.8 are compared if they agree in one of ``FUNCTIONS``
    min-hashes (``MISSED``), all with all; what lies by four fifths in a passage that is reported is not looked at again. So
    a passage is reported with one source per part, not with all others, and its edges reach as far as it and that source
    agree. Sources come before the passages that point to them in one fixed order: chains end in a document that keeps its
    copy. ``start`` and ``n_words`` count lower-cased words between white space. Null, empty and short texts have no
    passages; rows with equal id and text count once; other columns are not read.
    """
    rows = keyed_rows(docs)
    equal = equal_passages(rows)
    found = equal.unionByName(alike_passages(rows, equal))
    known = rows.select("row", "doc_id").dropDuplicates(["row"])
    named = found.join(known, "row").join(known.select(F.col("row").alias("lead"), F.col("doc_id").alias("source_doc_id")), "lead")
    return named.select("doc_id", "start", (F.col("n") + SIZE - 1).alias("n_words"), "source_doc_id",
                        F.col("lead_start").alias("source_start"), "similarity", "row").distinct()


def cut_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated passage cut out of all documents but its source, and ``n_chars`` brought up to date.

    White space after a cut passage goes with it. Documents that have no word left are dropped; those without a repeated
    passage stay as they are, null texts included. All columns stay, also such as differ by case alone.
    """
    names = docs.columns
    at = {name: names.index(name) for name in ("doc_id", "text", "n_chars")}
    plain = numbered(docs)
    spans = repeated_passages(docs).groupBy("row").agg(F.collect_set(F.struct("start", "n_words")).alias("spans"))
    keyed = plain.withColumn("row", row_key(F.col(f"_c{at['doc_id']}").cast("long"), F.coalesce(f"_c{at['text']}", F.lit(""))))
    joined = keyed.join(spans, "row", "left").drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            cut = [i for i, spans in enumerate(columns.pop().to_pylist()) if spans]
            if cut:
                texts, sizes = columns[at["text"]].to_pylist(), columns[at["n_chars"]].to_pylist()
                for i, spans in zip(cut, batch.column("spans").take(pa.array(cut)).to_pylist()):
                    texts[i] = without(texts[i].encode(), [(x["start"], x["n_words"]) for x in spans]).decode()
                    sizes[i] = len(texts[i])
                columns[at["text"]] = pa.array(texts, columns[at["text"]].type)
                columns[at["n_chars"]] = pa.array(sizes, columns[at["n_chars"]].type)
            made = pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])
            if empty := {i for i in cut if not texts[i].split()}:
                made = made.take(pa.array([i for i in range(made.num_rows) if i not in empty], pa.int64()))
            yield made
    return arrow_map(joined, run, plain.schema).toDF(*names)


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text less runs of words, each ``(first word, number)``."""
    _, _, first, end = words([text])
    keep = np.ones(len(first), dtype=bool)
    for start, number in spans:
        keep[start : start + number] = False
    parts, place = [], 0
    edge = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        parts.append(text[place : first[a]])
        place = int(first[b]) if b < len(first) else len(text)
    return b"".join([*parts, text[place:]])
