"""Searches over packed graphs (``functions.packs``), in numpy: what one task does with graphs that it holds whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from vertexloom.functions.packs import Pack

STATE_WORDS = 1 << 20  # bits of a search in words of 64: a few arrays of this length stay near the processor
STATE_CELLS = 1 << 20  # vertices times columns of a search that counts paths
STEP_EDGES = 1 << 22  # edges times columns of a search that counts paths, which it keeps for the way back
BATCH = 1 << 18  # rows in a batch of results
SLOTS = 64  # edges of a vertex that are met one by one for all vertices; further ones of a hub are met together


class Bits:
    """Breadth-first search from many roots, a bit each: a vertex takes up the bits of those its edges lead to."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, vertices: int) -> None:
        degree = np.bincount(src, minlength=vertices)
        self.order = np.argsort(-degree, kind="stable")  # number by falling degree
        place = np.empty(vertices, np.int64)
        place[self.order] = np.arange(vertices)
        self.place = place
        moved = place[src]
        by_place = np.argsort(moved, kind="stable")
        self.src, self.dst = moved[by_place], place[dst][by_place]
        degree = degree[self.order]
        start = np.cumsum(degree) - degree
        many = np.searchsorted(-degree, -np.arange(SLOTS), side="left")  # vertices with an edge in the slot
        self.slots = [self.dst[start[: many[slot]] + slot] for slot in range(SLOTS) if many[slot]]
        self.further = np.flatnonzero(np.arange(len(self.src)) - start[self.src] >= SLOTS)

    def _ored(self, edges: np.ndarray, at: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sources of ``edges`` (in order) with the bits at all far ends; ``at`` says where a vertex has its bits."""
        src = self.src[edges]
        heads = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
        return src[heads], np.bitwise_or.reduceat(bits[at[self.dst[edges]]], heads, axis=0)

    def _all(self, edges: np.ndarray, at: np.ndarray, bits: np.ndarray, reached: np.ndarray) -> None:
        step = max(1, STATE_WORDS // bits.shape[1])
        for start in range(0, len(edges), step):
            rows, ored = self._ored(edges[start : start + step], at, bits)
            reached[rows] |= ored

    def levels(
        self, roots: np.ndarray, column: np.ndarray, words: int, columns: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For 1, 2, ... hops the vertices that meet new roots, the bits and the number of those. ``columns`` says how many
        roots there are for each vertex: one that has met all is left out."""
        vertices = len(self.order)
        seen = np.zeros((vertices, words), np.uint64)
        seen[self.place[roots], column >> 6] = np.uint64(1) << (column & 63).astype(np.uint64)
        missing = columns[self.order].copy()
        rows = np.sort(self.place[roots])
        missing[rows] -= 1
        bits, at, every = seen[rows], np.zeros(vertices, np.int64), np.arange(vertices)
        step = max(1, STATE_WORDS // 8 // words)
        while len(rows):
            at[:] = -1
            at[rows] = np.arange(len(rows))
            edges = np.flatnonzero((at[self.dst] >= 0) & (missing[self.src] > 0))
            if not len(edges):
                return
            if len(edges) * 4 < len(self.dst):
                if len(edges) * words <= 4 * STATE_WORDS:
                    rows, fresh = self._ored(edges, at, bits)
                else:
                    rows, fresh = every, np.zeros_like(seen)
                    self._all(edges, at, bits, fresh)
            else:
                new = np.zeros_like(seen)
                new[rows] = bits
                rows, fresh = every, np.zeros_like(seen)
                for far in self.slots:
                    for start in range(0, len(far), step):
                        fresh[start : min(start + step, len(far))] |= new.take(far[start : start + step], axis=0)
                if len(self.further):
                    self._all(self.further, every, new, fresh)
            fresh &= ~(seen if rows is every else seen[rows])
            many = np.bitwise_count(fresh).sum(axis=1, dtype=np.int64)
            kept = np.flatnonzero(many)
            rows, bits, many = rows[kept], fresh[kept], many[kept]
            seen[rows] |= bits
            missing[rows] -= many
            if len(rows):
                yield self.order[rows], bits, many


def _bit_ranges(
    pack: Pack, low: int, high: int
) -> Iterator[tuple[int, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """The searches for the columns of a range: first column, levels."""
    at, bits, held = low, None, -1
    while at < high:
        vertices, edges = pack.wider(at)
        if held != vertices:
            bits, held = Bits(pack.src[:edges], pack.dst[:edges], vertices), vertices
        words = max(1, min(-(-(high - at) // 64), STATE_WORDS // vertices))
        upto = min(high, at + 64 * words)
        columns = np.clip(pack.sizes[pack.graph[:vertices]] - at, 0, upto - at)
        yield at, bits.levels(*pack.roots(at, upto), words, columns)
        at = upto


def closeness_sums(pack: Pack, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """``(groups, id, n, total)``: how many of the roots a vertex reaches, itself not counted, and the sum of distances."""
    n, total = (np.zeros(len(pack.graph), np.int64) for _ in range(2))
    for _, levels in _bit_ranges(pack, low, high):
        for hops, (vertices, _, many) in enumerate(levels, 1):
            n[vertices] += many
            total[vertices] += hops * many
    yield from _rows_of(pack, np.flatnonzero(n), n=n, total=total)


def _rows_of(pack: Pack, at: np.ndarray, **values: np.ndarray) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(at), BATCH):
        part = at[start : start + BATCH]
        yield pack.rows(part, **{name: pa.array(value[part]) for name, value in values.items()})


def distances(pack: Pack, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """``(groups, src, dst, distance)``, distances of 1 and more to the roots."""
    *groups, ids = pack.columns.values()
    names = [*list(pack.columns)[:-1], "src", "dst", "distance"]
    for at, levels in _bit_ranges(pack, low, high):
        for hops, (vertices, bits, many) in enumerate(levels, 1):
            first, upto = pack.first[pack.graph[vertices]] + at, np.cumsum(many)
            start = 0
            while start < len(vertices):
                # as many vertices as make a batch, and whose bits make no more cells than some batches
                end = int(np.searchsorted(upto, BATCH + (upto[start - 1] if start else 0), side="right"))
                end = max(start + 1, min(end, start + 16 * BATCH // (64 * bits.shape[1])))
                part = slice(start, end)
                set_bits = np.flatnonzero(np.unpackbits(bits[part].view(np.uint8), bitorder="little").view(bool))
                from_row = first[part] - np.arange(end - start) * (64 * bits.shape[1])
                src = pa.array(np.repeat(vertices[part], many[part]))
                dst = pa.array(set_bits + np.repeat(from_row, many[part]))
                hop = pa.array(np.full(len(src), hops, np.int32))
                yield pa.RecordBatch.from_arrays([*[group.take(src) for group in groups], ids.take(src), ids.take(dst), hop], names)
                start = end


class Counts:
    """Breadth-first search from many roots that keeps the edges that lead one level on, by cells: vertex times the number
    of columns plus column."""

    def __init__(self, start: np.ndarray, dst: np.ndarray, vertices: int, columns: int) -> None:
        self.start, self.dst, self.vertices, self.columns = start, dst, vertices, columns

    def onward(self, vertex: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges from the vertices: which of the given ones each leaves, its number, the cell it enters."""
        many = self.start[vertex + 1] - self.start[vertex]
        of = np.repeat(np.arange(len(vertex)), many)
        edge = np.arange(len(of)) + np.repeat(self.start[vertex] - (np.cumsum(many) - many), many)
        return of, edge, self.dst[edge] * self.columns + column[of]

    def search(self, roots: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]:
        """Hops (-1: not reached) and numbers of shortest paths by cell, and per level the edges on them: from cell, to
        cell, number."""
        cells = self.vertices * self.columns
        hops, paths, last = np.full(cells, -1, np.int32), np.zeros(cells), np.empty(cells, np.int32)
        here, vertex = roots * self.columns + column, roots
        hops[here], paths[here] = 0, 1.0
        steps = []
        while len(here):
            of, edge, to = self.onward(vertex, column)
            fresh = np.flatnonzero(hops[to] < 0)
            to, edge, of = to[fresh], edge[fresh], of[fresh]
            if not len(to):
                break
            begin = here[of]
            np.add.at(paths, to, paths[begin])
            hops[to] = len(steps) + 1
            steps.append((begin, to, edge))
            number = np.arange(len(to), dtype=np.int32)
            last[to] = number
            once = np.flatnonzero(last[to] == number)  # each cell that was entered, once
            here = to[once]
            vertex, column = self.dst[edge[once]], column[of[once]]
        return hops, paths, steps


def _count_ranges(pack: Pack, low: int, high: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Counts]]:
    """The searches for the columns of a range: first column and end, edges as they are and without self-loops (numbers), search."""
    at, held = low, -1
    while at < high:
        vertices, edges = pack.wider(at)
        if held != vertices:
            src, dst = pack.src[:edges], pack.dst[:edges].astype(np.int64)
            simple = np.flatnonzero(src != dst)
            start = np.searchsorted(src[simple], np.arange(vertices + 1))
            held = vertices
        columns = max(1, min(high - at, STATE_CELLS // vertices, STEP_EDGES // max(1, edges)))
        yield at, at + columns, simple, Counts(start, dst[simple], vertices, columns)
        at += columns


def betweenness_sums(pack: Pack, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """``(groups, id, score)``: the shares that inner vertices have in the shortest paths from the roots (Brandes 2001)."""
    score = np.zeros(len(pack.graph))
    for at, upto, _, counts in _count_ranges(pack, low, high):
        roots, column = pack.roots(at, upto)
        _, paths, steps = counts.search(roots, column)
        behind = np.zeros(len(paths))
        for begin, to, _ in reversed(steps):
            np.add.at(behind, begin, paths[begin] * ((1.0 + behind[to]) / paths[to]))
        behind[roots * counts.columns + column] = 0.0
        score[: counts.vertices] += behind.reshape(counts.vertices, -1).sum(axis=1)
    yield from _rows_of(pack, np.flatnonzero(score), score=score)


def edge_scores(pack: Pack, low: int, high: int) -> np.ndarray:
    """Per edge the shares in shortest paths from the roots; a pair of ends (s, t) weighs what ``edge_centrality`` says."""
    score = np.zeros(len(pack.src))
    into = np.bincount(pack.dst, minlength=len(pack.graph)).astype(float)
    out_of = np.bincount(pack.src, minlength=len(pack.graph)).astype(float)
    number = pack.dst - pack.first[pack.graph[pack.dst]]  # column of the vertex that an edge enters, as a root
    for at, upto, simple, counts in _count_ranges(pack, low, high):
        roots, column = pack.roots(at, upto)
        wanted = into[roots] > 0
        roots, column = roots[wanted], column[wanted]
        _, paths, steps = counts.search(roots, column)
        scale = np.zeros((len(pack.sizes), counts.columns))
        scale[pack.graph[roots], column] = into[roots]
        weight = scale[pack.graph[: counts.vertices]] * out_of[: counts.vertices, None]
        closing = np.flatnonzero((number >= at) & (number < upto))
        weight[pack.src[closing], number[closing] - at] -= 1.0
        behind, weight = np.zeros(len(paths)), weight.ravel()
        for begin, to, edge in reversed(steps):
            share = paths[begin] * ((weight[to] + behind[to]) / paths[to])
            np.add.at(behind, begin, share)
            np.add.at(score, simple[edge], share)
    return score


def edge_sums(pack: Pack, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """``(groups, src, dst, score)`` of ``edge_scores``."""
    yield from _edge_rows(pack, edge_scores(pack, low, high))


def _edge_rows(pack: Pack, score: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(score)
    for start in range(0, len(at), BATCH):
        part = at[start : start + BATCH]
        yield pack.pairs(pack.src[part], pack.dst[part], score=pa.array(score[part]))


def paths_between(pack: Pack, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """``(groups, src, dst, distance, path)``: all shortest paths from the roots.

    The start of a shortest path is one itself, so every row that is made on the way is a row of the result. What is
    still to be led on is kept as a stack of blocks of bounded size, the longest paths on top.
    """
    ids = pack.columns["id"]
    for at, upto, _, counts in _count_ranges(pack, low, high):
        roots, column = pack.roots(at, upto)
        hops, _, _ = counts.search(roots, column)
        stack = [(roots[:, None].astype(np.int32), column)]
        while stack:
            paths, column = stack.pop()
            length = paths.shape[1]
            many = counts.start[paths[:, -1] + 1] - counts.start[paths[:, -1]]
            full = int(np.searchsorted(np.cumsum(many), max(1, 2 * BATCH // length), side="right"))
            if 0 < full < len(paths):
                stack.append((paths[full:], column[full:]))
                paths, column = paths[:full], column[:full]
            elif full == 0 and len(paths) > 1:
                stack.append((paths[1:], column[1:]))
                paths, column = paths[:1], column[:1]
            of, edge, to = counts.onward(paths[:, -1], column)
            on = np.flatnonzero(hops[to] == length)
            if not len(on):
                continue
            of = of[on]
            longer = np.empty((len(on), length + 1), np.int32)
            longer[:, :length] = paths[of]
            longer[:, length] = counts.dst[edge[on]]
            column = column[of]
            ends = pa.array(np.arange(len(on) + 1, dtype=np.int32) * (length + 1))
            listed = pa.ListArray.from_arrays(ends, ids.take(pa.array(longer.ravel())))
            distance = pa.array(np.full(len(on), length, np.int32))
            yield pack.pairs(longer[:, 0], longer[:, length], distance=distance, path=listed)
            stack.append((longer, column))


def weak_components(src: np.ndarray, dst: np.ndarray, vertices: int) -> np.ndarray:
    """The lowest number that each vertex is connected with, direction ignored."""
    label = np.arange(vertices)
    while len(src):
        low = label.copy()
        np.minimum.at(low, label[src], label[dst])
        np.minimum.at(low, label[dst], label[src])
        while True:  # a label that has got a lower one hands it on to all that have it
            shorter = low[low]
            if np.array_equal(shorter, low):
                break
            low = shorter
        if np.array_equal(low, label):
            break
        label = low
    return label


def _component_scores(src: np.ndarray, dst: np.ndarray, component: np.ndarray) -> np.ndarray:
    """``edge_scores`` of edges with each weak component as a graph of its own."""
    vertices, number = np.unique(np.concatenate([src, dst]), return_inverse=True)
    sizes = np.bincount(component[vertices], minlength=len(component))[component[vertices]]
    order = np.lexsort((vertices, component[vertices], -sizes))
    place = np.empty(len(vertices), np.int64)
    place[order] = np.arange(len(vertices))
    src, dst = place[number[: len(src)]], place[number[len(src) :]]
    sort = np.lexsort((dst, src))
    own = component[vertices[order]]
    first = np.concatenate([np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), [len(own)]])
    pack = Pack(src[sort].astype(np.int32), dst[sort].astype(np.int32), first, {})
    score = np.empty(len(src))
    score[sort] = edge_scores(pack, 0, int(pack.sizes.max()))
    return score


def edge_removals(max_removals: int | None, target_components: int | None, pack: Pack, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """``(groups, step, src, dst, score)``: the removals of ``edge_removal_communities`` for all graphs of a pack, a step of all
    in one go, and rows of step 0 with each vertex and its community."""
    graph, graphs = pack.graph, len(pack.sizes)
    alive = np.ones(len(pack.src), bool)
    component = weak_components(pack.src, pack.dst, len(graph))
    parts = np.bincount(graph[component == np.arange(len(graph))], minlength=graphs)
    score = np.zeros(len(pack.src))
    going = np.ones(graphs, bool)
    touched = np.ones(len(graph), bool)  # vertices of components whose edges are to be scored
    step, removed = 0, []
    while max_removals is None or step < max_removals:
        if target_components is not None:
            going &= parts < target_components
        anew = np.flatnonzero(alive & touched[pack.src] & going[graph[pack.src]])
        if len(anew):
            score[anew] = _component_scores(pack.src[anew], pack.dst[anew], component)
        near = np.flatnonzero(alive & going[graph[pack.src]])
        leaves, enters = (np.bincount(end[near], minlength=len(graph)) for end in (pack.src, pack.dst))
        near = near[(leaves[pack.dst[near]] > 0) | (enters[pack.src[near]] > 0)]  # those that follow or precede one
        of = graph[pack.src[near]]
        # Equal scores may differ in their last bits: rounding restores the tie. Edges are in order of src and dst.
        rounded = np.floor(score[near] * 1e6 + 0.5) / 1e6
        order = np.lexsort((near, -rounded, of))
        best = order[np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]]))] if len(order) else order
        going[:] = False
        going[of[best]] = True
        if not len(best):
            break
        step += 1
        gone = near[best]
        alive[gone] = False
        removed.append((np.full(len(gone), step, np.int32), gone, rounded[best]))
        hit = np.zeros(len(graph), bool)
        hit[component[pack.src[gone]]] = True
        touched = hit[component]
        left = np.flatnonzero(alive & touched[pack.src])
        again = weak_components(pack.src[left], pack.dst[left], len(graph))
        component = np.where(touched, again, component)
        parts = np.bincount(graph[component == np.arange(len(graph))], minlength=graphs)
    for start in range(0, len(graph), BATCH):
        part = np.arange(start, min(start + BATCH, len(graph)))
        rows = pack.pairs(part, component[part], score=pa.array(np.zeros(len(part))))
        yield rows.append_column("step", pa.array(np.zeros(len(part), np.int32)))
    for steps, gone, values in removed:
        for start in range(0, len(gone), BATCH):
            part = slice(start, start + BATCH)
            rows = pack.pairs(pack.src[gone[part]], pack.dst[gone[part]], score=pa.array(values[part]))
            yield rows.append_column("step", pa.array(steps[part]))


def strong_components(pack: Pack, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """``(groups, id, component)``: the lowest id of each strongly connected component (Tarjan 1972, without recursion)."""
    vertices = len(pack.graph)
    start, dst = np.searchsorted(pack.src, np.arange(vertices + 1)).tolist(), pack.dst.tolist()
    number, lowest, component, following = [0] * vertices, [0] * vertices, [-1] * vertices, start[:-1]
    clock, held = 0, []
    for root in range(vertices):
        if number[root]:
            continue
        clock += 1
        number[root] = lowest[root] = clock
        held.append(root)
        way = [root]
        while way:
            vertex = way[-1]
            edge = following[vertex]
            if edge < start[vertex + 1]:
                following[vertex] = edge + 1
                far = dst[edge]
                if not number[far]:
                    clock += 1
                    number[far] = lowest[far] = clock
                    held.append(far)
                    way.append(far)
                elif component[far] < 0 and number[far] < lowest[vertex]:
                    lowest[vertex] = number[far]
                continue
            way.pop()
            if lowest[vertex] == number[vertex]:
                at = len(held) - 1
                while held[at] != vertex:
                    at -= 1
                name = min(held[at:])
                for member in held[at:]:
                    component[member] = name
                del held[at:]
            if way and lowest[vertex] < lowest[way[-1]]:
                lowest[way[-1]] = lowest[vertex]
    names = np.array(component)
    for begin in range(0, vertices, BATCH):
        part = np.arange(begin, min(begin + BATCH, vertices))
        yield pack.rows(part, component=pack.columns["id"].take(pa.array(names[part])))
