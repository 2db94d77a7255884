"""Plain-Python definitions of the analyses, for graphs of a few vertices."""

from collections import deque


def vertices(edges):
    return sorted({v for edge in edges for v in edge})


def successors(edges):
    result = {v: set() for v in vertices(edges)}
    for a, b in edges:
        if a != b:
            result[a].add(b)
    return result


def distances(edges):
    nexts = successors(edges)
    result = {}
    for root in nexts:
        result[root, root] = 0
        queue = deque([root])
        while queue:
            v = queue.popleft()
            for w in nexts[v]:
                if (root, w) not in result:
                    result[root, w] = result[root, v] + 1
                    queue.append(w)
    return result


def components(edges):
    return {v: min(u for (u, w) in distances([*edges, *[(b, a) for a, b in edges]]) if w == v) for v in vertices(edges)}


def strong_components(edges):
    reach = distances(edges)
    return {v: min(u for u in vertices(edges) if (u, v) in reach and (v, u) in reach) for v in vertices(edges)}


def triangles(edges):
    near = successors([*edges, *[(b, a) for a, b in edges]])
    return {v: sum(1 for a in near[v] for b in near[v] if a < b and b in near[a]) for v in near}


def closeness(edges):
    reach = distances(edges)
    result = {}
    for v in vertices(edges):
        hops = [d for (s, _), d in reach.items() if s == v]
        result[v] = len(hops) / sum(hops) if sum(hops) else 0.0
    return result


def shortest_paths(edges):
    nexts = successors(edges)
    reach = distances(edges)
    result = []

    def walk(path, target):
        if path[-1] == target:
            result.append(tuple(path))
            return
        for w in nexts[path[-1]]:
            if reach.get((w, target), -9) == reach[path[-1], target] - 1:
                walk([*path, w], target)

    for (s, t), d in reach.items():
        if d:
            walk([s], t)
    return result


def betweenness(edges):
    by_pair = {}
    for path in shortest_paths(edges):
        by_pair.setdefault((path[0], path[-1]), []).append(path)
    result = dict.fromkeys(vertices(edges), 0.0)
    for paths in by_pair.values():
        for path in paths:
            for v in path[1:-1]:
                result[v] += 1 / len(paths)
    return result


def edge_centrality(edges):
    simple = sorted(set(edges))
    lines = [(e, f) for e in simple for f in simple if e[1] == f[0]]
    return betweenness(lines)


def communities(edges, removals):
    rest = set(edges)
    steps = []
    while len(steps) < removals:
        scores = edge_centrality(rest)
        if not scores:
            break
        best = min(scores, key=lambda e: (-round(scores[e], 9), e))
        steps.append(best)
        rest.remove(best)
    parts = components([*rest, *[(v, v) for v in vertices(edges)]])
    return steps, parts


def pagerank(edges, rounds):
    out = {v: sum(1 for a, _ in edges if a == v) for v in vertices(edges)}
    rank = dict.fromkeys(out, 0.15)
    for _ in range(rounds):
        rank = {v: 0.15 + 0.85 * sum(rank[a] / out[a] for a, b in edges if b == v) for v in out}
    return rank
