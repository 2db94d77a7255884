"""Small graphs with known results."""

# Graphs whose results are known, see test_analyses.py.
PATH = [(0, 1), (1, 2), (2, 3), (3, 4)]
DAG = [(0, 1), (1, 4), (0, 4), (4, 3), (1, 2), (2, 3)]
RING = [
    (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 6), (8, 7), (9, 8), (10, 9), (1, 10),
    (1, 3), (2, 3), (3, 5), (4, 5), (5, 7), (6, 7), (7, 9), (8, 9), (9, 1), (10, 1),
]
CYCLE = [(0, 1), (1, 3), (3, 0)]
DAG13 = [
    (0, 1), (1, 4), (1, 2), (2, 3), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10), (10, 11), (11, 12), (12, 3), (7, 3), (4, 3),
]
TREE = [(0, 1), (0, 2), (2, 3), (3, 4), (4, 5), (4, 6), (4, 7), (7, 8), (7, 9)]
# Our own: a cycle with a dead-end branch, a self-loop, parallel edges and a second component.
MIXED = [(1, 2), (2, 3), (3, 1), (2, 4), (4, 5), (3, 6), (6, 5), (1, 2), (4, 4), (20, 21), (21, 22), (22, 21), (30, 30)]
ALL = {"path": PATH, "dag": DAG, "ring": RING, "cycle": CYCLE, "dag13": DAG13, "tree": TREE, "mixed": MIXED}


def edge_frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def grouped_frame(spark, graphs):
    rows = [(name, a, b) for name, edges in graphs.items() for a, b in edges]
    return spark.createDataFrame(rows, "g string, src long, dst long")


def as_map(df, digits=6):
    rows = [tuple(row) for row in df.collect()]
    result = {row[:-1] if len(row) > 2 else row[0]: row[-1] for row in rows}
    assert len(result) == len(rows)
    return {key: round(value, digits) if isinstance(value, float) else value for key, value in result.items()}
