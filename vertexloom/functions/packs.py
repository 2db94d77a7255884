"""Many graphs in one table, packed so that a task holds whole graphs and searches them in memory.

A pack is one row: one graph, or many small ones that share it. Its vertices are numbered, graphs with most vertices
first; its edges are pairs of numbers. Root number c of every graph of a pack goes into column c of a search, for the
graphs don't touch. A range of columns is a piece of work of its own, so one large graph keeps many tasks busy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.rounds import checkpointed, measure, union_all
from vertexloom.functions.skew import join_spread

PACK_EDGES = 4_000_000  # a graph of more edges is not packed: what a task holds of one stays below some 300 MB
SHARED_EDGES = 65_536  # smaller graphs share packs of about so many edges, or of fewer if that keeps the cores busy
FEWEST_EDGES = 1024
MAX_PIECES = 128  # ranges of columns that a pack is split into
PLAIN = {"tinyint", "smallint", "int", "bigint", "string"}  # types of ids and groups that can be packed
UNIT = "_unit"
PACK = "edges binary, vertices binary, first binary, size long, width long"


def packed(
    edges: DataFrame, groups: Sequence[str] = (), limit: int | None = None
) -> tuple[DataFrame | None, DataFrame | None]:
    """``(packs, rest)``: the graphs of up to ``limit`` edges as packs (see ``Pack``), the edges of the others as they are;
    None for what there is none of. ``edges`` holds ``(groups, src, dst)``, each edge once. Graphs with a null for an end or
    a group are not packed."""
    groups = list(groups)
    limit = PACK_EDGES if limit is None else limit
    edges = edges.select(*groups, "src", "dst")
    if limit <= 0 or not PLAIN.issuperset(kind for _, kind in edges.dtypes):
        return None, edges
    void = [F.col(name).isNull() for name in (*groups, "src", "dst")]
    counts = edges.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.bool_or(reduce(Column.__or__, void)).alias("_void"))
    fits = (F.col("_n") <= limit) & ~F.col("_void")
    total = measure(counts, rows=F.sum("_n"), fits=F.sum(F.when(fits, F.col("_n"))), left=F.count_if(~fits))
    if not total["fits"]:
        return None, edges if total["rows"] else None
    cores = edges.sparkSession.sparkContext.defaultParallelism
    share = min(SHARED_EDGES, max(FEWEST_EDGES, total["fits"] // (4 * cores)))
    shared = total["fits"] // share + 1
    placed = edges.withColumn(UNIT, F.lit(0).cast("long"))
    if groups:
        hashed = F.xxhash64(*groups)
        unit = F.when(F.col("_n") >= share, hashed).otherwise(F.pmod(hashed, F.lit(shared)))
        of_group = counts.filter(fits).select(*groups, unit.alias(UNIT))
        placed = join_spread(edges, of_group, groups, rows=total["rows"])
    rows = placed.repartition(int(shared) + 1, UNIT).groupBy(UNIT).applyInArrow(lambda table: _pack(groups, table), PACK)
    rest = None
    if total["left"]:
        rest = join_spread(edges, counts.filter(fits).select(*groups), groups, "left_anti", total["rows"])
    return checkpointed(rows), rest


def _ranks(values: pa.Array) -> tuple[np.ndarray, int]:
    """Numbers in the order of the values, and how many there are; null comes last."""
    coded = values.dictionary_encode(null_encoding="encode")
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy(zero_copy_only=False)], max(len(order), 1)


def _pack(groups: list[str], table: pa.Table) -> pa.Table:
    rows = table.num_rows
    ends = pa.concat_arrays([*table["src"].chunks, *table["dst"].chunks])
    graph = np.zeros(rows, np.int64)
    for name in groups:
        rank, many = _ranks(pa.concat_arrays(table[name].chunks))
        graph = np.unique(graph * many + rank, return_inverse=True)[1]
    rank, many = _ranks(ends)
    _, at, vertex = np.unique(np.tile(graph, 2) * many + rank, return_index=True, return_inverse=True)
    sizes = np.bincount(graph[at % rows])
    falling = np.argsort(-sizes, kind="stable")
    place = np.empty(len(falling), np.int64)
    place[falling] = np.arange(len(falling))
    order = np.argsort(place[graph[at % rows]], kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    src, dst = number[vertex[:rows]], number[vertex[rows:]]
    sort = np.lexsort((dst, src))
    at = at[order]
    columns = {name: table[name].take(pa.array(at % rows)) for name in groups} | {"id": ends.take(pa.array(at))}
    vertices = pa.table(columns).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, vertices.schema) as writer:
        writer.write_table(vertices)
    pairs = np.stack([src[sort], dst[sort]]).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(sizes[falling])]).astype(np.int64)
    return pa.table({
        "edges": pa.array([pairs.tobytes()], pa.binary()), "vertices": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
        "first": pa.array([first.tobytes()], pa.binary()), "size": [rows], "width": [int(sizes.max())],
    })


class Pack:
    """Disjoint graphs: ``src`` and ``dst`` (numbers, sorted), ``first``, the number of the first vertex of each graph and the
    end of the last, and ``columns`` (groups and id by number). Inside a graph numbers go by id."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, first: np.ndarray, columns: dict[str, pa.Array]) -> None:
        self.src, self.dst, self.first, self.columns = src, dst, first, columns
        self.sizes = np.diff(self.first)
        self.graph = np.repeat(np.arange(len(self.sizes)), self.sizes)

    @classmethod
    def read(cls, row: dict) -> Pack:
        src, dst = np.frombuffer(row["edges"], np.int32).reshape(2, -1)
        batch = next(iter(pa.ipc.open_stream(row["vertices"]).read_all().combine_chunks().to_batches()))
        return cls(src, dst, np.frombuffer(row["first"], np.int64), dict(zip(batch.schema.names, batch.columns)))

    def wider(self, column: int) -> tuple[int, int]:
        """Numbers of vertices and edges of the graphs that have a root in ``column``: they come first."""
        graphs = int(np.searchsorted(-self.sizes, -column, side="left"))
        vertices = int(self.first[graphs])
        return vertices, int(np.searchsorted(self.src, vertices, side="left"))

    def roots(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Vertices with a column from ``low`` to before ``high``, and that column less ``low``."""
        many = np.clip(self.sizes - low, 0, high - low)
        many = many[many > 0]
        column = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(self.first[: len(many)] + low, many) + column, column

    def rows(self, at: np.ndarray, **others: pa.Array) -> pa.RecordBatch:
        """Groups and id of the vertices ``at``, with other columns."""
        number = pa.array(at)
        return pa.RecordBatch.from_pydict({name: column.take(number) for name, column in self.columns.items()} | others)

    def pairs(self, src: np.ndarray, dst: np.ndarray, **others: pa.Array) -> pa.RecordBatch:
        """Groups and ids of pairs of vertices, with other columns."""
        rows = self.rows(src, dst=self.columns["id"].take(pa.array(dst)), **others)
        return rows.rename_columns(["src" if name == "id" else name for name in rows.schema.names])


Search = Callable[[Pack, int, int], Iterator[pa.RecordBatch]]


def search_packs(packs: DataFrame, search: Search, schema: str, pace: float, by_vertices: bool = False) -> DataFrame:
    """The rows that ``search(pack, low, high)`` gives for all ranges of columns of all packs.

    A range has about ``pace`` edges (or vertices) times columns, the work of some seconds. Packs are read again for each of
    their ranges, never copied.
    """
    size = F.col("size") if not by_vertices else F.octet_length("vertices") / 8
    pieces = F.least(F.greatest(F.ceil(size.cast("double") * F.col("width") / pace), F.lit(1)), F.col("width"), F.lit(MAX_PIECES))
    split = packs.withColumn("pieces", pieces.cast("long"))
    most = measure(split, pieces=F.max("pieces"))["pieces"] or 1
    parts = [split.filter(F.col("pieces") > piece).withColumn("piece", F.lit(piece).cast("long")) for piece in range(most)]
    return union_all(parts).mapInArrow(partial(_search, search), schema)


def _search(search: Search, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
            low, high = (row["width"] * (row["piece"] + more) // row["pieces"] for more in (0, 1))
            yield from search(Pack.read(row), low, high)
