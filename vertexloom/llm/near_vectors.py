"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import arrow_map, exact, stored
from vertexloom.llm.linking import components, roots, runs

BUCKET = 64  # vectors that a signature is meant to have by chance: longer signatures for more vectors
MISSED = 1e-4  # chance that a pair just at the threshold shares no signature: more tables for longer signatures
BLOCK = 512  # vectors of a bucket that are compared at once; larger buckets are compared block by block


def usable(vectors: DataFrame, id_col: str, vector_col: str, *other: str) -> DataFrame:
    """Rows with a vector that has a direction: not null, not zero, all components finite numbers."""
    rows = exact(vectors, id_col, vector_col, *other)
    huge = F.lit(float("inf"))
    broken = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == huge))
    return rows.filter(F.col(vector_col).isNotNull() & ~broken & F.exists(vector_col, lambda x: x != 0))


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, scaled to length 1 in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def shape(count: int, threshold: float) -> tuple[int, int]:
    """Bits per signature and number of tables for ``count`` vectors that may link."""
    bits = min(24, max(4, math.ceil(math.log2(max(1, count / BUCKET)))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISSED) / math.log(1 - together)))


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``.

    Rows link if their labels are equal and not null, their vectors as long, and the cosine in double precision reaches
    the threshold. Vectors without a direction (null, zero, with null or non-finite components) link with nothing. Equal
    vectors are compared once, and count as often as they occur. Ids are taken as unique; other columns are not read. Pairs
    are never listed: a task compares blocks of a bucket and returns, per vector, the number of links found there first
    (no earlier table holds the pair) and one connection to the rest of its group.
    """
    rows = usable(vectors, id_col, vector_col, label_col).filter(F.col(label_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    keyed = rows.withColumn("h1", F.xxhash64("label", "v")).withColumn("h2", F.xxhash64(F.lit(7), "v", "label"))
    copies = stored(keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "copies")
    members = stored(keyed.select("vec_id", "h1", "h2").join(copies, ["h1", "h2"]).select("vec_id", "rep", "n"), "members")
    single = keyed.join(copies, ["h1", "h2"]).filter("vec_id = rep").select("vec_id", "n", "label", F.size("v").alias("dim"), "v")
    single = stored(single.withColumn("label", F.xxhash64("label")), "single")

    largest = single.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = shape(largest, threshold)
    signed = arrow_map(single, _signatures(bits, tables), "vec_id long, n long, label long, dim int, v binary, signs array<int>")
    signed = stored(signed, "signed")
    bucket = ["label", "dim", "table", "signature"]
    exploded = signed.select("*", F.posexplode("signs").alias("table", "signature"))
    sizes = exploded.groupBy(*bucket).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    sized = exploded.join(sizes.withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")).drop("rows"), bucket)
    own = sized.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = own.withColumn("other", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    groups = [*bucket, "low", "high"]
    dealt = paired.select(*groups, "block", "vec_id", "n", "v", "signs").repartition(*groups).sortWithinPartitions(*groups)
    found = stored(arrow_map(dealt, _compare(groups, threshold), "vec_id long, links long, root long"), "found")

    counted = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    linked = components(found.select("vec_id", "root"))
    reps = counted.join(linked.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    grouped = members.join(reps.withColumnRenamed("vec_id", "rep"), "rep", "left").select(
        F.col("vec_id").alias("_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
        F.coalesce("component", "rep").alias("component"))
    everyone = exact(vectors, id_col).select(F.col(id_col).cast("long").alias("vec_id"))
    joined = everyone.join(grouped, F.col("vec_id") == F.col("_id"), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _signatures(bits: int, tables: int):
    """The signs of dot products with random directions, the same for every task."""
    names = ["vec_id", "n", "label", "dim", "v", "signs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([17, dim]).standard_normal((dim, tables * bits))
                x = unit_rows(own.column("v"), dim)
                signs = ((x @ planes[dim] > 0).reshape(-1, tables, bits) * powers).sum(axis=2).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[own.column(name) for name in names[:4]], pa.array([row.tobytes() for row in x], pa.binary()),
                     pa.array(signs.tolist(), pa.list_(pa.int32()))], names)
    return run


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1)


def _compare(groups: list[str], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for rows in runs(batches, groups):
            if rows.num_rows > 1:
                found += _block(rows, threshold)
            if len(found) > 500:
                yield _batch(found)
                found = []
        yield _batch(found)
    return run


def _batch(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 3
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["vec_id", "links", "root"])


def _block(rows: pa.Table, threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links between the two blocks of a pair, or inside the one: per vector their number and a smallest partner."""
    table, low, high = (rows.column(name)[0].as_py() for name in ("table", "low", "high"))
    ids, n, block = (rows.column(name).to_numpy() for name in ("vec_id", "n", "block"))
    x, signs = _matrix(rows.column("v"), "<f8"), np.array(rows.column("signs").to_pylist(), dtype=np.int32)
    left = np.flatnonzero(block == low)
    right = np.flatnonzero(block == high)
    i, j = np.nonzero(x[left] @ x[right].T >= threshold)
    i, j = left[i], right[j]
    if low == high:
        i, j = i[i < j], j[i < j]
    new = ~(signs[i, :table] == signs[j, :table]).any(axis=1)
    i, j = i[new], j[new]
    if not len(i):
        return []
    links = np.bincount(i, n[j], minlength=len(ids)) + np.bincount(j, n[i], minlength=len(ids))
    root = roots(i, j, len(ids))
    touched = np.flatnonzero(links > 0)
    return [(ids[touched], links[touched].astype(np.int64), ids[root[touched]])]
