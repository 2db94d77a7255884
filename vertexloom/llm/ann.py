"""Nearest neighbours by adaptive dimension scan over inverted lists.

Vectors are scaled to length 1 and turned by one random rotation, so that any leading columns are a fair sample of a
distance. Lists are the cells of centres fitted on a bounded sample. In a probed list, distances grow column block by
column block; a candidate is abandoned as soon as a test says that its whole distance exceeds the query's fifth best so
far (Gao, Long: "High-dimensional approximate nearest neighbor search", 2023). Scores are cosines of the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm.common import arrow_map, stored
from vertexloom.llm.linking import runs
from vertexloom.llm.near_vectors import unit_rows, usable

SAMPLE = 20_000  # vectors, about, that the centres are fitted on
PROBE_QUERIES = 400  # of the sample, to choose how many lists are probed
COVERED = 0.985  # share of true neighbours within the sample whose lists must be probed
PER_LIST = 400  # vectors that a list is meant to have
MOST_LISTS = 4096
COLUMNS = 16  # dimensions added per step
EPSILON = 2.1  # of the test: larger abandons later and errs less
SEEDS = 8  # times as many rows as are wanted are measured in full first, to have a distance to beat
PART = 2048  # vectors of a list that are scanned together; larger lists are cut into parts


class Index:
    """Rotation, centres and number of probed lists for vectors of one length."""

    def __init__(self, sample: np.ndarray, count: int, k: int):
        random = np.random.default_rng([23, sample.shape[1]])
        dim = sample.shape[1]
        self.rotation = np.linalg.qr(random.standard_normal((dim, dim)))[0]
        turned = sample @ self.rotation
        lists = int(min(MOST_LISTS, max(1, count // PER_LIST), max(1, len(sample) // 8)))
        centres = turned[random.choice(len(turned), lists, replace=False)]
        for _ in range(10):
            nearest = np.argmax(turned @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, turned)
            norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
        self.centres = centres
        self.probes = self._probes(turned, k)

    def _probes(self, turned: np.ndarray, k: int) -> int:
        """Lists to probe so that the sample's own neighbours are found, but for a share of 1 - COVERED."""
        picked = turned[:: max(1, len(turned) // PROBE_QUERIES)]
        near = picked @ turned.T
        near[np.arange(len(picked)), np.arange(0, len(turned), max(1, len(turned) // PROBE_QUERIES))] = -2
        best = np.argpartition(-near, min(k, near.shape[1] - 1), axis=1)[:, :k] if near.shape[1] > 1 else np.zeros((len(picked), 1), int)
        rank = np.argsort(np.argsort(-(picked @ self.centres.T), axis=1), axis=1)
        home = np.argmax(turned @ self.centres.T, axis=1)
        needed = np.take_along_axis(rank, home[best], axis=1)
        return int(np.quantile(needed, COVERED)) + 1

    def nearest_lists(self, turned: np.ndarray, number: int) -> np.ndarray:
        near = turned @ self.centres.T
        number = min(number, near.shape[1])
        return np.argpartition(-near, number - 1, axis=1)[:, :number]


def fit(vectors: DataFrame, k: int) -> dict[int, Index]:
    """An index per vector length, each from about ``SAMPLE`` distinct vectors drawn by hash."""
    counts = {row["dim"]: row["n"] for row in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    result = {}
    for dim, count in sorted(counts.items()):
        chance = F.pmod(F.xxhash64("v"), F.lit(1_000_003)) / 1_000_003.0
        own = vectors.filter((F.col("dim") == dim) & (chance < min(1.0, SAMPLE / count)))
        sample = np.array([row["v"] for row in own.select("v").sort(F.xxhash64("v"), "v").toLocalIterator()], dtype=np.float64)
        if not len(sample):  # a tiny table may draw nothing
            sample = np.array([row["v"] for row in vectors.filter(F.col("dim") == dim).sort("v").limit(SAMPLE).select("v").collect()], dtype=np.float64)
        sample /= np.abs(sample).max(axis=1, keepdims=True)
        result[dim] = Index(sample / np.sqrt((sample * sample).sum(axis=1, keepdims=True)), count, k)
    return result


def nearest(
    vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every``, its ``k`` nearest others.

    Nearness is the cosine in double precision, ties go to the smaller id. Vectors without a direction (null, zero, with
    null or non-finite components) take no part, nor do rows with a null id; vectors of different lengths are not compared.
    Ids are taken as unique; other columns are not read. Of equal vectors only the ``k + 1`` smallest ids can be an answer,
    so the index holds a vector once with these ids. All lists hold all vectors, none is cut; long ones are scanned in parts.
    """
    rows = usable(vectors, id_col, vector_col).filter(F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    keyed = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), "v"))
    # The smallest ids per vector: first per slice of ids, then per vector, so that no task gets all copies.
    salt = F.pmod(F.col("vec_id"), F.lit(64))
    first = Window.partitionBy("h1", "h2", "salt").orderBy("vec_id")
    then = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = keyed.withColumn("salt", salt).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(then)).filter(F.col("r") <= k + 1)
    index_rows = stored(few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")).select(
        "ids", F.size("v").alias("dim"), "v"), "distinct_vectors")
    indexes = fit(index_rows, k)

    listed = arrow_map(index_rows, _assign(indexes, False), "dim int, list int, ids array<long>, x binary, turned binary")
    listed = stored(listed, "listed")
    parts = listed.groupBy("dim", "list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    split = listed.join(F.broadcast(parts), ["dim", "list"]).withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int"))
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.array("vec_id").alias("ids"), F.size("v").alias("dim"), "v")
    probes = arrow_map(asked, _assign(indexes, True), "dim int, list int, ids array<long>, x binary, turned binary")
    probes = probes.join(F.broadcast(parts), ["dim", "list"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    groups = ["dim", "list", "part"]
    both = split.withColumn("asks", F.lit(False)).unionByName(probes.withColumn("asks", F.lit(True)))
    dealt = both.select(*groups, "asks", "ids", "x", "turned").repartition(*groups).sortWithinPartitions(*groups, "asks")
    found = arrow_map(dealt, _scan(groups, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _assign(indexes: dict[int, Index], probing: bool):
    """The list of every vector, or the lists that a query probes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                x = unit_rows(own.column("v"), dim)
                index = indexes[dim]
                turned = x @ index.rotation
                lists = index.nearest_lists(turned, index.probes if probing else 1)
                for at in range(0, len(x), 256):  # probes repeat a query's vector: keep batches small
                    part = slice(at, at + 256)
                    row = np.repeat(np.arange(at, min(len(x), at + 256)), lists.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), dim, np.int32)), pa.array(lists[part].ravel().astype(np.int32)),
                         own.column("ids").take(pa.array(row)), pa.array([x[i].tobytes() for i in row], pa.binary()),
                         pa.array([turned[i].tobytes() for i in row], pa.binary())],
                        ["dim", "list", "ids", "x", "turned"])
    return run


def _scan(groups: list[str], k: int):
    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, groups):
            asks = rows.column("asks").to_numpy()
            first = int(np.searchsorted(asks, True))
            if not 0 < first < len(asks):
                continue
            dim = rows.column("dim")[0].as_py()
            ids = rows.column("ids").to_pylist()
            x, turned = (np.frombuffer(b"".join(rows.column(name).to_pylist()), dtype="<f8").reshape(-1, dim) for name in ("x", "turned"))
            for at in range(first, len(asks), 512):
                own = slice(at, min(len(asks), at + 512))
                pairs = survivors(turned[own], turned[:first], k + 1)
                found = _best(pairs, [own_ids[0] for own_ids in ids[own]], ids[:first], x[own], x[:first], k)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(column, kind) for column, kind in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64()))], names)
    return run


def survivors(queries: np.ndarray, rows: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """``(query, row)`` pairs that no test has abandoned.

    The rows nearest in the first columns are measured in full, which gives each query a distance to beat. Then column
    block after column block is added to the partial distances of all pairs that are left; a pair goes when its distance
    over d of D columns, scaled by D / d, exceeds the one to beat by more than chance allows.
    """
    dim = queries.shape[1]
    first = min(COLUMNS, dim)
    partial = _distance(queries[:, :first], rows[:, :first])
    measured = min(SEEDS * keep, partial.shape[1])
    seeds = np.argpartition(partial, measured - 1, axis=1)[:, :measured]
    full = ((queries[:, None, :] - rows[seeds]) ** 2).sum(axis=2)
    beat = np.partition(full, keep - 1, axis=1)[:, keep - 1] if measured >= keep else np.full(len(queries), np.inf)
    q, r = np.nonzero(partial * (dim / first) <= (beat * (1 + EPSILON / math.sqrt(first)) ** 2 + 1e-9)[:, None])
    so_far = partial[q, r]
    for start in range(first, dim, COLUMNS):
        end = min(dim, start + COLUMNS)
        so_far = so_far + ((queries[q, start:end] - rows[r, start:end]) ** 2).sum(axis=1)
        slack = (1 + EPSILON / math.sqrt(end)) ** 2 if end < dim else 1.0
        alive = so_far * (dim / end) <= beat[q] * slack + 1e-9
        q, r, so_far = q[alive], r[alive], so_far[alive]
    return q, r


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


def _best(pairs, query_ids: list[int], ids: list[list[int]], queries: np.ndarray, rows: np.ndarray, k: int) -> list[tuple]:
    """Exact scores of the pairs; the ``k`` best ids of each query, its own left out."""
    q, r = pairs
    score = np.einsum("ij,ij->i", queries[q], rows[r])
    found = []
    order = np.lexsort((-score, q))
    borders = np.searchsorted(q[order], np.arange(len(query_ids) + 1))
    for i, query_id in enumerate(query_ids):
        best: list[tuple[float, int]] = []
        for j in order[borders[i] : borders[i + 1]].tolist():
            if len(best) >= k and -best[k - 1][0] > score[j]:
                break
            best += [(-float(score[j]), vec_id) for vec_id in ids[r[j]] if vec_id != query_id]
            best.sort()
        found += [(query_id, vec_id, -negative) for negative, vec_id in best[:k]]
    return found
