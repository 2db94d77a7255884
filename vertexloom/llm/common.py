"""What the operators of this package share: exact column choice, stored stages, hashing and driver tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vertexloom.functions.rounds import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, chosen by exact spelling: other columns may differ from them by case alone."""
    positions = [df.columns.index(name) for name in names]
    numbered = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"_c{i}").alias(name) for i, name in zip(positions, names)])


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs meanwhile go with its end, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = path or f"{scratch_path(spark, name)}"
    with brief_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Delete the tables of frames as ``stored`` returned them, once nothing that is still to run reads them. What does
    not lie in the folder of the checkpoints stays."""
    for frame in frames:
        spark = frame.sparkSession
        scratch = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
        files = scratch.getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getParent().toUri().getPath() == scratch.toUri().getPath():
                files.delete(path, True)


_KEPT: dict[str, dict[object, object]] = {}


def worker_memory(owner: str, key: object, make: Callable[[], object]) -> object:
    """What this Python worker keeps between its tasks, for one ``owner`` at a time: operators that run one after another
    don't add up. What another owner kept is dropped first."""
    if owner not in _KEPT:
        _KEPT.clear()
    own = _KEPT.setdefault(owner, {})
    if key not in own:
        own[key] = make()
    return own[key]


def arrow_map(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    return df.mapInArrow(function, schema)


def slices(batches: Iterator[pa.RecordBatch], text_column: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice holds about ``most_bytes`` of text, whatever the length of the rows."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text_column)).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size + 1
        if start < len(sizes):
            yield batch.slice(start)


def numbered(df: DataFrame) -> DataFrame:
    """The same columns under the names ``_c0, _c1, ...``, so that names differing by case alone do not clash."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def kept_rows(docs: DataFrame, keep: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """Rows of ``docs``, all columns unchanged, for whose texts ``keep`` says true; a null text counts as empty."""
    plain, at = numbered(docs), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"_c{at}", 1_000_000):
            texts = [text or "" for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep(texts), pa.bool_()))
    return arrow_map(plain, run, plain.schema).toDF(*docs.columns)


def row_key(doc_id: Column, text: Column) -> Column:
    """A hash of a document's id (a long) and text (not null): equal for equal rows only."""
    return F.xxhash64(F.coalesce(doc_id, F.lit(-1)), doc_id.isNull(), text)
