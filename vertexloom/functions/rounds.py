"""What an iterative operator needs between two rounds: cut the lineage, read the stop test."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure reliable checkpoints have a folder.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local master that names none (tests) gets a
    temporary folder of its own: on a cluster a machine-local folder would be lost together with its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="vertexloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Run ``df`` once, keep its rows in the shared checkpoint folder and return a frame without its history."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame, **aggregates: Column) -> tuple[DataFrame, Row]:
    """``checkpointed`` for a loop whose next round joins the frame with itself; also returns whole-frame aggregates.

    A bare checkpoint inherits the size estimate of its plan. Joins multiply estimates, so where a round joins frames
    that both stem from the previous round, the digits of the estimate double or triple every round, until planning
    takes minutes. Here the aggregates, the stop test of the loop, fill a cache; the checkpoint is written from it and
    inherits the size that was measured.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist()
    row = measure(cached, **aggregates)
    kept = cached.select("*").checkpoint(eager=True)
    cached.unpersist()
    return kept, row


def measure(df: DataFrame, **aggregates: Column) -> Row:
    """One row of whole-frame aggregates, the only thing a loop brings to the driver."""
    return df.agg(*[column.alias(name) for name, column in aggregates.items()]).first()


def row_count(df: DataFrame) -> int:
    return measure(df, n=F.count(F.lit(1)))["n"]


def union_all(frames: list[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name next to the checkpoints, for tables and files that all executors must see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
