"""Token-id files: documents in ascending id order, their ids in independent rANS blocks (see ``ans``).

Under ``path`` lie two tables. ``frequencies``: ``id, freq``, the table that all blocks share. ``blocks``: ``start`` (ids
of all blocks before), ``n_tokens``, the documents in the block (``doc_ids``, ``lengths`` of their parts in it, ``before``:
ids of the first one in earlier blocks, ``goes_on``: the last one continues in the next) and ``payload``. Any block,
and any checkpoint in it, can be decoded without the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.rounds import scratch_path
from vertexloom.llm import ans
from vertexloom.llm.common import arrow_map, exact, slices, stored
from vertexloom.llm.pieces import encoder

BLOCK = 1 << 19  # ids in a block

DIRECTORY = "n_tokens long, before long, goes_on boolean, doc_ids array<bigint>, lengths array<bigint>"
RAW = f"part int, start long, {DIRECTORY}, ids binary"
BLOCKS = f"start long, {DIRECTORY}, payload binary"
PARTS = "doc_id long, start long, n_tokens long, ids_crc32 long, before long, whole boolean, ids binary"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) and write the files.

    A null text counts as empty and gives the end id alone. Rows are ordered by id, nulls first, and by text among equal
    ids; each is a document of its own. Other columns are not read. An empty table gives files without rows.

    Texts are moved once, into ranges of ids. A task cuts its range into blocks; all later steps work on blocks, one by
    one. The driver sees the histogram of ids (as long as the vocabulary) and one number per range.
    """
    spark = docs.sparkSession
    rows = exact(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    raw = stored(arrow_map(ordered.select("doc_id", "text"), _blocks(tokenizer_path, end_id), RAW), "raw_ids")

    counted = arrow_map(raw.select("ids"), _histogram, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    histogram = counted.toPandas()
    counts = np.zeros(int(histogram["id"].max()) + 1 if len(histogram) else 1, dtype=np.int64)
    counts[histogram["id"].to_numpy(dtype=np.int64)] = histogram["n"].to_numpy(dtype=np.int64)
    freq = ans.scaled(counts)
    table = pd.DataFrame({"id": np.arange(len(freq)), "freq": freq.astype(np.int64)})
    spark.createDataFrame(table[table.freq > 0], "id long, freq long").write.parquet(f"{path}/frequencies")

    totals = raw.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts, total = {}, 0
    for row in totals:
        starts[row["part"]] = total
        total += row["n"]
    coded = arrow_map(raw, _code(freq, starts), BLOCKS)
    coded.write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document, and its ``ids`` (little-endian 32 bit) if asked for.

    ``start`` counts the ids of all documents before. Blocks are decoded independently; damaged ones raise.
    """
    frequencies = spark.read.parquet(f"{path}/frequencies").toPandas()
    freq = np.zeros(int(frequencies["id"].max()) + 1 if len(frequencies) else 1, dtype=np.uint32)
    freq[frequencies["id"].to_numpy(dtype=np.int64)] = frequencies["freq"].to_numpy(dtype=np.int64)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    parts = stored(arrow_map(blocks, _decode(freq, keep_ids), PARTS), "decoded")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids]
    joined = parts.filter(~F.col("whole")).groupBy("doc_id", "start").applyInPandas(_joined, f"{DOCUMENTS}, ids binary")
    return parts.filter("whole").select(*names).unionByName(joined.select(*names))


def _blocks(tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = encoder(tokenizer_path).library.get_vocab_size()
        kind = np.dtype("<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4")
        library = encoder(tokenizer_path, kind.str)
        end = np.array([end_id], dtype=kind).tobytes()
        part, most = TaskContext.get().partitionId(), BLOCK * kind.itemsize
        held, doc_ids, lengths, size, before, start = [], [], [], 0, 0, 0

        def block(goes_on: bool) -> pa.RecordBatch:
            ids = b"%d" % kind.itemsize + b"".join(held)
            parts = [x // kind.itemsize for x in lengths]
            row = [part, start, size // kind.itemsize, before, goes_on, doc_ids, parts, ids]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, RAW_TYPES.values())], list(RAW_TYPES))

        for batch in slices(batches, "text"):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), library.encode(batch.column("text").to_pylist())):
                ids += end
                at = 0
                while at < len(ids):
                    taken = ids[at : at + most - size]
                    if not held:
                        before = at // kind.itemsize
                    held.append(taken)
                    doc_ids.append(doc_id)
                    lengths.append(len(taken))
                    at, size = at + len(taken), size + len(taken)
                    if size == most:
                        yield block(at < len(ids))
                        start += size // kind.itemsize
                        held, doc_ids, lengths, size = [], [], [], 0
        if held:
            yield block(False)
    return run


RAW_TYPES = {
    "part": pa.int32(), "start": pa.int64(), "n_tokens": pa.int64(), "before": pa.int64(), "goes_on": pa.bool_(),
    "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "ids": pa.binary(),
}


def _ids(raw: bytes) -> np.ndarray:
    """Raw ids: the first byte tells their width."""
    return np.frombuffer(raw, dtype="<u2" if raw[:1] == b"2" else "<u4", offset=1)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1, dtype=np.int64)
    for batch in batches:
        for raw in batch.column("ids"):
            own = np.bincount(_ids(raw.as_buffer().to_pybytes()))
            if len(own) > len(counts):
                counts = np.pad(counts, (0, len(own) - len(counts)))
            counts[: len(own)] += own
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["id", "n"])


def _code(freq: np.ndarray, starts: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ans.table_of(freq)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                payload = ans.encode(_ids(row.column("ids")[0].as_py()), table)
                start = starts[row.column("part")[0].as_py()] + row.column("start")[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([start]), *[row.column(name) for name in ("n_tokens", "before", "goes_on", "doc_ids", "lengths")],
                     pa.array([payload], pa.binary())],
                    ["start", "n_tokens", "before", "goes_on", "doc_ids", "lengths", "payload"])
    return run


def _decode(freq: np.ndarray, keep_ids: bool):
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "before", "whole", "ids"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ans.table_of(freq)
        for batch in batches:
            for row in batch.to_pylist():
                data = memoryview(ans.decode(row["payload"], table).astype("<u4")).cast("B")
                found, place, last = [], 0, len(row["lengths"]) - 1
                if len(data) != 4 * row["n_tokens"] or sum(row["lengths"]) != row["n_tokens"]:
                    raise ValueError("a block's directory does not fit")
                for i, (doc_id, length) in enumerate(zip(row["doc_ids"], row["lengths"])):
                    before = row["before"] if i == 0 else 0
                    whole = not before and not (i == last and row["goes_on"])
                    ids = data[4 * place : 4 * (place + length)]
                    found.append((doc_id, row["start"] + place - before, length, zlib.crc32(ids), before, whole,
                                  None if whole and not keep_ids else bytes(ids)))
                    place += length
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], names)
    return run


def _joined(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """One document from its parts in several blocks; ``start`` is its own and so is its key."""
    ids = b"".join(parts.sort_values("before")["ids"])
    return pd.DataFrame({"doc_id": [parts["doc_id"].iloc[0]], "start": [key[1]], "n_tokens": [len(ids) // 4],
                         "ids_crc32": [zlib.crc32(ids)], "ids": [ids]})


def token_file_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the files into a new folder of the shared scratch and give what is read back from them."""
    path = scratch_path(docs.sparkSession, "token_files")
    write_token_files(docs, path, tokenizer_path, end_id)
    return read_token_files(docs.sparkSession, path)
