"""Token counts of whole texts; a huge text is counted in overlapping chunks that are spread over tasks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.rounds import checkpointed, union_all
from vertexloom.llm.common import arrow_map, exact, slices
from vertexloom.llm.pieces import encoder

CHUNK = 32_768  # characters of a huge text between two joints
OVERLAP = 256  # characters on both sides of a joint that two chunks share at first
WIDER = 8  # times the overlap, for texts with a joint at which two chunks don't agree
AROUND = 4  # tokens on both sides of a splice that must be the same in both chunks
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")

CUT = "doc_id long, copy long, hash long, n_bytes long, part int, last boolean, chunk string, start long, left long, right long"
# Places at a joint as one chunk has them: keys are place and crc of the tokens around, before the chunk's tokens before it.
PLACES = ("doc_id long, copy long, hash long, n_bytes long, joint int, of_left boolean, keys array<long>, "
          "before array<long>, tail long")


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, bool, str, int, int, int]]:
    """``(part, last, chunk, start, left, right)``: chunk ``part`` begins at ``start`` and owns the text from joint ``left``
    to joint ``right``; it reaches ``overlap`` characters beyond both. Where a joint has no lone space within that reach,
    the text is not cut there."""
    step, end = max(size, overlap), len(text)
    joints = [at for at in range(step, end - overlap, step) if LONE_SPACE.search(text, max(at - overlap, 0), at + overlap)]
    bounds = [0, *joints, end]
    for part, (left, right) in enumerate(zip(bounds, bounds[1:])):
        start = max(left - overlap, 0)
        yield part, right == end, text[start : min(right + overlap, end)], start, left, right


def places(chunk: str, start: int, joint: int, overlap: int, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray):
    """Lone spaces around ``joint`` at which a token of the chunk ends and the next begins, as ``keys`` and ``before``.

    The pre-tokenizers of the public files end a word there and begin the next with the space, whatever stands around.
    """
    keys, before = [], []
    for found in LONE_SPACE.finditer(chunk, max(joint - overlap - start, 0), min(joint + overlap - start, len(chunk))):
        at = found.start()
        after = int(np.searchsorted(starts, at))  # offsets may leave out the space that a word takes in front
        if after < AROUND or after + AROUND > len(ids) or ends[after - 1] > at or starts[after] > at + 1:
            continue
        keys.append((start + at) << 32 | zlib.crc32(ids[after - AROUND : after + AROUND].tobytes()))
        before.append(after)
    return keys, before


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, huge: int = 2 * CHUNK) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``.

    ``n_tokens`` is what ``tokenizers`` gives for the whole text without added special tokens; ``n_bytes`` its length in
    UTF-8. A null or empty text has 0 of both; rows with equal or null ``doc_id`` are counted each for itself; other
    columns are not read. Texts of more than ``huge`` characters are cut into overlapping chunks that are encoded by
    different tasks. Two neighbours are spliced at a lone space at which both have a boundary and the same tokens around;
    a text with a joint that has none is encoded again with wider overlaps, in the end as one chunk. One task cuts a text
    and holds it whole; a text without lone spaces is one chunk.
    """
    rows = exact(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    small = arrow_map(
        rows.filter(F.length("text") <= huge), _count_small(tokenizer_path), "doc_id long, n_bytes long, n_tokens long")

    keys = ["doc_id", "hash"]
    large = rows.filter(F.length("text") > huge).withColumns(
        {"copy": F.monotonically_increasing_id(), "hash": F.xxhash64("text")}).select("doc_id", "text", "copy", "hash")
    todo, overlap, parts = large, OVERLAP, [small]
    while True:
        spliced = checkpointed(_spliced(todo, tokenizer_path, overlap))
        parts.append(spliced.filter(~F.col("failed")).select("doc_id", "n_bytes", "n_tokens"))
        failed = spliced.filter("failed").select(*[F.col(name).alias(f"_{name}") for name in keys]).distinct()
        if not failed.take(1):
            break
        same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in keys]
        todo, overlap = large.join(failed, same, "left_semi"), WIDER * overlap
    return union_all(parts).withColumn("over_limit", F.col("n_tokens") > limit)


def _spliced(large: DataFrame, path: str, overlap: int) -> DataFrame:
    """``(doc_id, hash, n_bytes, n_tokens, failed)`` per text. Every joint is a row of its own until its splice is chosen."""
    row = ["doc_id", "copy", "hash", "n_bytes"]
    spread = arrow_map(large, _cut(overlap), CUT).repartition(F.xxhash64("doc_id", "copy", "part"))
    found = arrow_map(spread, _places(path, overlap), PLACES)
    side = F.struct("keys", "before")
    joints = found.groupBy(*row, "joint").agg(
        F.max(F.when(F.col("of_left"), side)).alias("l"), F.max(F.when(~F.col("of_left"), side)).alias("r"),
        F.sum("tail").alias("tail"))
    first = F.get(F.array_intersect("l.keys", "r.keys"), F.lit(0))
    chosen = joints.withColumn("splice", first)
    own = [F.element_at(f"{name}.before", F.array_position(f"{name}.keys", F.col("splice")).cast("int")) for name in "lr"]
    tokens = F.when(F.col("splice").isNotNull(), own[0] - own[1]).otherwise(F.lit(0)) + F.coalesce("tail", F.lit(0))
    lost = F.col("joint").isNotNull() & F.col("splice").isNull()
    return chosen.select(*row, tokens.alias("n"), lost.alias("lost")).groupBy(*row).agg(
        F.sum("n").alias("n_tokens"), F.max("lost").alias("failed")).select("doc_id", "hash", "n_bytes", "n_tokens", "failed")


def _count_small(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path)
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            counts = [len(ids) // 4 for ids in library.encode(texts.to_pylist())]
            sizes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
    return run


def _cut(overlap: int):
    names = [part.split()[0] for part in CUT.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.bool_(), pa.string()] + [pa.int64()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, copy, hash_ in zip(*[column.to_pylist() for column in batch.columns]):
                size = len(text.encode())
                for chunk in chunks(text, CHUNK, overlap):
                    row = (doc_id, copy, hash_, size, *chunk)
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)
    return run


def _places(path: str, overlap: int):
    names = ["joint", "of_left", "keys", "before", "tail"]
    kinds = [pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
    row = ["doc_id", "copy", "hash", "n_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path).library
        for batch in batches:
            for one in range(batch.num_rows):
                part, last, chunk, start, left, right = [batch.column(i)[one].as_py() for i in range(4, 10)]
                found = library.encode(chunk, add_special_tokens=False)
                offsets = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
                tokens = (offsets[:, 0], offsets[:, 1], np.array(found.ids, dtype="<u4"))
                rows = []
                if part:
                    rows.append((part, False, *places(chunk, start, left, overlap, *tokens), 0))
                if last:
                    rows.append((None, True, [], [], len(found.ids)))
                else:
                    rows.append((part + 1, True, *places(chunk, start, right, overlap, *tokens), 0))
                own = [pa.array([batch.column(name)[one].as_py()] * len(rows), pa.int64()) for name in row]
                yield pa.RecordBatch.from_arrays(
                    [*own, *[pa.array(x, k) for x, k in zip(zip(*rows), kinds)]], [*row, *names])
    return run
