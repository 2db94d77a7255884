"""Byte-level BPE by recursive DuckDB queries inside each task.

Words are matches of the split pattern. The words that a task has not met yet become rows ``(word, pos, id)`` of single
bytes; a recursive query joins neighbouring rows with the merge table and contracts, per word and step, the leftmost
pair of the lowest rank, until no pair of the word is in the table. A word of more than ``LONG`` bytes is contracted in parts that are joined where their
ids fit. An ordered aggregation turns ids back into bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import arrow_map, exact, slices, worker_memory
from vertexloom.llm.pieces import PieceEncoder, joined_pieces

MOST_WORDS = 700_000  # remembered per worker; beyond that those not met for long are forgotten
LONG = 64  # bytes; longer words are contracted in parts of this length, which are then joined
QUERY_BYTES = 1_000_000  # bytes of the words in one query
QUERY_IDS = 1_000_000  # ids in one query that decodes

# Rows of a word are linked: `follows` is the place of the next one. In a step `best` is the word's lowest rank, the place of
# its leftmost pair, that of the pair's second row and what follows it, in one number. Words without a pair that is in the
# merge table come out as they are, closed.
ENCODE = """
WITH RECURSIVE steps(word, pos, id, follows, open) AS (
    SELECT word, pos, id, pos + 1, true FROM bytes
    UNION ALL
    SELECT own.word, pos, (CASE WHEN pos = (best >> 16) & 255 THEN best >> 24 ELSE id END)::INTEGER,
           (CASE WHEN pos = (best >> 16) & 255 THEN best & 255 ELSE follows END)::INTEGER, best IS NOT NULL
    FROM (SELECT * FROM steps WHERE open) AS own
    LEFT JOIN (SELECT one.word, min((merged << 24) | (one.pos << 16) | (two.pos << 8) | two.follows) AS best
               FROM steps AS one JOIN steps AS two ON two.word = one.word AND two.pos = one.follows
               JOIN merges ON merges.l = one.id AND merges.r = two.id
               WHERE one.open AND two.open GROUP BY one.word) AS lowest ON lowest.word = own.word
    WHERE pos IS DISTINCT FROM (best >> 8) & 255
)
SELECT word, id FROM steps WHERE NOT open ORDER BY word, pos
"""

# For a long stretch around a joint of parts, a step takes all places of the lowest rank at once: of a run of overlapping ones every other, from the
# left. A merge can only make pairs of higher rank, so the leftmost-first order gives the same.
LONG_STEP = """
CREATE OR REPLACE TEMP TABLE next AS
SELECT word, pos, CASE WHEN taken THEN low ELSE id END AS id, low IS NOT NULL AS open
FROM (SELECT *, lag(taken, 1, false) OVER (PARTITION BY word ORDER BY pos) AS swallowed
      FROM (SELECT *, coalesce(merged = low AND (row_number() OVER (PARTITION BY word, run ORDER BY pos)) % 2 = 1, false) AS taken
            FROM (SELECT *, sum(CASE WHEN merged = low THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY pos)
                            + CASE WHEN merged = low THEN 0.5 ELSE 0 END AS run
                  FROM (SELECT *, min(merged) OVER (PARTITION BY word) AS low
                        FROM (SELECT word, pos, id, lead(id) OVER (PARTITION BY word ORDER BY pos) AS next_id FROM long) AS pairs
                        LEFT JOIN merges ON merges.l = pairs.id AND merges.r = pairs.next_id))))
WHERE NOT swallowed
"""

DECODE = """
SELECT doc, array_to_string(list(hex ORDER BY pos), '') AS hex FROM ids JOIN vocabulary USING (id) GROUP BY doc
"""


class Coder:
    """One DuckDB connection of a Python worker, with the merge table of a rank file."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.connection = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(self.ranks[word[:i]], self.ranks[word[i:]], rank) for word, rank in self.ranks.items()
                 for i in range(1, len(word)) if word[:i] in self.ranks and word[i:] in self.ranks]
        merges = pa.table([pa.array(x, kind) for x, kind in zip(zip(*pairs), (pa.int32(), pa.int32(), pa.int64()))], ["l", "r", "merged"])  # noqa: F841, read by name
        vocabulary = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [x.hex() for x in self.ranks]})  # noqa: F841
        self.connection.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.connection.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.words = {rank: word for word, rank in self.ranks.items()}
        self.known: dict[str, bytes] = {"": b""}
        self.earlier: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian 32 bit numbers."""
        cuts = [self._cut(text) for text in texts]
        some = [cut for cut in cuts if cut is not None]
        joined = iter(joined_pieces(some, self._ids_of, np.dtype("<u4")) if some else [])
        return [self._ids_of([text])[0] if cut is None else next(joined) for text, cut in zip(texts, cuts)]

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self.known) + len(pieces) > MOST_WORDS // 2:
            self.earlier, self.known = self.known, {"": b""}
        known = self.known
        words = {piece: self.pattern.findall(piece) for piece in self._unknown(pieces)}
        self._learn(sorted(self._unknown({word for split in words.values() for word in split})))
        for piece, split in words.items():
            known[piece] = known[split[0]] if len(split) == 1 else b"".join([known[word] for word in split])
        return [known[piece] for piece in pieces]

    def _unknown(self, pieces: Iterable[str]) -> list[str]:
        """Those without ids so far; the ids of those that return are kept on."""
        missing = []
        for piece in [piece for piece in pieces if piece not in self.known]:
            if (ids := self.earlier.get(piece)) is not None:
                self.known[piece] = ids
            else:
                missing.append(piece)
        return missing

    @staticmethod
    def _cut(text: str) -> str | None:
        """Matches never join what stands before a lone space or line break with what follows it."""
        return PieceEncoder._keeping_spaces(text)

    def _learn(self, words: list[str]) -> None:
        new = []
        for word in words:
            raw = word.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.known[word] = np.array([rank], dtype="<u4").tobytes()
            elif len(raw) <= LONG:
                new.append((word, raw))
            else:
                self.known[word] = self._joined(raw)
        for (word, _), ids in zip(new, self._contracted([raw for _, raw in new])):
            self.known[word] = ids

    def _contracted(self, raws: list[bytes]) -> list[bytes]:
        """Ids of words of bytes, each contracted as a whole, in queries over a bounded number of bytes."""
        found = [b""] * len(raws)
        for long in (False, True):
            held: list[int] = []
            size = 0
            own = [i for i, raw in enumerate(raws) if (len(raw) > LONG) == long]
            for i in own:
                held.append(i)
                size += len(raws[i])
                if size >= QUERY_BYTES or i == own[-1]:
                    for j, ids in zip(held, self._query([raws[j] for j in held], long)):
                        found[j] = ids
                    held, size = [], 0
        return found

    def _joined(self, raw: bytes) -> bytes:
        """Ids of a long word from those of its parts, two neighbours at a time.

        Ids are those of the word exactly if each neighbouring two are those of their own bytes. So where the last id of
        one part and the first of the next are not, the ids around are made anew from their bytes, more of them each
        time, until the ends of that stretch fit what stands beside it.
        """
        parts = [np.frombuffer(x, dtype="<u4") for x in self._contracted([raw[i : i + LONG] for i in range(0, len(raw), LONG)])]
        while len(parts) > 1:
            odd = parts[len(parts) // 2 * 2 :]
            parts = self._pairs_joined(list(zip(parts[::2], parts[1::2]))) + odd
        return parts[0].tobytes()

    def _pairs_joined(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        joined: list[np.ndarray] = [np.empty(0, dtype="<u4")] * len(pairs)
        todo, reach = list(range(len(pairs))), 1
        while todo:
            cut = [(left[: max(len(left) - reach, 0)], left[max(len(left) - reach, 0) :], right[:reach], right[reach:])
                   for left, right in (pairs[i] for i in todo)]
            stretches = self._contracted([self._bytes(one) + self._bytes(two) for _, one, two, _ in cut])
            anew = [np.frombuffer(x, dtype="<u4") for x in stretches]
            ends = [[*([(before[-1], new[0])] if len(before) else []), *([(new[-1], after[0])] if len(after) else [])]
                    for (before, _, _, after), new in zip(cut, anew)]
            fit = iter(self._fit([pair for own in ends for pair in own]))
            still = []
            for i, (before, _, _, after), new, own in zip(todo, cut, anew, ends):
                if all([next(fit) for _ in own]):
                    joined[i] = np.concatenate([before, new, after])
                else:
                    still.append(i)
            todo, reach = still, 4 * reach
        return joined

    def _fit(self, pairs: list[tuple[int, int]]) -> list[bool]:
        found = self._contracted([self._bytes(pair) for pair in pairs])
        return [ids == np.array(pair, dtype="<u4").tobytes() for ids, pair in zip(found, pairs)]

    def _bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.words[int(i)] for i in ids])

    def _query(self, raws: list[bytes], long: bool) -> list[bytes]:
        sizes = np.array([len(raw) for raw in raws], dtype=np.int64)
        owner = np.repeat(np.arange(len(raws)), sizes)
        pos = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        bytes_ = pa.table({
            "word": owner.astype(np.int32), "pos": pos.astype(np.int32),
            "id": self.single[np.frombuffer(b"".join(raws), dtype=np.uint8)]})
        self.connection.register("bytes", bytes_)
        found = self._loop() if long else self.connection.execute(ENCODE).fetchnumpy()
        self.connection.unregister("bytes")
        ids = found["id"].astype("<u4").tobytes()
        ends = [0, *(4 * np.cumsum(np.bincount(found["word"], minlength=len(raws)))).tolist()]
        return [ids[start:end] for start, end in zip(ends, ends[1:])]

    def _loop(self) -> dict[str, np.ndarray]:
        run = self.connection.execute
        run("CREATE OR REPLACE TEMP TABLE long AS SELECT * FROM bytes")
        run("CREATE OR REPLACE TEMP TABLE done AS SELECT * FROM bytes WHERE false")
        while run("SELECT count(*) FROM long").fetchone()[0]:
            run(LONG_STEP)
            run("INSERT INTO done SELECT word, pos, id FROM next WHERE NOT open")
            run("CREATE OR REPLACE TEMP TABLE long AS SELECT word, pos, id FROM next WHERE open")
        return run("SELECT word, id FROM done ORDER BY word, pos").fetchnumpy()

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """Per row of ids the bytes they stand for."""
        result: list[list[bytes]] = [[] for _ in encoded]
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for doc, raw in enumerate(encoded):
            ids = np.frombuffer(raw, dtype="<i4")
            while len(ids):
                part, ids = ids[: QUERY_IDS - size], ids[QUERY_IDS - size :]
                held.append((doc, part))
                size += len(part)
                if size == QUERY_IDS:
                    self._decode(held, result)
                    held, size = [], 0
        if held:
            self._decode(held, result)
        return [b"".join(parts) for parts in result]

    def _decode(self, held: list[tuple[int, np.ndarray]], result: list[list[bytes]]) -> None:
        flat = np.concatenate([ids for _, ids in held])
        self.connection.register("ids", pa.table({
            "doc": np.repeat(np.array([doc for doc, _ in held], dtype=np.int32), [len(ids) for _, ids in held]),
            "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
        for doc, text in self.connection.execute(DECODE).fetchall():
            result[doc].append(bytes.fromhex(text))
        self.connection.unregister("ids")

    def round_trip(self, encoded: list[bytes], texts: pa.Array) -> list[bytes]:
        decoded = self.decode(encoded)
        if decoded != texts.cast(pa.binary()).to_pylist():
            raise ValueError("decoded ids differ from the text")
        return decoded


def coder(path: str, pattern: str) -> Coder:
    return worker_memory("duck_bpe", (path, pattern), lambda: Coder(path, pattern))


def documents_with_ids(docs: DataFrame) -> DataFrame:
    return exact(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` per row: ids as little-endian 32 bit numbers, and the bytes that they decode to.

    A null text counts as empty and has no ids; rows with equal or null ``doc_id`` are encoded each for itself; other
    columns are not read. Works within a task, without a shuffle; a task holds a few megabytes of text at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks_path, pattern)
        for batch in slices(batches, "text"):
            ids = own.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(own.round_trip(ids, batch.column("text")), pa.binary())],
                ["doc_id", "ids", "decoded"])
    return arrow_map(documents_with_ids(docs), run, "doc_id long, ids binary, decoded binary")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: digests of what ``encode_documents`` gives, made in its tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks_path, pattern)
        decimal = [b"%d" % i for i in range(max(own.ranks.values()) + 1)]
        for batch in slices(batches, "text"):
            ids = own.encode(batch.column("text").to_pylist())
            texts = [b" ".join([decimal[i] for i in np.frombuffer(x, dtype="<u4").tolist()]) for x in ids]
            columns = [
                batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in own.round_trip(ids, batch.column("text"))], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return arrow_map(
        documents_with_ids(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
