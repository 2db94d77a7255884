"""Periodic runs: stretches of words that repeat with a period, found on a grammar of the texts.

Each task takes some MB of whole texts at a time. Re-Pair compresses their word ids: in a round every pair of symbols that
stands more often (by powers of two; ties by a hash) than the pairs it overlaps with becomes a symbol of its own, until no
pair repeats; what is left of each text is then paired off to one root. A run is a run across the middle of the lowest
symbol that holds it, so runs are computed once per symbol, at the first place it was derived from: two places at one
distance on the same side of the middle must agree in six words, which an index of repeated six-word windows gives; exact
ranks of windows of 1, 2, 4, ... words extend them. The runs go to all places the symbol was derived at, and those inside
a longer one of the same period are dropped.

Words are what stands between ASCII white space. A null text has no words; repeated rows are handled one by one; an empty
table gives an empty table; other columns stay as they are, whatever their names. A text is never split: a task holds
about 300 bytes per word of its longest text, when that text repeats itself throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vertexloom.llm.common import arrow_map, exact, numbered, slices

SHORTEST = 12  # words of a run, at least; and two periods
WINDOW = SHORTEST // 2  # a run of period q agrees with itself q words on over at least max(q, 12 - q) >= 6 words
SLICE_BYTES = 4_000_000
OPEN = 1_000_000  # candidates handled at once
RUNS = "array<struct<start: long, length: long, period: long>>"


def _codes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense numbers of equal keys, and how often each occurs."""
    codes, _ = pd.factorize(keys)
    return codes, np.bincount(codes)


class Grammar:
    """Symbols with two parts: where the first derived place of each begins, where its middle and its end are; all places.

    ``symbols`` are small numbers, texts follow one another, ``lengths`` gives the words of each text.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray) -> None:
        self.begin: list[np.ndarray] = []
        self.middle: list[np.ndarray] = []
        self.end: list[np.ndarray] = []
        self.of: list[np.ndarray] = []  # symbol and place of every derivation
        self.places: list[np.ndarray] = []
        self.known = 0
        self.symbols = symbols.astype(np.int64)
        self.next_symbol = int(symbols.max()) + 1 if len(symbols) else 0
        self.starts = np.arange(len(symbols))
        self.sizes = np.ones(len(symbols), np.int64)
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        while len(self.symbols) > 1 and self._replace_repeated():
            pass
        while len(self.symbols) > 1 and self._pair_off():
            pass
        self.begin, self.middle, self.end = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.begin, self.middle, self.end))
        of, places = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.of, self.places))
        order = np.argsort(of, kind="stable")
        self.of, self.places = of[order], places[order]

    def _replace_repeated(self) -> bool:
        """One round of Re-Pair; False if no pair stands twice."""
        inside = self.owner[1:] == self.owner[:-1]
        keys = np.where(inside, self.symbols[:-1] * self.next_symbol + self.symbols[1:], -1)
        codes, counts = _codes(keys)
        rank = np.where(counts > 1, np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64), 0)
        # An odd factor keeps different codes different.
        rank = np.where(rank > 0, (rank << 32) + (np.arange(len(counts)) * 2654435761 & 0xFFFFFFFF), 0)
        ranks = np.where(inside, rank[codes], 0)
        if not ranks.any():
            return False
        # Equal pairs one after another (a a a a) are one stretch: every second of them can be replaced.
        heads = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
        top = np.concatenate([[0], ranks[heads], [0]])
        chosen = (top[1:-1] > top[:-2]) & (top[1:-1] > top[2:])
        stretch = np.cumsum(np.bincount(heads, minlength=len(ranks))) - 1
        at = np.flatnonzero(chosen[stretch] & ((np.arange(len(ranks)) - heads[stretch]) % 2 == 0))
        numbers, first = pd.factorize(codes[at])
        self._replace(at, numbers, len(first))
        return True

    def _pair_off(self) -> bool:
        """Join symbols two by two inside each text; False if every text is one symbol."""
        first = np.concatenate([[True], self.owner[1:] != self.owner[:-1]])
        heads = np.flatnonzero(first)
        number = np.arange(len(first)) - heads[np.cumsum(first) - 1]
        at = np.flatnonzero((number[:-1] % 2 == 0) & ~first[1:])
        if not len(at):
            return False
        self._replace(at, np.arange(len(at)), len(at))
        return True

    def _replace(self, at: np.ndarray, numbers: np.ndarray, new: int) -> None:
        """Make the pairs that begin ``at`` the new symbols 0..new-1 (``numbers``, in order of first appearance)."""
        first = np.zeros(new, np.int64)
        first[numbers[::-1]] = at[::-1]
        self.begin.append(self.starts[first])
        self.middle.append(self.starts[first + 1])
        self.end.append(self.starts[first + 1] + self.sizes[first + 1])
        self.of.append(numbers + self.known)
        self.places.append(self.starts[at])
        self.symbols[at] = self.next_symbol + numbers
        self.sizes[at] += self.sizes[at + 1]
        keep = np.ones(len(self.symbols), bool)
        keep[at + 1] = False
        self.symbols, self.starts, self.sizes, self.owner = (x[keep] for x in (self.symbols, self.starts, self.sizes, self.owner))
        self.known += new
        self.next_symbol += new


class Windows:
    """Ranks of the windows of 1, 2, 4, ... words that stand at least twice in their text; others are all different."""

    def __init__(self, symbols: np.ndarray, owner: np.ndarray) -> None:
        self.size = len(symbols)
        span = int(symbols.max()) + 1 if self.size else 1
        ranks = self._ranked(np.arange(self.size), owner * span + symbols)
        self.levels = [(1, ranks)]
        self.six = self._ranked(np.zeros(0, np.int64), np.zeros(0, np.int64))  # windows of six words
        while (ranks >= 0).any():
            length = 2 * self.levels[-1][0]
            joined = self._joined(ranks, ranks, length // 2)
            if length == 4:
                self.six = self._joined(joined, ranks, 4)
            ranks = joined
            self.levels.append((length, ranks))

    def _ranked(self, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        ranks = -1 - np.arange(self.size + 1)
        if len(at):
            codes, counts = _codes(keys)
            twice = counts[codes] > 1
            ranks[at[twice]] = codes[twice]
        return ranks.astype(np.int32 if self.size < 2**31 - 1 else np.int64)

    def _joined(self, left: np.ndarray, right: np.ndarray, gap: int) -> np.ndarray:
        at = np.flatnonzero(left[: max(self.size - gap, 0)] >= 0)
        at = at[right[at + gap] >= 0]
        return self._ranked(at, left[at].astype(np.int64) * (self.size + 1) + right[at + gap])

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and from ``b`` on agree."""
        agreed = np.zeros(len(a), np.int64)
        for length, ranks in reversed(self.levels):
            x = ranks[np.minimum(a + agreed, self.size)]
            agreed += length * ((x >= 0) & (x == ranks[np.minimum(b + agreed, self.size)]))
        return agreed

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` and before ``b`` agree, a < b."""
        agreed = np.zeros(len(a), np.int64)
        for length, ranks in reversed(self.levels):
            i = a - agreed - length
            x = ranks[np.maximum(i, 0)]
            agreed += length * ((i >= 0) & (x >= 0) & (x == ranks[np.maximum(b - agreed - length, 0)]))
        return agreed


def _middle_runs(grammar: Grammar, windows: Windows) -> np.ndarray:
    """Rows (symbol, start, end, period): the runs inside each symbol that cross its middle, at its first place."""
    six = windows.six
    repeated = np.flatnonzero(six >= 0)
    repeated = repeated[np.argsort(six[repeated], kind="stable")]
    width = windows.size + 1
    index = six[repeated].astype(np.int64) * width + repeated  # places of equal windows, in order
    symbols = np.flatnonzero(grammar.end - grammar.begin >= SHORTEST)
    result = [np.zeros((0, 4), np.int64)]
    for back in range(WINDOW):
        for right in (True, False):
            # A run with a period right of the middle agrees with itself around the last word before the middle,
            # one with a period left of it around the first word after.
            here = grammar.middle[symbols] - back - (1 if right else 0)
            fits = (here >= grammar.begin[symbols]) & (here + WINDOW <= grammar.end[symbols])
            fits[fits] = six[here[fits]] >= 0
            of, at = symbols[fits], here[fits]
            group = six[at].astype(np.int64) * width
            if right:
                low = np.searchsorted(index, group + at, "right")
                high = np.searchsorted(index, group + grammar.end[of] - WINDOW, "right")
            else:
                low = np.searchsorted(index, group + grammar.begin[of], "left")
                high = np.searchsorted(index, group + at, "left")
            numbers = np.maximum(high - low, 0)
            before = np.cumsum(numbers) - numbers
            total = int(numbers.sum())
            for first in range(0, total, OPEN):
                ticket = np.arange(first, min(first + OPEN, total))
                row = np.searchsorted(before, ticket, "right") - 1
                other = repeated[low[row] + ticket - before[row]]
                result.append(_extended(grammar, windows, of[row], at[row], other, back))
    return _shortest_periods(np.concatenate(result))


def _extended(grammar: Grammar, windows: Windows, of: np.ndarray, at: np.ndarray, other: np.ndarray, back: int) -> np.ndarray:
    """Runs of the distance between the equal windows ``at`` and ``other``, cut off at the borders of the symbol."""
    a, b = np.minimum(at, other), np.maximum(at, other)
    start = a - np.minimum(windows.before(a, b), a - grammar.begin[of])
    once = (start == a) | (back == WINDOW - 1)  # the first window of the agreement, or the farthest that counts
    of, a, b, start = of[once], a[once], b[once], start[once]
    end = b + np.minimum(windows.after(a, b), grammar.end[of] - b)
    good = (end - start >= np.maximum(SHORTEST, 2 * (b - a))) & (start < grammar.middle[of]) & (end > grammar.middle[of])
    return _shortest_periods(np.stack([of, start, end, b - a], axis=1)[good])


def _shortest_periods(rows: np.ndarray) -> np.ndarray:
    """One row per (symbol, start, end): that of the smallest period, of which the others are multiples."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])] if len(rows) else rows


def runs_of(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), by start and period, of all maximal runs; places count through all texts."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    grammar = Grammar(symbols, lengths)
    rows = _middle_runs(grammar, Windows(symbols, owner))
    low, high = np.searchsorted(grammar.of, rows[:, 0], "left"), np.searchsorted(grammar.of, rows[:, 0], "right")
    row = np.repeat(np.arange(len(rows)), high - low)
    place = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[row]
    shift = grammar.places[place] - grammar.begin[rows[row, 0]]
    start, end, period = rows[row, 1] + shift, rows[row, 2] + shift, rows[row, 3]
    # What lies inside a longer run of its period goes.
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    reach = np.maximum.accumulate(np.unique(period, return_inverse=True)[1] * (len(symbols) + 1) + end) if len(end) else end
    maximal = np.ones(len(end), bool)
    maximal[1:] = reach[1:] > reach[:-1]
    found = _shortest_periods(np.stack([np.zeros_like(start), start, end, period], axis=1)[maximal])[:, 1:]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _in_texts(texts: list[bytes | None]) -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    words = [(text or b"").split() for text in texts]
    numbers: dict[bytes, int] = {}
    symbols = np.array([numbers.setdefault(word, len(numbers)) for text in words for word in text], np.int64)
    lengths = np.array([len(text) for text in words], np.int64)
    found = runs_of(symbols, lengths)
    change = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 1], -1)
    dropped = np.cumsum(change) > 0
    firsts = np.cumsum(lengths) - lengths
    low, high = np.searchsorted(found[:, 0], firsts), np.searchsorted(found[:, 0], firsts + lengths)
    runs, collapsed = [], []
    for text, first, a, b in zip(words, firsts.tolist(), low.tolist(), high.tolist()):
        runs.append([(start - first, end - start, period) for start, end, period in found[a:b].tolist()])
        if a < b:
            gone = dropped[first : first + len(text)].tolist()
            text = [word for word, out in zip(text, gone) if not out]
        collapsed.append(b" ".join(text).decode())
    return runs, collapsed


def periodic_runs(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and ``runs`` (start and length in words, period; by start, then period) and ``collapsed``:
    the words of the text joined by one space, each run without what follows its first period."""
    plain, at = numbered(docs), docs.columns.index("text")
    schema = StructType.fromDDL(f"runs {RUNS}, collapsed string")
    schema = StructType([*plain.schema.fields, *schema.fields])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"_c{at}", SLICE_BYTES):
            found, collapsed = _in_texts(batch.column(at).cast(pa.binary()).to_pylist())
            rows = [[dict(zip(("start", "length", "period"), one)) for one in runs] for runs in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, kind), pa.array(collapsed, pa.string())], [*batch.schema.names, "runs", "collapsed"]
            )
    return arrow_map(plain, run, schema).toDF(*docs.columns, "runs", "collapsed")


def with_loops(docs: DataFrame, one_in: int = 10) -> DataFrame:
    """``(doc_id, text)`` where one text in ``one_in`` repeats itself from some word on, as a test of the operator.

    Let h be the crc32 of the id in decimal and g = floor(h / 10). If 10 divides h, each word from a = g mod n on becomes
    word a + (i - a) mod p, p = 1 + floor((n - a) / (3 + g mod 8)). A text with a null id stays as it is.
    """
    # Java's own classes of white space are wider.
    plain = exact(docs, "doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    loops = (F.col("h") % one_in == 0) & F.col("text").isNotNull()
    words = F.when(loops, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda word: word != ""))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    listed = plain.withColumn("words", words).withColumn("a", F.when(n > 0, (g % n).cast("int")))
    period = (F.floor((n - F.col("a")) / (3 + g % 8)) + 1).cast("int")
    listed = listed.withColumn("p", period)
    rest = n - F.col("a")
    times = F.ceil(rest / F.col("p")).cast("int")
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    looped = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), rest))
    return listed.select("doc_id", F.when(n > 0, F.array_join(looped, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """``doc_id``, the number of runs, the longest one and digests of all runs and of the collapsed text."""
    runs = F.col("runs")
    longest = F.array_min(F.transform(runs, lambda run: F.struct((-run.length).alias("minus"), run.start.alias("start"), run.period.alias("period"))))
    lines = F.transform(runs, lambda run: F.concat_ws(",", run.start.cast("string"), run.length.cast("string"), run.period.cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))
    digest = found.withColumn("longest", longest)
    start, length, period = F.col("longest.start"), -F.col("longest.minus"), F.col("longest.period")
    return digest.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
