"""Spelling variants: words one edit apart, each with its most frequent near word and the end of that chain.

The sorted vocabulary is scanned by dynamic programming: all words that share a prefix share the row of the edit matrix
for it (adjacent common prefixes tell which), only the band of three cells that one edit can reach is kept, and a range of
the list is left as soon as its prefix is more than one edit away from the asking word. Many asking words walk down
the list at the same time, one prefix length per step.

To spread the work, a pair with one edit keeps half of the shorter word as a common prefix or as a common suffix. So each
word goes into the blocks of its two halves, for pairs in which it is the shorter and for those in which it is the longer,
and a pair is found in one block only: by the prefix if it has that in common. Blocks of more than ``most_rows`` rows are
halved in the same way on what their words don't share yet, until they are small or one code point is left.

Null words and texts count as absent, words may hold any code points. A null id is written as an empty string. Repeated
rows count as often as they occur; an empty table has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.rounds import checkpointed, settle, union_all
from vertexloom.llm.common import arrow_map, exact

LETTERS = "[A-Za-zÀ-ÿ]+"
MOST_ROWS = 100_000  # a larger block is split
TASK_ROWS = 50_000  # blocks are taken together up to this many rows
OPEN_PAIRS = 1_000_000  # (asking word, range of the list) rows that are open at once, about
NEVER = 2**31 - 1
KEY = ["tag", "path", "head", "tail"]
PAIRS = "word string, near string, near_n long"


def word_counts(docs: DataFrame, slip: int | None = None, shortest: int = 5, least: int = 3) -> DataFrame:
    """``(word, n)``: runs of Latin letters of all texts, A-Z lower-cased, at least ``shortest`` long and ``least`` often.

    With ``slip`` a run loses one code point where that number divides h, the crc32 of ``<doc_id>:<run>``: the one at
    h modulo its length.
    """
    lowered = F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase)
    runs = F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0)))
    words = exact(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), runs.alias("run"))
    word = F.col("run")
    if slip:
        words = words.withColumn("h", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")))
        at = F.col("h") % F.length("run")
        without = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        word = F.when(F.col("h") % slip == 0, without).otherwise(word)
    counts = words.select(word.alias("word")).filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= least)


def _half(tag: Column, path: str, head: Column, tail: Column, mid: Column, below: Column, front: bool) -> Column:
    """A row of a block whose words share ``head`` and ``tail``, put into the block of one half of what is between."""
    half = F.floor((tag - F.length(head) - F.length(tail)) / 2).cast("int")
    left, size = F.length(mid) - half, F.length(mid)
    if front:
        parts = (F.concat(head, F.substr(mid, F.lit(1), half)), tail, F.substr(mid, half + 1, size), below)
    else:
        bound = F.least(below, F.length(head) + half)
        parts = (head, F.concat(F.substr(mid, left + 1, half), tail), F.substr(mid, F.lit(1), left), bound)
    names = ("head", "tail", "mid", "below")
    return F.struct(tag.alias("tag"), F.lit(path).alias("path"), *[part.alias(name) for part, name in zip(parts, names)])


def _first_blocks(words: DataFrame) -> DataFrame:
    empty = F.lit("")
    halves = []
    for shorter in (0, 1):
        tag = (F.length("word") - shorter).cast("int")
        for path, front in (("F", True), ("S", False)):
            half = _half(tag, path, empty, empty, F.col("word"), F.lit(NEVER), front)
            halves.append(F.when(tag >= 1, half))
    rows = words.select("n", F.explode(F.filter(F.array(*halves), lambda row: row.isNotNull())).alias("row"))
    return rows.select("row.*", "n")


def _split_blocks(blocks: DataFrame, path: str) -> DataFrame:
    columns = [F.col(name) for name in ("tag", "head", "tail", "mid", "below")]
    tag, *rest = columns
    halves = [_half(tag, path + name, *rest, front) for name, front in (("F", True), ("S", False))]
    return blocks.select("n", F.explode(F.array(*halves)).alias("row")).select("row.*", "n")


def _blocks(words: DataFrame, most_rows: int) -> DataFrame:
    """``(tag, path, head, tail, mid, below, n)``; rows of one (tag, path, head, tail) are a block."""
    open_blocks = checkpointed(_first_blocks(words))
    finished: list[DataFrame] = []
    while True:
        free = F.col("tag") - F.length("head") - F.length("tail")
        sizes = open_blocks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows")).filter((F.col("rows") > most_rows) & (free >= 2))
        large = checkpointed(sizes.select(*KEY))
        paths = [row.path for row in large.select("path").distinct().collect()]  # at most 2^level strings of F and S
        if not paths:
            return union_all([*finished, open_blocks])
        finished.append(open_blocks.join(large, KEY, "left_anti").select(*open_blocks.columns))
        hot = open_blocks.join(large, KEY, "left_semi")
        open_blocks = checkpointed(union_all([_split_blocks(hot.filter(F.col("path") == path), path) for path in paths]))


class Ragged:
    """Strings as one array of code points."""

    def __init__(self, strings: list[str]) -> None:
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.sizes) - self.sizes
        codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes = np.append(codes, np.zeros(3, np.uint32))

    def at(self, rows: np.ndarray, place: int) -> np.ndarray:
        """Code points at ``place``; anything where the string is shorter."""
        return self.codes[np.clip(self.starts[rows] + place, 0, len(self.codes) - 1)]


def common_prefixes(words: Ragged, first: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each string and the one before it; -1 where ``first`` says that a block begins."""
    result = np.where(first, -1, 0)
    rows = np.flatnonzero(~first)
    depth = 0
    while len(rows):
        longer = np.minimum(words.sizes[rows], words.sizes[rows - 1]) > depth
        rows = rows[longer]
        rows = rows[words.at(rows, depth) == words.at(rows - 1, depth)]
        depth += 1
        result[rows] = depth
    return result


def scan(words: Ragged, prefixes: np.ndarray, asking: np.ndarray, low: np.ndarray, high: np.ndarray,
         bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asking row, row of its block [low, high)) at exactly one edit, but for those that share ``bounds`` code points."""
    alive = np.arange(len(words.sizes))
    before, here, after = np.full(len(asking), 2, np.int8), np.zeros(len(asking), np.int8), np.ones(len(asking), np.int8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    depth = 0
    while len(asking):
        # The first word of a range is the prefix itself, or all of its words go on.
        ends = words.sizes[low] == depth
        gap = words.sizes[asking] - depth
        distance = np.where(gap == 0, here, np.where(gap == 1, after, np.where(gap == -1, before, 2)))
        hit = ends & (distance == 1)
        found.append((asking[hit], low[hit]))
        low = low + ends
        keep = (low < high) & ~((here == 0) & (bounds[asking] == depth))
        asking, low, high, before, here, after = (x[keep] for x in (asking, low, high, before, here, after))
        if not len(asking):
            break
        alive = alive[words.sizes[alive] > depth]
        cuts = alive[prefixes[alive] <= depth]
        start, stop = np.searchsorted(cuts, low), np.searchsorted(cuts, high)
        numbers = stop - start
        parent = np.repeat(np.arange(len(asking)), numbers)
        place = np.arange(len(parent)) - np.repeat(np.cumsum(numbers) - numbers, numbers) + start[parent]
        low, high = cuts[place], np.minimum(np.append(cuts, len(words.sizes))[place + 1], high[parent])
        asking, before, here, after = asking[parent], before[parent], here[parent], after[parent]
        # The next row of the matrix, in the cells of its diagonal and the two beside it.
        code, size = words.at(low, depth), words.sizes[asking]
        first = np.minimum(before + (words.at(asking, depth - 1) != code), here + 1)
        first[size < depth] = 2
        second = np.minimum(np.minimum(here + (words.at(asking, depth) != code), after + 1), first + 1)
        second[size < depth + 1] = 2
        third = np.minimum(after + (words.at(asking, depth + 1) != code), second + 1)
        third[size < depth + 2] = 2
        keep = np.minimum(np.minimum(first, second), third) <= 1
        asking, low, high = asking[keep], low[keep], high[keep]
        before, here, after = (np.minimum(x[keep], 2).astype(np.int8) for x in (first, second, third))
        depth += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *[a for a, _ in found]]), np.concatenate([none, *[b for _, b in found]])


def _near(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of whole blocks; ``rows`` come sorted by key and ``mid``."""
    rows = rows.combine_chunks()
    size = rows.num_rows
    first = np.ones(size, bool)
    if size > 1:
        differ = [pc.not_equal(rows[name].slice(1), rows[name].slice(0, size - 1)) for name in KEY]
        first[1:] = np.logical_or.reduce([x.to_numpy(zero_copy_only=False) for x in differ])
    starts = np.flatnonzero(first)
    block = np.cumsum(first) - 1
    ends = np.append(starts, size)[1:]
    words = Ragged(rows["mid"].to_pylist())
    heads, tails = (pc.utf8_length(rows[name]).to_numpy().astype(np.int64) for name in ("head", "tail"))
    shorter = words.sizes + heads + tails == rows["tag"].to_numpy()
    bounds = rows["below"].to_numpy().astype(np.int64) - heads
    prefixes = common_prefixes(words, first)
    whole = pc.binary_join_element_wise(rows["head"], rows["mid"], rows["tail"], "")
    asking = np.flatnonzero(shorter & ((ends - starts)[block] > 1))
    cost = np.cumsum(np.minimum((ends - starts)[block[asking]], 8192))
    for group in np.split(asking, np.searchsorted(cost, np.arange(OPEN_PAIRS, cost[-1], OPEN_PAIRS)) if len(cost) else []):
        one, other = scan(words, prefixes, group, starts[block[group]], ends[block[group]], bounds)
        back = ~shorter[other]  # a longer word doesn't ask for itself
        word, near = np.concatenate([one, other[back]]), np.concatenate([other, one[back]])
        if len(word):
            columns = [whole.take(pa.array(word)), whole.take(pa.array(near)), rows["n"].take(pa.array(near))]
            yield from pa.table(dict(zip(("word", "near", "near_n"), columns))).to_batches()


def _near_in_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < TASK_ROWS:
            continue
        table = pa.Table.from_batches(held)
        last = [table[name][rows - 1].as_py() for name in KEY]
        same = np.logical_and.reduce([pc.equal(table[name], value).to_numpy() for name, value in zip(KEY, last)])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield from _near(table.slice(0, cut))
        held, rows = table.slice(cut).combine_chunks().to_batches(), rows - cut
    if rows:
        yield from _near(pa.Table.from_batches(held))


def near_words(words: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """``(word, near, near_n)`` for all pairs at exactly one inserted, deleted or replaced code point, in both directions."""
    blocks = _blocks(words, most_rows).repartition(*KEY).sortWithinPartitions(*KEY, "mid")
    return arrow_map(blocks.select(*KEY, "mid", "below", "n"), _near_in_tasks, PAIRS)


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``(word, form)``: jumps twice as far each round; n doubles on each form, so few are needed."""
    jumps = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = jumps.join(further, "root", "left")
        jumps, row = settle(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                            moved=F.count_if("moved"))
        jumps = jumps.drop("moved")
        if not row["moved"]:
            return jumps


def spelling_variants(words: DataFrame, ratio: int = 2, most_rows: int = MOST_ROWS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for a table ``(word, n)``.

    ``form`` is the near word of largest n (ties: the first in code-point order) if its n is at least ``ratio`` times the
    word's, else null; ``root`` is the end of the chain of forms, the word itself if it has none.
    """
    counted = exact(words, "word", "n").filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n"))
    counted = checkpointed(counted)
    near = near_words(counted, most_rows).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    )
    good = -F.col("best.minus") >= ratio * F.col("n")
    judged = checkpointed(counted.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.minus")).alias("form_n"),
    ))
    roots = _roots(judged.filter(F.col("form").isNotNull()).select("word", "form"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
