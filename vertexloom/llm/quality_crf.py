"""Document quality from a linear-chain conditional random field that labels every line good or bad.

A line's features are shares and counts read off its bytes, put into bins; the field sees those of the line and of its
two neighbours. A document's score is the mean of its lines' marginal probabilities of being good, weighted by length.
Only whole documents are labelled, so training begins with every line labelled as its document and then lets lines of
bad documents be good where the field is sure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import arrow_map, exact, kept_rows, slices

TRAIN_DOCS = 3000  # labelled documents that the weights are learned from, about
BINS = 8
PASSES = 2  # trainings; between two of them the lines of bad documents are labelled anew
STEPS = 250  # gradient steps of a training
RIDGE = 1e-4
AT_ONCE = 500_000  # bytes of text whose lines are measured at once in training, one text at least
SURE = 0.9  # a line of a bad document becomes good above this marginal

FEATURES = [
    "letters", "upper", "digits", "spaces", "marks", "high", "word_length", "words", "same_word", "distinct_words",
    "same_mark", "line_repeats", "mark_ends", "commonest_mark", "long_words", "length", "stops", "short_words",
]
_CLASS = np.zeros(256, dtype=np.uint8)  # 0 other mark, 1 letter, 2 upper, 3 digit, 4 space, 5 byte of a longer character
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[128:] = 5
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".,;:'\"?-"]] = True


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(features, weights, document)`` of every line of the texts; a text without lines has one empty line.

    Everything is counted over one array of all bytes: no loop over lines.
    """
    joined = b"\n".join(texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    sizes = np.array([len(text) for text in texts], dtype=np.int64)
    text_start = np.cumsum(sizes + 1) - sizes - 1
    ends = np.append(np.flatnonzero(data == 10), len(data))
    starts = np.append(0, ends[:-1] + 1)
    document = np.searchsorted(text_start, starts, side="right") - 1
    length = (ends - starts).astype(np.float64)
    lines = len(starts)

    kind = _CLASS[data]
    line_of = np.repeat(np.arange(lines), np.append(ends[:-1] + 1, len(data)) - starts)
    inner = data != 10
    by_kind = np.bincount((line_of * 6 + kind)[inner], minlength=lines * 6).reshape(lines, 6).astype(np.float64)
    size = np.maximum(length, 1)

    blank = kind == 4
    first = np.flatnonzero(~blank & np.append(True, blank[:-1])) if len(data) else np.empty(0, np.int64)
    last = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1 if len(data) else first
    word_line, word_size = line_of[first], last - first
    words = np.bincount(word_line, minlength=lines).astype(np.float64)
    some = np.maximum(words, 1)
    hashes = _hashes(data, first, last)
    ends_with_mark = kind[last - 1] == 0
    ends_with_other = ends_with_mark & ~_STOP[data[last - 1]]
    next_same = np.append((hashes[1:] == hashes[:-1]) & (word_line[1:] == word_line[:-1]), False) if len(first) else np.empty(0, bool)
    order = np.lexsort((hashes, word_line))
    fresh = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (word_line[order][1:] != word_line[order][:-1])) if len(first) else np.empty(0, bool)
    distinct = np.bincount(word_line[order][fresh], minlength=lines)
    mark = kind == 0
    stop = mark & _STOP[data]
    odd = mark & ~_STOP[data]
    odd_line = line_of[odd]
    odd_count = np.bincount(odd_line, minlength=lines).astype(np.float64)
    pair = np.bincount(odd_line * 64 + data[odd] % 64, minlength=lines * 64).reshape(lines, 64).max(axis=1)
    same_mark = np.append(odd[1:] & (data[1:] == data[:-1]), False) if len(data) else np.empty(0, bool)

    line_hash = np.bincount(word_line, (hashes % np.uint64(1 << 30)).astype(np.float64) * (1 + np.arange(len(first)) - np.repeat(np.cumsum(words) - words, words.astype(np.int64))), minlength=lines)
    line_order = np.lexsort((line_hash, document))
    opens = np.append(True, (line_hash[line_order][1:] != line_hash[line_order][:-1]) | (document[line_order][1:] != document[line_order][:-1]))
    group = np.cumsum(opens) - 1
    repeats = np.empty(lines)
    repeats[line_order] = np.bincount(group)[group]

    total = lambda flag: np.bincount(word_line[flag], minlength=lines) / some
    features = np.column_stack([
        (by_kind[:, 1] + by_kind[:, 2] + by_kind[:, 5]) / size, by_kind[:, 2] / size, by_kind[:, 3] / size, by_kind[:, 4] / size,
        odd_count / size, by_kind[:, 5] / size, np.bincount(word_line, word_size, minlength=lines) / some, words,
        total(next_same), distinct / some, np.bincount(line_of[same_mark], minlength=lines) / size, repeats,
        total(ends_with_other), pair / size, total(word_size > 20), length, np.bincount(line_of[stop], minlength=lines) / some,
        total(word_size <= 2),
    ])
    return features, np.maximum(length, 1), document


def _hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64 bit hash of each word, from prefix sums of its bytes times powers of an odd number."""
    if not len(first):
        return np.empty(0, dtype=np.uint64)
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.append(first, len(data)))) if first[0] == 0 else None
    if place is None:
        place = np.arange(len(data)) - np.repeat(np.append(0, first), np.diff(np.append(np.append(0, first), len(data))))
    powers = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[place]))
    return total[last] - total[first]


@dataclass
class Field:
    """Bin edges, weights per (place, feature, bin) for being good, and the chain's start and transition scores."""

    edges: np.ndarray
    weights: np.ndarray
    transition: np.ndarray

    @classmethod
    def empty(cls, features: np.ndarray) -> Field:
        edges = np.quantile(features, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
        return cls(edges, np.zeros(3 * len(FEATURES) * (BINS + 1)), np.zeros((2, 2)))

    def indices(self, features: np.ndarray, document: np.ndarray) -> np.ndarray:
        """Weight index of each feature of the line and of its neighbours, a row per feature and place; outside of the
        document there is a bin of its own."""
        own = np.column_stack([np.searchsorted(edges, column, side="left") for edges, column in zip(self.edges, features.T)])
        before = np.full_like(own, BINS)
        after = np.full_like(own, BINS)
        inside = document[1:] == document[:-1]
        before[1:][inside] = own[:-1][inside]
        after[:-1][inside] = own[1:][inside]
        rows = np.concatenate([own, before, after], axis=1).T.astype(np.int32, order="C")
        return rows + np.arange(len(rows), dtype=np.int32)[:, None] * np.int32(BINS + 1)

    def emission(self, indices: np.ndarray) -> np.ndarray:
        total = np.zeros(indices.shape[1])
        for row in indices:
            total += self.weights[row]
        return total

    def marginals(self, emission: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of good per line, and the expected transitions ``(2, 2)``, by forward-backward over all documents
        at once: one step per place in a document."""
        starts = np.flatnonzero(np.append(True, document[1:] != document[:-1]))
        sizes = np.diff(np.append(starts, len(document)))
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        score = np.stack([np.zeros_like(emission), emission], axis=1)
        forward, backward = score.copy(), np.zeros_like(score)
        live = [int(np.searchsorted(-sizes, -place, side="left")) for place in range(sizes[0] if len(sizes) else 0)]
        for place in range(1, len(live)):
            at = starts[: live[place]] + place
            came = forward[at - 1][:, :, None] + self.transition
            forward[at] = score[at] + np.logaddexp(came[:, 0], came[:, 1])
        for place in range(len(live) - 1, 0, -1):
            at = starts[: live[place]] + place
            goes = self.transition + (score[at] + backward[at])[:, None, :]
            backward[at - 1] = np.logaddexp(goes[:, :, 0], goes[:, :, 1])
        both = forward + backward
        whole = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - whole)
        inside = np.flatnonzero(document[1:] == document[:-1])
        pair = forward[inside][:, :, None] + self.transition + (score + backward)[inside + 1][:, None, :] - whole[inside][:, None, None]
        return good, np.exp(pair).sum(axis=0)

    def fit(self, indices: np.ndarray, document: np.ndarray, good: np.ndarray, weight: np.ndarray) -> None:
        """Gradient ascent (Adam) on the log likelihood of the line labels."""
        inside = document[1:] == document[:-1]
        seen = np.zeros((2, 2))
        np.add.at(seen, (good[:-1][inside].astype(int), good[1:][inside].astype(int)), 1.0)
        parameters = np.concatenate([self.weights, self.transition.ravel()])
        mean, square, n = np.zeros_like(parameters), np.zeros_like(parameters), len(good)
        for step in range(1, STEPS + 1):
            self.weights, self.transition = parameters[:-4], parameters[-4:].reshape(2, 2)
            marginal, pairs = self.marginals(self.emission(indices), document)
            difference = (good - marginal) * weight / n
            own = np.zeros(len(self.weights))
            for row in indices:
                own += np.bincount(row, difference, minlength=len(own))
            gradient = np.concatenate([own, (seen - pairs).ravel() / n]) - RIDGE * parameters
            mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
            parameters = parameters + 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        self.weights, self.transition = parameters[:-4], parameters[-4:].reshape(2, 2)

    def score(self, texts: list[bytes]) -> np.ndarray:
        features, weight, document = line_features(texts)
        good, _ = self.marginals(self.emission(self.indices(features, document)), document)
        total = np.bincount(document, weight, minlength=len(texts))
        return np.clip(np.bincount(document, weight * good, minlength=len(texts)) / total, 0.0, 1.0)


def _features_in_parts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(features, document)`` as of ``line_features``, some texts at a time: it needs about forty times their size."""
    features, documents, first = [], [], 0
    while first < len(texts):
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) <= AT_ONCE:
            size += len(texts[last])
            last += 1
        own, _, document = line_features(texts[first:last])
        features.append(own)
        documents.append(document + first)
        first = last
    return np.concatenate(features), np.concatenate(documents)


def learned(texts: list[bytes], quality: np.ndarray) -> Field:
    features, document = _features_in_parts(texts)
    field = Field.empty(features)
    indices = field.indices(features, document)
    labels = quality[document].astype(np.float64)
    lines = np.bincount(document, minlength=len(texts))
    weight = lines.mean() / lines[document]  # every document counts the same
    for training in range(PASSES):
        field.fit(indices, document, labels, weight)
        if training + 1 < PASSES:
            good, _ = field.marginals(field.emission(indices), document)
            flipped = (labels == 0) & (good > SURE)
            rest = np.bincount(document[(labels == 0) & ~flipped], minlength=len(texts))
            labels = np.where(flipped & (rest[document] > 0), 1.0, labels)
    return field


def train(docs: DataFrame, labels: DataFrame, most_docs: int = TRAIN_DOCS) -> Field | None:
    """Learn from labelled documents, about ``most_docs`` of them, drawn by a hash of the id.

    Only these go to the driver. Null labels and texts are left out; an id that is labelled more than once counts per
    label. None if not both qualities occur.
    """
    known = exact(labels, "doc_id", "quality").filter(F.col("quality").isin(0, 1))
    number = known.count()
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0 < min(1.0, most_docs / max(1, number)))
    rows = exact(docs, "doc_id", "text").filter(F.col("text").isNotNull()).join(chosen, "doc_id").select("quality", "text")
    sample = sorted((row["text"], row["quality"]) for row in rows.toLocalIterator())
    if len({quality for _, quality in sample}) < 2:
        return None
    return learned([text.encode() for text, _ in sample], np.array([quality for _, quality in sample], dtype=np.int64))


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """``(doc_id, score)`` per row, from the text alone; null counts as empty, an empty text as one empty line.

    Without a trained field every score is 0.5. Rows with equal or null ``doc_id`` are scored each for itself.
    """
    rows = exact(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            scores = field.score(texts) if field else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])
    return arrow_map(rows, run, "doc_id long, score double")


def of_quality(docs: DataFrame, field: Field | None, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns unchanged, with a score of at least ``threshold``; all without a trained field."""
    if field is None:
        return docs
    return kept_rows(docs, lambda texts: field.score([text.encode() for text in texts]) >= threshold)


def train_and_score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; learned from labels of the rows that are not held out."""
    from vertexloom.llm.language import held_out

    own = held_out("doc_id", 4, 2)
    field = train(docs, exact(labels, "doc_id", "quality").filter(~own))
    scored = score(docs, field)
    return scored.select("doc_id", own.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
