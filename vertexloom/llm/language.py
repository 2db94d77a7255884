"""Language identification by unigram models over a fixed vocabulary, summed over all segmentations.

Each language has a probability per vocabulary piece. The probability of a word is the sum over all ways to cut it
into pieces, by a forward pass over its characters; a text's is the product over its words. The pieces come from a
public vocabulary file and are never trained, their probabilities are: expectation maximisation over words of a sample.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm.common import arrow_map, exact, kept_rows, slices, worker_memory

TRAIN_DOCS = 500  # documents per language that the probabilities are learned from, about
TRAIN_WORDS = 100_000  # most frequent words of each language in them that go to the driver
ROUNDS = 4
SMOOTHING = 0.01  # added to the expected count of every piece
UNKNOWN = 1e-7  # probability of a character that no piece covers, in every language
MOST_TOKENS = 500_000  # remembered per worker; beyond that the memory starts anew
LONG = 60  # characters; longer words are summed in logarithms, and not learned from
# Sums grow by this factor per character and the logarithm takes it off again. It is a power of two, so nothing is rounded,
# and 60 characters stay within a double's range whether they are all unknown (1e-7 each) or all certain.
SCALE = 8192.0
STEP = np.uint64(0x9E3779B97F4A7C15)  # base of the polynomial hash


def letters(token: str) -> list[str]:
    import regex

    return regex.findall(r"\p{L}+", token)


@dataclass
class Vocabulary:
    """The pieces that words are cut into, in order of their hashes; ``width`` is the longest one's length."""

    hashes: np.ndarray
    width: int

    @classmethod
    def of(cls, pieces: list[str]) -> Vocabulary:
        found = {int(codes_hash(np.array([[ord(c) for c in piece]], np.uint32))[0]) for piece in pieces}
        return cls(np.array(sorted(found), dtype=np.uint64), max(map(len, pieces)))

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each piece; ``len(self.hashes)`` if it is none."""
        at = np.searchsorted(self.hashes, hashes)
        hit = self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes
        return np.where(hit, at, len(self.hashes))


def public_pieces(path: str) -> list[str]:
    """Lower-case pieces of letters from a sentencepiece file, with or without the word mark in front."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not model.is_byte(i) and not model.is_control(i)}
    mark = "\N{LOWER ONE EIGHTH BLOCK}"
    kept = {p for p in pieces if p.removeprefix(mark).isalpha() or p == mark}
    return sorted(kept | {mark})


def codes_hash(codes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(codes), dtype=np.uint64)
    for column in codes.T:
        total = total * STEP + (column.astype(np.uint64) + np.uint64(1))
    return total


def groups(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(indices, codes)`` of words of one length, the word mark in front, at most about a million characters each."""
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by_length.setdefault(len(word), []).append(i)
    for length, own in by_length.items():
        step = max(1, 400_000 // (length + 1))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            text = "".join(["\N{LOWER ONE EIGHTH BLOCK}" + words[i] for i in part])
            yield np.array(part), np.frombuffer(text.encode("utf-32-le"), dtype="<u4").reshape(len(part), length + 1)


def spans(codes: np.ndarray, vocabulary: Vocabulary) -> dict[tuple[int, int], np.ndarray]:
    """Index of the piece between every two places at most ``width`` apart."""
    count, size = codes.shape
    prefix = np.zeros((size + 1, count), dtype=np.uint64)
    for i in range(size):
        prefix[i + 1] = prefix[i] * STEP + (codes[:, i].astype(np.uint64) + np.uint64(1))
    powers = np.cumprod(np.append(np.uint64(1), np.full(vocabulary.width, STEP)))
    found = {}
    for end in range(1, size + 1):
        for start in range(max(0, end - vocabulary.width), end):
            found[start, end] = vocabulary.lookup(prefix[end] - prefix[start] * powers[end - start])
    return found


def word_scores(words: list[str], vocabulary: Vocabulary, probability: np.ndarray) -> np.ndarray:
    """Log probability of every word in every language; ``probability`` has a last row for unknown pieces of length 1."""
    result = np.zeros((len(words), probability.shape[1]))
    none = len(vocabulary.hashes)
    known = np.vstack([probability, np.zeros((1, probability.shape[1]))])  # longer unknown pieces do not count
    with np.errstate(divide="ignore", over="ignore"):
        logs = np.log(known)
        for own, codes in groups(words):
            size, count = codes.shape[1], codes.shape[0]
            if size > LONG:
                result[own] = _long(codes, vocabulary, logs, none)
                continue
            pieces = spans(codes, vocabulary)
            forward = np.zeros((size + 1, count, probability.shape[1]))
            forward[0] = 1.0
            for (start, end), piece in pieces.items():
                index = piece if end - start == 1 else np.where(piece == none, none + 1, piece)
                live = np.flatnonzero(index != none + 1)
                forward[end][live] += forward[start][live] * (known[index[live]] * SCALE ** (end - start))
            result[own] = np.log(forward[size]) - size * np.log(SCALE)
    return result


def _long(codes: np.ndarray, vocabulary: Vocabulary, logs: np.ndarray, none: int) -> np.ndarray:
    """The same sum in logarithms, keeping the last ``width`` places only."""
    count, size = codes.shape
    powers = np.cumprod(np.append(np.uint64(1), np.full(vocabulary.width, STEP)))
    prefixes, forward = [np.zeros(count, dtype=np.uint64)], [np.zeros((count, logs.shape[1]))]
    for end in range(1, size + 1):
        prefixes.append(prefixes[-1] * STEP + (codes[:, end - 1].astype(np.uint64) + np.uint64(1)))
        total = np.full((count, logs.shape[1]), -np.inf)
        for back in range(1, min(len(forward), vocabulary.width) + 1):
            piece = vocabulary.lookup(prefixes[-1] - prefixes[-1 - back] * powers[back])
            index = piece if back == 1 else np.where(piece == none, none + 1, piece)
            total = np.logaddexp(total, forward[-back] + logs[index])
        forward = [*forward[-vocabulary.width + 1 :], total]
        prefixes = prefixes[-vocabulary.width - 1 :]
    return forward[-1]


def learned(counts: dict[str, dict[str, int]], vocabulary: Vocabulary) -> np.ndarray:
    """Probability per piece (last row: unknown) and language, from word counts, by forward-backward passes."""
    none = len(vocabulary.hashes)
    columns = []
    for words in counts.values():
        names = [word for word in words if len(word) < LONG]
        weight = np.array([words[word] for word in names], dtype=np.float64)
        prepared = [(own, spans(codes, vocabulary), codes.shape[1]) for own, codes in groups(names)]
        p = np.full(none + 1, 1.0 / (none + 1))
        for _ in range(ROUNDS):
            expected = np.zeros(none + 1)
            for own, pieces, size in prepared:
                forward, backward = np.zeros((size + 1, len(own))), np.zeros((size + 1, len(own)))
                forward[0], backward[size] = 1.0, 1.0
                usable = {
                    (start, end): (piece, np.where((piece == none) & (end - start > 1), 0.0, p[piece] * SCALE ** (end - start)))
                    for (start, end), piece in pieces.items()}
                for (start, end), (_, q) in usable.items():
                    forward[end] += forward[start] * q
                for (start, end), (_, q) in reversed(usable.items()):
                    backward[start] += backward[end] * q
                share = weight[own] / np.maximum(forward[size], 1e-300)
                for (start, end), (piece, q) in usable.items():
                    expected += np.bincount(piece, forward[start] * q * backward[end] * share, minlength=none + 1)
            expected[none] = 0
            p = (expected + SMOOTHING) / (expected + SMOOTHING).sum()
            p[none] = UNKNOWN
        columns.append(p)
    return np.array(columns).T


@dataclass
class Model:
    """What tasks need: languages, vocabulary, probabilities, and scores of the tokens met so far."""

    languages: list[str]
    vocabulary: Vocabulary
    probability: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and its posterior probability per text, all languages being as likely beforehand."""
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        tokens = [text.lower().split() for text in texts]
        wanted: set[str] = set()
        for own in tokens:
            wanted.update(own)
        missing = [token for token in wanted if token not in self.known]
        if self.scores is None or len(self.known) + len(missing) > MOST_TOKENS:
            self.known, missing = {}, list(wanted)
            self.scores = np.zeros((0, len(self.languages) + 1))
        self._learn(missing)
        predicted, posterior = [], []
        for own in tokens:
            total = self.scores[[self.known[token] for token in own]].sum(axis=0) if own else np.zeros(len(self.languages) + 1)
            if not total[-1]:  # no letter
                predicted.append("und")
                posterior.append(0.0)
                continue
            best = int(np.argmax(total[:-1]))
            predicted.append(self.languages[best])
            posterior.append(float(1 / np.exp(np.minimum(total[:-1] - total[best], 0)).sum()))
        return predicted, posterior

    def _learn(self, tokens: list[str]) -> None:
        """Scores of tokens: the sums over their runs of letters, and in the last column the number of runs."""
        runs = [letters(token) for token in tokens]
        words = sorted({word for own in runs for word in own})
        place = {word: i for i, word in enumerate(words)}
        scores = word_scores(words, self.vocabulary, self.probability)
        owner = np.repeat(np.arange(len(tokens)), [len(own) for own in runs])
        rows = np.zeros((len(tokens), len(self.languages) + 1))
        np.add.at(rows[:, :-1], owner, scores[[place[word] for own in runs for word in own]] if words else np.zeros((0, len(self.languages))))
        rows[:, -1] = np.bincount(owner, minlength=len(tokens))
        start = len(self.known)
        self.known.update(zip(tokens, range(start, start + len(tokens))))
        self.scores = np.vstack([self.scores, rows])


def train(docs: DataFrame, vocabulary_path: str, docs_per_language: int = TRAIN_DOCS) -> Model:
    """Learn from text and ``lang`` of the rows of ``docs`` with a language, about ``docs_per_language`` of each.

    The sample is drawn by a hash of the text, so it is the same on every run. The driver gets word counts, at most
    ``TRAIN_WORDS`` of each language, whatever the other languages have. Without any labelled row the model knows no language and answers ``und``.
    """
    rows = exact(docs, "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    number = {row["lang"]: row["n"] for row in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(number)
    vocabulary = Vocabulary.of(public_pieces(vocabulary_path))
    if not languages:
        return Model([], vocabulary, np.zeros((0, 0)))
    rate = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, docs_per_language / number[lang]))])
    chance = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003.0
    sample = rows.filter(chance < rate[F.col("lang")])
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    by_number = Window.partitionBy("lang").orderBy(F.desc("n"), "word")  # words of at most TRAIN_DOCS texts, about
    counted = counted.withColumn("place", F.row_number().over(by_number)).filter(F.col("place") <= TRAIN_WORDS)
    counts: dict[str, dict[str, int]] = {lang: {} for lang in languages}
    for row in counted.toLocalIterator():
        counts[row["lang"]][row["word"]] = row["n"]
    return Model(languages, vocabulary, learned(counts, vocabulary))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row, from the text alone; ``und`` with score 0 for a null text or one without
    a letter. Rows with equal or null ``doc_id`` are predicted each for itself; other columns are not read."""
    rows = exact(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = model.languages, model.vocabulary, model.probability

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            predicted, posterior = _of_worker(*parts).predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(predicted, pa.string()), pa.array(posterior, pa.float64())],
                ["doc_id", "lang_pred", "score"])
    return arrow_map(rows, run, "doc_id long, lang_pred string, score double")


def _of_worker(languages: list[str], vocabulary: Vocabulary, probability: np.ndarray) -> Model:
    """The model as this Python worker knows it, with the scores of the tokens it has met."""
    return worker_memory("language", zlib.crc32(probability.tobytes()), lambda: Model(languages, vocabulary, probability))


def in_known_language(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns unchanged, whose language is recognised with a score of at least ``least``: null and
    empty texts and texts without a letter go. A model without languages rejects nothing."""
    parts = model.languages, model.vocabulary, model.probability

    def keep(texts: list[str]) -> np.ndarray:
        predicted, posterior = _of_worker(*parts).predict(texts)
        return (np.array(predicted, dtype=object) != "und") & (np.array(posterior) >= least)
    return kept_rows(docs, keep) if model.languages else docs


def held_out(doc_id: str = "doc_id", fold: int = 5, left: int = 0):
    """Whether crc32 of the id as text leaves ``left`` when divided by ``fold``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(fold)) == left


def train_and_predict(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``; learned from the rows that are not held out."""
    rows = exact(docs, "doc_id", "text", "lang")
    model = train(rows.filter(~held_out()), vocabulary_path)
    return predict(rows, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
