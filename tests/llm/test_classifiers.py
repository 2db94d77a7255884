"""Language and quality: sums and marginals against enumeration, held-out accuracy, odd rows; and the whole pipeline."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm.test_neighbours import brute_join, runs_of_fifty
from tests.llm.test_tokens import check_packing
from vertexloom.llm import common, language, quality_crf

PIECES = public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.01"


def segmentations(word: str):
    if not word:
        yield []
    for end in range(1, len(word) + 1):
        for rest in segmentations(word[end:]):
            yield [word[:end], *rest]


def test_forward_sums_all_segmentations(monkeypatch):
    mark = "\N{LOWER ONE EIGHTH BLOCK}"
    names = [mark, "a", "b", "ab", "ba", "aba", mark + "a", mark + "ab"]
    vocabulary = language.Vocabulary.of(names)
    random = np.random.default_rng(0)
    table = random.random((len(names) + 1, 2))
    table[-1] = language.UNKNOWN
    index = {name: int(vocabulary.lookup(language.codes_hash(np.array([[ord(c) for c in name]], np.uint32)))[0]) for name in names}
    words = ["a", "ab", "abab", "babba", "axb", "aab"]
    expected = []
    for word in words:
        total = np.zeros(2)
        for pieces in segmentations(mark + word):
            if all(piece in index or len(piece) == 1 for piece in pieces):
                total += np.prod([table[index.get(piece, len(names))] for piece in pieces], axis=0)
        expected.append(np.log(total))
    assert np.allclose(language.word_scores(words, vocabulary, table), expected)
    monkeypatch.setattr(language, "SCALE", 1.0)
    assert np.allclose(language.word_scores(words, vocabulary, table), expected)
    monkeypatch.setattr(language, "LONG", 1)
    assert np.allclose(language.word_scores(words, vocabulary, table), expected)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {row.doc_id: row for row in language.train_and_predict(docs, PIECES).collect()}
    truth = {row.doc_id: row.lang for row in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, row in rows.items() if row.held_out} == set(held) and len(rows) == len(truth)
    assert np.mean([rows[i].lang_pred == truth[i] for i in held]) > 0.99
    assert all(0 <= row.score <= 1 for row in rows.values())


ODD = [(1, "the and of thing", "en"), (2, None, "en"), (3, "", None), (4, "123 ... !!", "de"), (None, "der die und", "de"),
       (5, "der und die " * 9, "de"), (5, "漢字 漢字", None), (6, "x" * 400, "en"), (7, "der" * 3000, None), (5, "der und die " * 9, "de")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*row, "t", 3) for row in ODD], "doc_id long, text string, lang string, TEXT string, score int")


def test_language_of_odd_rows(spark, odd):
    model = language.train(odd, PIECES)
    got = defaultdict(list)
    for row in language.predict(odd, model).collect():
        got[row.doc_id].append((row.lang_pred, row.score))
    assert sum(map(len, got.values())) == len(ODD)
    for i in (2, 3, 4):
        assert got[i] == [("und", 0.0)]
    assert got[1][0][0] == "en" and got[None][0][0] == "de" and {x for x, _ in got[5]} <= {"de", "en"}
    kept = language.in_known_language(odd, model)
    assert kept.columns == odd.columns and kept.filter("doc_id IN (2, 3, 4)").count() == 0
    assert language.predict(odd.limit(0), model).count() == 0
    nothing = language.train(odd.limit(0), PIECES)
    assert {(row.lang_pred, row.score) for row in language.predict(odd, nothing).collect()} == {("und", 0.0)}
    assert language.in_known_language(odd, nothing).count() == len(ODD)


def test_words_without_pieces_have_a_score(spark, odd):
    """Up to and beyond the length where sums go over to logarithms."""
    model = language.train(odd, PIECES)
    strange = [letter * n for letter in ("ሀ", "漢", "zqj") for n in (15, 20, 44, 45, 46, 50, 54, 58, 59, 60, 61, 70)]
    direct = language.word_scores(strange, model.vocabulary, model.probability)
    assert np.isfinite(direct).all()
    logs = np.log(np.vstack([model.probability, np.full((1, model.probability.shape[1]), 1e-320)]))
    for word, row in zip(strange, direct):
        codes = np.array([[ord(c) for c in "\N{LOWER ONE EIGHTH BLOCK}" + word]], np.uint32)
        assert np.allclose(language._long(codes, model.vocabulary, logs, len(model.vocabulary.hashes))[0], row)
    good = "der und die Stadt in der Liebe und das Haus der Leute "
    docs = spark.createDataFrame([(i, f"{good}{word} {good}") for i, word in enumerate(strange)], "doc_id long, text string")
    assert {(row.lang_pred, 0 <= row.score <= 1) for row in language.predict(docs, model).collect()} == {("de", True)}
    assert language.in_known_language(docs, model).count() == len(strange)
    alone = spark.createDataFrame([(i, word) for i, word in enumerate(strange)], "doc_id long, text string")
    assert all(0 <= row.score <= 1 for row in language.predict(alone, model).collect())


def test_workers_keep_one_owner(monkeypatch):
    monkeypatch.setattr(common, "_KEPT", {})
    made = []
    def get(owner, key):
        return common.worker_memory(owner, key, lambda: made.append((owner, key)) or (owner, key))
    for owner, key in [("a", 1), ("a", 2), ("a", 1), ("b", 1), ("a", 1)]:
        assert get(owner, key) == (owner, key)
    assert made == [("a", 1), ("a", 2), ("b", 1), ("a", 1)]


def test_training_words_are_bounded_per_language(spark, monkeypatch):
    monkeypatch.setattr(language, "TRAIN_WORDS", 2)
    taught: dict = {}
    monkeypatch.setattr(language, "learned", lambda counts, vocabulary: taught.update(counts) or np.zeros((1, len(counts))))
    rows = [("aa aa aa bb bb cc", "en"), ("dd dd ee ff", "zz")]
    language.train(spark.createDataFrame(rows, "text string, lang string"), PIECES)
    assert taught == {"en": {"aa": 3, "bb": 2}, "zz": {"dd": 2, "ee": 1}}


def test_marginals_against_enumeration():
    random = np.random.default_rng(3)
    field = quality_crf.Field(np.zeros((0, 0)), np.zeros(0), random.standard_normal((2, 2)))
    document = np.array([0, 0, 0, 1, 2, 2, 2, 2])
    emission = random.standard_normal(8)
    good, pairs = field.marginals(emission, document)
    expected_pairs = np.zeros((2, 2))
    for own in range(3):
        at = np.flatnonzero(document == own)
        total, marginal, seen = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=len(at)):
            p = np.exp(sum(emission[i] * y for i, y in zip(at, labels)) + sum(field.transition[a, b] for a, b in zip(labels, labels[1:])))
            total += p
            marginal += p * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                seen[a, b] += p
        assert np.allclose(good[at], marginal / total)
        expected_pairs += seen / total
    assert np.allclose(pairs, expected_pairs)


def test_features_do_not_depend_on_neighbouring_documents():
    texts = [b"A b.\nc c c\n\n", b"", b"THE!! END!!\nx | y | z", b"one", "é à ü\n漢字".encode(), b"\n"]
    features, weight, document = quality_crf.line_features(texts)
    assert Counter(document.tolist()) == {i: text.count(b"\n") + 1 for i, text in enumerate(texts)}
    for i, text in enumerate(texts):
        alone, own_weight, _ = quality_crf.line_features([text])
        assert np.allclose(features[document == i], alone) and np.allclose(weight[document == i], own_weight)


def test_training_measures_some_texts_at_a_time(monkeypatch):
    import tracemalloc

    random = np.random.default_rng(5)
    texts = [" ".join(random.choice(["some", "words", "|", "of", "Text.", "12"], 60).tolist()).encode() * 3 + b"\nx y\n" for _ in range(2500)]
    quality = np.arange(len(texts)) % 2
    monkeypatch.setattr(quality_crf, "STEPS", 2)
    monkeypatch.setattr(quality_crf, "AT_ONCE", 10**9)
    whole = quality_crf.learned(texts, quality)
    monkeypatch.undo()
    monkeypatch.setattr(quality_crf, "STEPS", 2)
    tracemalloc.start()
    try:
        parts = quality_crf.learned(texts, quality)
        assert tracemalloc.get_traced_memory()[1] < 25 * sum(map(len, texts))
    finally:
        tracemalloc.stop()
    for name in ("edges", "weights", "transition"):
        assert np.array_equal(getattr(parts, name), getattr(whole, name))


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("documents", "labels"))
    rows = {row.doc_id: row for row in quality_crf.train_and_score(docs, labels).collect()}
    truth = {row.doc_id: row.quality for row in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(rows) == docs.count() and all(rows[i].held_out for i in held)
    assert all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.7) for row in rows.values())
    good, bad = ([rows[i].score for i in held if truth[i] == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([rows[i].predicted == truth[i] for i in held]) > 0.95


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, None, 1), (None, 1, 1), (1, 1, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    field = quality_crf.train(odd, labels)
    got = quality_crf.score(odd, field).collect()
    assert len(got) == len(ODD) and all(0 <= row.score <= 1 for row in got)
    kept = quality_crf.of_quality(odd, field, 0.0)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert quality_crf.score(odd.limit(0), field).count() == 0
    assert quality_crf.train(odd, labels.filter("quality = 1")) is None and quality_crf.train(odd.limit(0), labels) is None
    assert {row.score for row in quality_crf.score(odd, None).collect()} == {0.5}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small folder of tables: part of the given documents, with odd rows and columns with clashing names beside them."""
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 260")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "12 34", "en", "s", 5),
                                 (None, "der und die Liebe in der Stadt", "de", "s", 30)], docs.schema)
    first = docs.filter("doc_id = 3")
    docs.unionByName(odd).unionByName(first).selectExpr("*", "1 AS row", "2 AS spans", "3 AS _c0").write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline(spark, corpus):
    """Every stage against a plain version of it on the same input."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, labels = docs.columns, {row.doc_id: row.quality for row in spark.read.parquet(f"{corpus}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality", "ngram_jaccard", "substring_dedup", "best_fit_packing"]

    def rows(df):
        return [tuple(row) for row in df.collect()]

    known = stages["language_id"](spark, docs, corpus)
    gone = Counter(rows(docs)) - Counter(rows(known))
    assert known.columns == columns and {row[0] for row in gone} == {9001, 9002, 9003} and not Counter(rows(known)) - Counter(rows(docs))

    good = stages["quality"](spark, known, corpus)
    left = {row[0] for row in rows(good)}
    assert good.columns == columns and not Counter(rows(good)) - Counter(rows(known))
    judged = [(i in left) == (labels[i] == 1) for i in labels if i < 260]
    assert np.mean(judged) > 0.95

    single = stages["ngram_jaccard"](spark, good, corpus)
    before = [(row[0], row[1]) for row in rows(good)]
    lowest = {i for i, (n, component) in brute_join([x for x in before if x[0] is not None]).items() if component == i}
    assert single.columns == columns
    assert Counter(row[0] for row in rows(single)) == Counter({i: 1 for i in lowest | {None}})

    cut = stages["substring_dedup"](spark, single, corpus)
    assert cut.columns == columns and not runs_of_fifty([(row[0], row[1]) for row in rows(cut)])
    repeated = runs_of_fifty([(row[0], row[1]) for row in rows(single)])
    unchanged = Counter(row for row in rows(single) if row[0] not in repeated)
    assert sum((unchanged - Counter(rows(cut))).values()) <= 0.05 * len(rows(cut))  # near passages may be cut as well

    packed = stages["best_fit_packing"](spark, cut, corpus)
    check_packing(packed.collect(), [(row[0], row[1] or "") for row in rows(cut)], 2048)


def test_run_writes_and_rereads_each_stage(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
    whole = corpus_pipeline.run(spark, corpus)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, whole.select(names).collect())) == Counter(map(tuple, docs.select(names).collect()))
