"""Near-duplicate and nearest vectors, components, n-gram joins and passages against brute force."""

from __future__ import annotations

import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from vertexloom.functions.rounds import scratch_path
from vertexloom.llm import passages, shingle_join
from vertexloom.llm.ann import nearest, survivors
from vertexloom.llm.common import drop_stored, stored
from vertexloom.llm.linking import components, roots
from vertexloom.llm.near_vectors import near_vectors
from vertexloom.llm.passages import cut_passages, repeated_passages, without
from vertexloom.llm.shingle_join import linked_documents, one_of_each_group


def lowest_reachable(links) -> dict[int, int]:
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(200)],
    [(0, i) for i in range(1, 500)] + [(5000 + i, 5001 + i) for i in range(20)] + [(7, 7)],
    np.random.default_rng(1).integers(0, 900, (800, 2)).tolist(),
    [],
])
@pytest.mark.parametrize("few", [0, 20_000])
def test_components(spark, links, monkeypatch, few):
    monkeypatch.setattr("vertexloom.llm.linking.FEW_LINKS", few)
    expected = lowest_reachable([(a, b) for a, b in links if a != b])
    got = {row.id: row.component for row in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == expected


def test_roots():
    a, b = np.array([3, 4, 1, 8]), np.array([4, 5, 2, 8])
    assert roots(a, b, 9).tolist() == [0, 1, 1, 3, 3, 3, 6, 7, 8]


def vector_rows() -> list[tuple]:
    """Clusters around the threshold, copies, odd vectors, null labels and other lengths."""
    random = np.random.default_rng(2)
    rows, centres = [], random.standard_normal((30, 16))
    for i in range(400):
        centre = centres[i % 30]
        rows.append(centre + random.standard_normal(16) * [0.05, 0.2, 0.28, 0.4, 1.0][i % 5])
    rows += [rows[0].copy() for _ in range(60)] + [rows[1] * 3.0, -rows[1], np.ones(8), np.ones(8) * 2, rows[2]]
    labels = [i % 30 % 3 for i in range(400)] + [0] * 60 + [1, 1, 1, 1, None]
    made = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(zip(rows, labels))]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] * 16]
    return made + [(1000 + i, v, 0) for i, v in enumerate(odd)]


def unit(v):
    if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
        return None
    return np.array(v) / np.sqrt(np.dot(v, v))


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, v, label, "x", 1) for i, v, label in vector_rows()]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, EMBEDDING string, n long")


@pytest.mark.parametrize("block", [512, 16])
def test_near_vectors(spark, vectors, monkeypatch, block):
    monkeypatch.setattr("vertexloom.llm.near_vectors.BLOCK", block)
    rows = [(i, unit(v), label) for i, v, label in vector_rows()]
    links = [(a, b) for a, u, k in rows for b, w, m in rows if a < b and u is not None and w is not None
             and k is not None and k == m and len(u) == len(w) and u @ w >= 0.93]
    count, lowest = Counter(x for link in links for x in link), lowest_reachable(links)
    expected = {i: (count[i], lowest.get(i, i), lowest.get(i, i) == i) for i, _, _ in rows}
    got = {row.vec_id: (row.n_links, row.component_id, row.kept) for row in near_vectors(vectors).collect()}
    assert got == expected and len(links) > 1000
    assert near_vectors(vectors.limit(0)).count() == 0


def test_nearest(spark, vectors):
    rows = [(i, unit(v)) for i, v, _ in vector_rows()]
    expected = {}
    for q, u in rows:
        if q % 50 == 0 and u is not None:
            near = [(-float(u @ w), i) for i, w in rows if i != q and w is not None and len(w) == len(u)]
            expected[q] = sorted((round(s, 9), i) for s, i in near)[:5]
    got = defaultdict(list)
    for row in sorted(nearest(vectors).collect(), key=lambda row: (row.query_id, row["rank"])):
        assert row["rank"] == len(got[row.query_id]) + 1
        got[row.query_id].append((round(-row.score, 9), row.vec_id))
    assert set(got) == set(expected)
    hits = sum(len(set(got[q]) & set(expected[q])) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    assert [i for _, i in got[0]][:5] == [400, 401, 402, 403, 404]  # copies: ties to the smaller id
    assert nearest(vectors.limit(0)).count() == 0
    assert [tuple(row) for row in nearest(vectors.filter("vec_id IN (50, 80)")).select("query_id", "vec_id").collect()] == [(50, 80)]


def test_survivors_keep_the_nearest():
    random = np.random.default_rng(0)
    rows, queries = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (random.standard_normal((500, 64)), random.standard_normal((40, 64))))
    q, r = survivors(queries, rows, 6)
    best = np.argsort(-(queries @ rows.T), axis=1)[:, :5]
    kept = set(zip(q.tolist(), r.tolist()))
    assert len(kept) < 0.5 * 500 * 40
    assert sum((i, j) in kept for i in range(40) for j in best[i].tolist()) >= 0.95 * 200


# ---- texts ----

SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_list(text):
    return SPLIT.findall((text or "").encode().translate(LOWER))


def text_rows() -> list[tuple]:
    """Groups of near copies at many similarities, a chain, a large group of copies, short and odd texts."""
    random = np.random.default_rng(4)
    fresh = lambda n: [f"w{x}" for x in random.integers(0, 10**6, n)]
    texts: list[str | None] = []
    for length in (6, 12, 40, 90, 300):
        base = fresh(length)
        for changes in range(12):
            own = list(base)
            for at in random.integers(0, length, changes // 2):
                own[at] = f"x{random.integers(10**6)}"
            texts.append(" ".join(own))
    chain = fresh(120)
    for _ in range(8):
        texts.append(" ".join(chain))
        chain = chain[4:] + fresh(4)
    line = fresh(30)
    texts += [" ".join(fresh(10) + line + fresh(10)) for _ in range(30)]
    texts += ["same words of a copy that occurs many times over"] * 50
    texts += [None, "", "  \n", "one", "ONE", "two words", "Two\tWORDS ", "a b c d", "a b c d e", "a b c d e f", "a a a a a a a a", "a a a a a", "é é é é é"]
    return [(i, text) for i, text in enumerate(texts)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, text, "en", "s", 1, 2) for i, text in text_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, TEXT int").repartition(5)


def brute_join(rows):
    sets = {}
    for i, text in rows:
        own = word_list(text)
        sets[i] = frozenset(tuple(own[k : k + 5]) for k in range(len(own) - 4)) if len(own) >= 5 else frozenset([tuple(own)] if own else [])
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    lowest = lowest_reachable(links)
    return {i: (len(s), lowest.get(i, i)) for i, s in sets.items()}


@pytest.mark.parametrize("block, bits", [(1024, 20), (8, 10)])
def test_linked_documents(spark, texts, monkeypatch, block, bits):
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    got = {row.doc_id: (row.n_shingles, row.component_id) for row in linked_documents(texts).collect()}
    assert got == brute_join(text_rows())
    if bits == 20:
        assert linked_documents(texts.limit(0)).count() == 0


def test_bounds_never_rule_out_a_link():
    """Open pairs of one list: all that link and are not connected must stay, whatever the leader."""
    import pyarrow as pa

    random = np.random.default_rng(7)
    base = random.integers(0, 10**6, 60)
    sets = [sorted({*base[random.random(60) < 0.95].tolist(), *random.integers(0, 10**6, 3).tolist()}) for _ in range(40)]
    shared = [s for s in sets if set(s) & set(sets[0])]
    lead = set(shared[0])
    rows = pa.table({
        "key": [0] * len(shared), "low": [0] * len(shared), "high": [0] * len(shared), "block": [0] * len(shared),
        "place": [0] * len(shared), "node": list(range(len(shared))), "n": [len(s) for s in shared], "leader": [0] * len(shared),
        "overlap": [len(lead & set(s)) for s in shared],
        "component": list(range(len(shared))), "earlier": [[]] * len(shared)})
    open_ = set(map(tuple, shingle_join._block_pairs(rows).tolist()))
    for a in range(len(shared)):
        for b in range(a):
            one, two = set(shared[a]), set(shared[b])
            if 100 * len(one & two) >= 80 * len(one | two):
                assert (b, a) in open_


def test_blocks_are_skipped_by_place_and_no_link_with_them():
    random = np.random.default_rng(3)
    size = 6 * shingle_join.SKIP
    n = random.integers(40, 60, size)
    place = np.sort(random.integers(0, 30, size))  # rows of a list come by rising place
    left = right = np.arange(size)
    meeting = shingle_join._meeting(n, n - place, left, right)
    possible = np.minimum((n - place)[:, None], n - place) >= shingle_join.least_overlap(n[:, None], n)
    possible &= (n * 100 >= n[:, None] * 80) & (n * 80 <= n[:, None] * 100)
    of_blocks = possible.reshape(6, shingle_join.SKIP, 6, shingle_join.SKIP).any(axis=(1, 3))
    assert (meeting | ~of_blocks).all()
    assert not meeting[:, -1].any() and not meeting[-1].any() and meeting[0, 0] and 11 <= (~meeting).sum() < 36


def test_groups_joined_by_further_links(spark):
    links = lambda *pairs: spark.createDataFrame(list(pairs), "a long, b long")
    groups = shingle_join.components(links((1, 2), (2, 3), (5, 6), (8, 9)))
    joined = shingle_join._joined(groups, links((3, 6), (12, 11), (9, 10), (4, 10), (5, 1)))
    expected = {1: 1, 2: 1, 3: 1, 5: 1, 6: 1, 11: 11, 12: 11, 4: 4, 8: 4, 9: 4, 10: 4}
    assert {row.id: row.component for row in joined.collect()} == expected
    assert joined.count() == len(expected)
    assert shingle_join._joined(groups, links((1, 2)).limit(0)).count() == 7


def test_one_of_each_group(spark, texts):
    expected = brute_join(text_rows())
    kept = one_of_each_group(texts)
    assert kept.columns == texts.columns
    # Texts that differ in case alone are one set too; documents without words stay.
    assert sorted(row[0] for row in kept.collect()) == sorted(i for i, (n, lowest) in expected.items() if lowest == i)
    again = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "A b"), (None, None), (2, None)], "doc_id long, text string")
    assert sorted(map(str, one_of_each_group(again).collect())) == sorted(
        ["Row(doc_id=1, text='a b')", "Row(doc_id=None, text=None)", "Row(doc_id=2, text=None)"])


def passage_rows() -> list[tuple]:
    random = np.random.default_rng(9)
    fresh = lambda n: [f"v{x}" for x in random.integers(0, 10**6, n)]
    passage, long, line, edited = fresh(55), fresh(400), fresh(20), fresh(120)
    rows = [fresh(int(n)) + passage + fresh(30) for n in random.integers(0, 90, 25)]
    rows += [fresh(40) + long + fresh(5), long, fresh(3) + long[100:260] + fresh(60)]
    rows += [fresh(50) + line + fresh(50) for _ in range(20)]  # too short to repeat
    near = list(edited)
    near[60] = "other"
    rows += [fresh(20) + edited + fresh(20), fresh(9) + near + fresh(40)]
    rows += [["again"] * 300, fresh(10) + ["again"] * 120, fresh(80), [], ["short"], fresh(49)]
    made = [(i, " ".join(own)) for i, own in enumerate(rows)]
    return made + [(500, None), (501, " ".join(long)), (501, "another text of the same id")]


@pytest.fixture(scope="module")
def passage_docs(spark):
    rows = [(i, text, "en", "s", len(text or ""), "z") for i, text in passage_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Text string").repartition(6)


def runs_of_fifty(rows) -> set[int]:
    seen = defaultdict(set)
    for at, (i, text) in enumerate(rows):
        own = word_list(text)
        for k in range(len(own) - 49):
            seen[tuple(own[k : k + 50])].add((at, i))
    return {i for own in seen.values() if len({at for at, _ in own}) > 1 for _, i in own}


def test_repeated_passages(spark, passage_docs):
    rows = passage_rows()
    found = repeated_passages(passage_docs).collect()
    named = {row.doc_id for row in found} | {row.source_doc_id for row in found}
    must = runs_of_fifty(rows)
    assert must <= named <= must | {48, 49}  # 48 and 49 share an edited passage
    assert {48, 49} <= named
    text_of = {i: word_list(text) for i, text in rows if not (text or "").startswith("another")}
    for row in found:
        own = set(zip(*[text_of[row.doc_id][row.start : row.start + row.n_words][k:] for k in range(5)]))
        other = set(zip(*[text_of[row.source_doc_id][row.source_start : row.source_start + row.n_words + 5][k:] for k in range(5)]))
        assert len(own & other) >= 0.8 * len(own)
    assert repeated_passages(passage_docs.limit(0)).count() == 0


def test_cut_passages(spark, passage_docs):
    rows = dict(passage_rows()[:-1])
    cut = cut_passages(passage_docs)
    assert cut.columns == passage_docs.columns
    left = [(row[0], row[1]) for row in cut.collect()]
    assert not runs_of_fifty(left)
    assert all(row[4] == len(row[1] or "") for row in cut.collect())
    touched = {row.doc_id for row in repeated_passages(passage_docs).collect()}
    for i, text in left:
        if i not in touched:
            assert text == rows[i]
    kept = [text or "" for _, text in left]
    for at in (0, 25):  # one copy of each passage stays
        own = word_list(rows[at])[-40:-30]
        assert sum(b" ".join(own) in b" ".join(word_list(text)) for text in kept) == 1


def test_without():
    assert without(b" a b  c d\ne f ", [(1, 2), (4, 9)]) == b" a d\n"
    assert without(b"a b", [(0, 2)]) == b"" and without(b"a b", []) == b"a b"


def test_every_start_has_the_node_of_its_smallest_value():
    random = np.random.default_rng(0)
    values = random.integers(0, 2**63, 900).astype(np.uint64)
    values[100:300], values[300:400] = values[100], np.tile(values[300:310], 10)
    low, high = np.array([0, 50, 420]), np.array([50, 420, 900])
    starts, c = passages.starts_of(passages.nodes(values, low, high, 46), 46)
    for a, b in zip(low, high):
        for s in range(a, b - 45):
            assert c[np.searchsorted(starts, s, side="right") - 1] == s + np.argmin(values[s : s + 46])


def fresh_words(random, count: int) -> list[str]:
    return [f"w{x}" for x in random.integers(0, 10**9, count)]


def placed(passage: list[str], random) -> str:
    return " ".join([*fresh_words(random, int(random.integers(20, 60))), *passage, *fresh_words(random, int(random.integers(20, 60)))])


def named_documents(spark, texts: list[str]) -> set[int]:
    found = repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(row.similarity >= 0.8 for row in found)
    return {row.doc_id for row in found} | {row.source_doc_id for row in found}


@pytest.mark.parametrize("block", [16, 1024])
def test_passages_among_many_texts_of_one_key(spark, monkeypatch, block):
    monkeypatch.setattr(passages, "BLOCK", block)
    random = np.random.default_rng(5)
    line = fresh_words(random, 24)
    alone = [placed(line, random) for _ in range(120)]
    pairs = []
    for i in range(60):
        own = [*fresh_words(random, 13), *line, *fresh_words(random, 13)]
        other = list(own)
        if i % 2:
            other[6] = "edited"
        pairs += [placed(own, random), placed(other, random)]
    named = named_documents(spark, [*alone, *pairs])
    assert named == set(range(120, 240))


def test_passages_of_fifty_words_led_by_another_text(spark):
    random = np.random.default_rng(6)
    texts = []
    for _ in range(40):
        shared = fresh_words(random, 20)
        own = [*fresh_words(random, 15), *shared, *fresh_words(random, 15)]
        texts += [placed(own, random), placed(own, random), *[placed(shared, random) for _ in range(3)]]
    assert named_documents(spark, texts) == {i for i in range(200) if i % 5 < 2}


def test_recall_of_short_edited_passages(spark):
    random = np.random.default_rng(7)
    texts = []
    for _ in range(200):
        own = fresh_words(random, 50)
        texts += [placed(own, random), placed([*own[:25], "edited", *own[26:]], random)]
    assert passages.FUNCTIONS == 6 and 0.2**6 <= passages.MISSED
    assert named_documents(spark, texts) == set(range(400))


def tables_made(spark, run) -> set[str]:
    """Names of the scratch tables that are there after ``run`` and were not before."""
    folder = Path(scratch_path(spark, "x").removeprefix("file:")).parent
    before = set(folder.iterdir())
    run()
    return {path.name.rsplit("-", 1)[0] for path in set(folder.iterdir()) - before}


def test_passages_leave_no_large_tables(spark, passage_docs):
    assert not {"runs", "texts", "windows"} & tables_made(spark, lambda: repeated_passages(passage_docs))


def test_shingle_join_leaves_no_large_tables(spark, texts):
    assert not {"sets", "shared"} & tables_made(spark, lambda: linked_documents(texts))


def test_stored_tables_leave_no_shuffle_files(spark):
    blocks = lambda: set(shuffle_blocks(spark))
    before = blocks()
    table = stored(spark.range(1000).repartition(3, "id"), "numbers")
    for _ in range(50):
        if not blocks() - before:
            break
        time.sleep(0.1)
    assert not blocks() - before and table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    drop_stored(table)
    kept = spark.range(3)
    drop_stored(kept)
    assert kept.count() == 3


def shuffle_blocks(spark) -> list[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return [name for name in names if name.startswith("shuffle_")]


def test_tables_outside_the_scratch_folder_stay(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/own")
    own = spark.read.parquet(f"{tmp_path}/own")
    drop_stored(own)
    assert spark.read.parquet(f"{tmp_path}/own").count() == 5


def lists_of_windows(random) -> pa.Table:
    """Small lists: edited copies of a passage in several rows, some of them of few words that repeat."""
    made = []
    for key in range(60):
        base = random.integers(0, 2 if key % 5 == 0 else 30 if key % 5 == 1 else 10**9, 100)
        for row in sorted(random.integers(0, 9, int(random.integers(1, 12))).tolist()):
            starts = int(random.integers(1, 55))
            own = base[: starts + passages.LEAST - 1].astype("<u4")
            edits = np.flatnonzero(random.random(len(own)) < random.choice([0, 0.05, 0.2]))
            own[edits] = random.integers(0, 10**9, len(edits))
            made.append((key, 0, 0, 0, row, int(random.integers(0, 500)), int(random.integers(0, 2**starts)), own.tobytes()))
    names = ["key", "low", "high", "block", "row", "start", "open", "content"]
    return pa.table(dict(zip(names, map(list, zip(*made)))))


def test_small_lists_together_are_as_one_by_one():
    several = 0
    for seed in range(5):
        table = lists_of_windows(np.random.default_rng(seed))
        key = table.column("key").to_numpy()
        first = np.append(0, np.flatnonzero(np.diff(key)) + 1)
        sizes = np.diff(np.append(first, len(key)))
        alone = [x for at, n in zip(first.tolist(), sizes.tolist()) for x in passages._block_matches(table.slice(at, n))]
        assert passages._few_matches(table, first) == alone
        cut = list(passages._whole_lists(iter(table.to_batches(max_chunksize=7)), ["key", "low", "high"]))
        assert pa.concat_tables([part for part, _ in cut]).equals(table)
        several += len(alone)
    assert several > 500


def test_windows_that_share_a_line_alone_are_not_compared():
    random = np.random.default_rng(3)
    line = random.integers(0, 10**9, 30)
    fresh = lambda n: random.integers(0, 10**9, n)
    own = [np.concatenate([fresh(20), line, fresh(20)]) for _ in range(40)]
    own += [np.append(own[0][:-3], fresh(3)), np.tile(fresh(10), 7)]
    rows = [(0, 0, 0, 0, row, 0, 2**25 - 1, x.astype("<u4").tobytes()) for row, x in enumerate(own)]
    table = pa.table(dict(zip(["key", "low", "high", "block", "row", "start", "open", "content"], map(list, zip(*rows)))))
    left, first = passages._thinned(table, np.array([0]))
    assert left.column("row").to_pylist() == [0, 40] and first.tolist() == [0]
    assert passages._block_matches(left) == passages._block_matches(table) != []
    table = table.set_column(6, "open", pa.array(np.zeros(len(rows), np.int64)))
    assert passages._thinned(table, np.array([0]))[0].num_rows == 0


def test_lists_in_chunks_are_as_in_one(monkeypatch):
    several = 0
    for seed in range(4):
        table = lists_of_windows(np.random.default_rng(seed))
        table = table.sort_by("row").set_column(0, "key", pa.array(np.zeros(table.num_rows, np.int64)))
        whole = passages._block_matches(table)
        monkeypatch.setattr(passages, "CHUNK", 50)
        assert sorted(passages._block_matches(table)) == sorted(whole)
        monkeypatch.undo()
        thinned, first = passages._thinned(table, np.array([0]))
        assert thinned.num_rows < table.num_rows and passages._block_matches(thinned) == whole
        several += len(whole)
    assert several > 100


def test_what_is_known_is_not_open():
    text = " ".join(f"w{i}" for i in range(160))
    spans = [{"start": 20, "n": 60, "equal": False}, {"start": 120, "n": 5, "equal": False}]
    starts = lambda equal: {
        (int(first + i), bool(mask >> i & 1))
        for _, _, at, n, masks, _, _ in passages._left(
            pa.RecordBatch.from_pylist([{"row": 1, "text": text, "spans": [{**span, "equal": equal} for span in spans[:1]] + spans[1:]}]), range(1))
        for first, size, mask in zip(at, n, masks.tolist()) for i in range(size)}
    assert starts(False) == {(s, not 11 <= s <= 43) for s in range(111)}
    assert starts(True) == {(s, not 11 <= s <= 43) for s in range(111) if not 20 <= s <= 34}


def test_similarities_of_runs():
    random = np.random.default_rng(2)
    for kinds in (10**9, 60, 3):
        x = random.integers(0, kinds, 60)
        y = np.where(random.random(58) < 0.1, random.integers(0, kinds, 58), x[2:])
        found = passages.run_similarities(x, y, x[:, None] == y)
        for a in range(len(x) - passages.LEAST + 1):
            for b in range(len(y) - passages.LEAST + 1):
                one, two = set(x[a : a + passages.LEAST].tolist()), set(y[b : b + passages.LEAST].tolist())
                assert abs(found[a, b] - len(one & two) / len(one | two)) < 1e-9
