"""Personal data, periodic runs and spelling variants against plain definitions."""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vertexloom.llm import periodic_runs as periodic
from vertexloom.llm import personal_data as personal
from vertexloom.llm import spelling
from vertexloom.llm.queries import op11_personal_data, op12_periodic_runs, op13_spelling

DATA = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, TEXT long, Doc_Id string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, folder, rows):
    spark.createDataFrame([(i, text, 1, "x") for i, text in rows], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(autouse=True)
def exact_names(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    yield
    spark.conf.unset("spark.sql.caseSensitive")


# --- personal data ---------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checked(kind: str, found: str) -> bool:
    digits = [int(sign) for sign in found if sign in string.digits]
    if kind == "ip":
        return all(int(part) <= 255 for part in found.split("."))
    if kind == "card":
        doubled = [sum(divmod(d * 2, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    kinds = list(PATTERNS)
    found = [(m.start(), i, m.end()) for i, kind in enumerate(kinds) for m in re.finditer(PATTERNS[kind], text) if checked(kind, m.group())]
    return [(kinds[i], start, end) for start, i, end in sorted(found)]


def test_base_spans_equal_the_patterns():
    finder, choice = personal.Finder(), random.Random(3)
    signs = ["@.a-1 +", "0123456789.", "0123456789 -", "+1234567890 ().-", "a@b.c@d", "@.aé1%_+- x4)("]
    known = ["4111 1111 1111 1111", "192.168.0.1", "a.b@c.de", "+1 (743) 555-3824", "000.001.0255.255", "1.2.3.4.5.6.7.8", ""]
    several = 0
    for _ in range(15_000):
        some = choice.choice(signs)
        text = "".join(choice.choice(some) for _ in range(choice.randint(0, 50))) + choice.choice(known)
        text += "".join(choice.choice(some) for _ in range(choice.randint(0, 6)))
        found = [span for span in finder.spans(text) if span[0] in personal.BASE_KINDS]
        assert found == base_spans(text), text
        several += len(found) > 1
    assert several > 500


def test_anchors_add_spans_and_keep_the_others():
    text = ("joe.x (at) corp [dot] example.com, IBAN: DE89 3704 0044 0532 0130 00, IBAN DE88 3704 0044 0532 0130 00; konto nr. 12345678, "
            "https://u:p@ex.org:80/a?http://b.c). SSN 123-45-6789, ssn 666-45-6789, account 12, discount 12345678 é https://")
    spans = personal.Finder().spans(text)
    assert [(kind, text[start:end]) for kind, start, end in spans] == [
        ("spelled_email", "joe.x (at) corp [dot] example.com"), ("iban", "DE89 3704 0044 0532 0130 00"), ("account", "12345678"),
        ("url", "https://u:p@ex.org:80/a?http://b.c"), ("email", "p@ex.org"), ("ssn", "123-45-6789"),
    ]
    assert personal.masked(text, spans).startswith("[spelled_email], IBAN: [iban], IBAN DE88")
    assert personal.masked("ab", []) == "ab" and personal.masked("a@b.c", [("email", 0, 5)]) == "[email]"


@pytest.mark.parametrize("unit", ["1", "1.", "1 ", "a@", "+1", "(", "http://a/", "iban ", "x(at)"])
def test_long_texts_take_linear_time(unit):
    text = unit * (400_000 // len(unit))
    spans = personal.Finder().spans(text)
    assert all(0 <= start < end <= len(text) for _, start, end in spans)


def test_personal_data_of_documents(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "a@b.c 10.0.0.1 é\U0001f600 c@d.e"), (3, "a@b.c 10.0.0.1 é\U0001f600 c@d.e"), (None, "+1 (743) 555-3824"),
            (4, "x " * 200_000 + "4111 1111 1111 1111")]
    found = op11_personal_data(spark, documents(spark, tmp_path, rows)).collect()
    key = lambda row: (row[0] is None, row[0] or 0)
    assert len(found) == len(rows)
    for row, (doc_id, text) in zip(sorted(found, key=key), sorted(rows, key=key)):
        spans = base_spans(text or "")
        counts = Counter(kind for kind, _, _ in spans)
        listed = ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)
        assert (row.doc_id, row.n_email, row.n_ip, row.n_card, row.n_phone) == (doc_id, *[counts[kind] for kind in PATTERNS])
        assert (row.base_sha256, row.spans) == (digest(listed), listed)
    whole = personal.personal_data(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert whole.columns == ["doc_id", "text", "TEXT", "Doc_Id", "spans", "masked"]
    assert {(row[0], row[5]) for row in whole.filter("doc_id = 1 or doc_id = 3").collect()} == {(1, None), (3, "[email] [ip] é\U0001f600 [email]")}
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    assert personal.span_digests(personal.personal_data(empty)).count() == 0


# --- periodic runs ---------------------------------------------------------------------------------------------------


def plain_runs(words) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run, by start and period."""
    found: dict[tuple[int, int], int] = {}
    for period in range(1, len(words) // 2 + 1):
        i = 0
        while i + period < len(words):
            start = i
            while i + period < len(words) and words[i] == words[i + period]:
                i += 1
            if i + period - start >= max(12, 2 * period):
                found.setdefault((start, i + period), period)
            i += 1
    return sorted(((start, end, period) for (start, end), period in found.items()), key=lambda run: (run[0], run[2]))


def test_runs_equal_the_definition():
    choice = random.Random(5)
    several = 0
    for _ in range(250):
        texts = []
        for _ in range(choice.randint(1, 5)):
            n, kinds = choice.choice([0, 1, 5, 12, 13, 40, 150, 300]), choice.choice([1, 2, 2, 3, 4, 30])
            text = [choice.randint(1, kinds) for _ in range(n)]
            if n > 5 and choice.random() < 0.6:
                first = choice.randrange(n)
                period = choice.randint(1, max(1, (n - first) // choice.randint(1, 6)))
                text = [text[i] if i < first else text[first + (i - first) % period] for i in range(n)]
                if choice.random() < 0.5:
                    text[choice.randrange(n)] = 99
            texts.append(text + text[: choice.randint(0, n)] + text if choice.random() < 0.3 else text)
        texts += texts[:1]
        symbols = np.array([word for text in texts for word in text], np.int64)
        expected, before = [], 0
        for text in texts:
            expected += [(start + before, end + before, period) for start, end, period in plain_runs(text)]
            before += len(text)
        found = [tuple(run) for run in periodic.runs_of(symbols, np.array([len(text) for text in texts])).tolist()]
        assert found == expected
        several += len(found) > 3
    assert several > 30


@pytest.mark.parametrize("kind", ["one", "thue_morse", "fibonacci", "nested"])
def test_runs_of_hard_texts(kind, monkeypatch):
    monkeypatch.setattr(periodic, "OPEN", 97)
    word = [0, 1]
    if kind == "one":
        word = [0] * 500
    elif kind == "thue_morse":
        while len(word) < 500:
            word = word + [1 - x for x in word]
    elif kind == "fibonacci":
        shorter = [0]
        while len(word) < 500:
            shorter, word = word, word + shorter
    else:
        word = ([1, 2, 3] * 5 + [4]) * 6 + [5] + ([1, 2] * 9 + [3]) * 3
    found = periodic.runs_of(np.array(word), np.array([len(word)]))
    assert [tuple(run) for run in found.tolist()] == plain_runs(word)


def test_grammar_derives_the_text():
    symbols = np.random.default_rng(1).integers(0, 4, 2000)
    lengths = np.array([700, 0, 1, 1299])
    grammar = periodic.Grammar(symbols, lengths)
    for node in range(grammar.known):
        begin, end = grammar.begin[node], grammar.end[node]
        places = grammar.places[grammar.of == node]
        assert begin < grammar.middle[node] < end and begin in places
        assert all((symbols[place : place + end - begin] == symbols[begin:end]).all() for place in places)
    assert (grammar.symbols >= 0).all() and len(grammar.symbols) == 3  # one root per text with words


def expected_run_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        first = g % n
        period = 1 + (n - first) // (3 + g % 8)
        words = [words[i] if i < first else words[first + (i - first) % period] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda run: (run[0] - run[1], run[0], run[2]), default=None)
    longest = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    gone = {i for start, end, period in runs for i in range(start + period, end)}
    listed = "".join(f"{start},{end - start},{period}\n" for start, end, period in runs)
    return doc_id, len(runs), *longest, digest(listed), digest(" ".join(word for i, word in enumerate(words) if i not in gone))


def test_periodic_runs_of_documents(spark, tmp_path):
    loops = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    plain = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10][:4]
    words = [f"w{i} é" for i in range(70)]
    rows = [(loops[0], None), (loops[1], ""), (loops[2], " \t\n"), (loops[3], "one"), (loops[4], " ".join(words)), (loops[4], " ".join(words)),
            (loops[5], "\x0b\x0c".join(words) + "\r"), (plain[0], None), (plain[1], ""), (plain[2], "x " * 30), (None, " y" * 13)]
    found = op12_periodic_runs(spark, documents(spark, tmp_path, [*rows, (plain[3], "a b c " * 30_000)])).collect()
    assert Counter(tuple(row) for row in found if row.doc_id != plain[3]) == Counter(expected_run_row(*row) for row in rows)
    assert [tuple(row)[:6] for row in found if row.doc_id == plain[3]] == [(plain[3], 1, 0, 90_000, 3, 30_000_000)]
    assert "collapsed" in periodic.periodic_runs(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)).columns


def test_periodic_runs_of_the_table(spark):
    found = {row.doc_id: tuple(row) for row in op12_periodic_runs(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    short = [row for row in rows if len(row.text or "") < 6000]
    assert len(found) == len(rows) and len(short) > 100
    for row in short:
        assert found[row.doc_id] == expected_run_row(row.doc_id, row.text)


# --- spelling variants -----------------------------------------------------------------------------------------------


def plain_counts(rows) -> dict[str, int]:
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    counts: Counter[str] = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 5 and n >= 3}


def plain_variants(counts: dict[str, int]) -> set[tuple]:
    letters = sorted(set("".join(counts)))
    near = {}
    for word in counts:
        cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
        made = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters}
        near[word] = (made & counts.keys()) - {word}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda other: (-counts[other], other), default=None)
        form[word] = best if best is not None and counts[best] >= 2 * counts[word] else None
    result = set()
    for word, n in counts.items():
        root = word
        while form[root] is not None:
            root = form[root]
        result.add((word, form[word], root, n, len(near[word]), counts.get(form[word])))
    return result


def test_spelling_of_the_table(spark):
    rows = [tuple(row) for row in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    found = [tuple(row) for row in op13_spelling(spark, DATA).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_variants(plain_counts(rows))
    assert any(row[1] for row in found)


@pytest.mark.parametrize("most_rows", [1, 3, 40, 100_000])
def test_near_words_in_small_and_large_blocks(spark, most_rows):
    choice = random.Random(most_rows)
    words = {"".join(choice.choice("abé") for _ in range(choice.randint(1, 9))) for _ in range(700)} | {"a" * i for i in range(1, 40)}
    counts = {word: choice.randint(1, 2000) for word in words | {"x\U0001f600" + "y" * 50, "x" + "y" * 50}}
    table = spark.createDataFrame([*counts.items(), (None, 7)], "word string, n long")
    found = [tuple(row) for row in spelling.spelling_variants(table, most_rows=most_rows).collect()]
    assert len(found) == len(counts) and set(found) == plain_variants(counts)


@pytest.mark.parametrize("task_rows, open_pairs", [(1, 1), (10, 100), (10**6, 10**6)])
def test_tasks_cut_at_blocks(monkeypatch, task_rows, open_pairs):
    """Blocks that come in many batches and are handled in several groups give all their pairs, once."""
    monkeypatch.setattr(spelling, "TASK_ROWS", task_rows)
    monkeypatch.setattr(spelling, "OPEN_PAIRS", open_pairs)
    words = sorted({"".join(random.Random(i).choices("ab", k=6)) for i in range(60)})
    key = {"tag": 6, "path": "F", "tail": "", "below": spelling.NEVER, "n": 1}
    rows = [{**key, "head": word[:2], "mid": word[2:]} for word in words]
    kinds = [("tag", pa.int32()), *[(name, pa.string()) for name in ("path", "head", "tail", "mid")], ("below", pa.int32()), ("n", pa.int64())]
    batches = pa.Table.from_pylist(rows, pa.schema(kinds)).to_batches(max_chunksize=7)
    expected = {(a, b) for a in words for b in words if a[:2] == b[:2] and sum(x != y for x, y in zip(a, b)) == 1}
    pairs = [(row["word"], row["near"]) for batch in spelling._near_in_tasks(iter(batches)) for row in batch.to_pylist()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected


def test_spelling_of_odd_documents(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "1 2 3"), (None, "Hello hello HELLO hellos hellos hellos"), (4, "Àbcde àbcde Àbcde Àbcde àbcde àbcde"),
            (5, "hello " * 4), (5, "hello " * 4), (6, "a" * 3000 + " " + "a" * 3000 + " " + "a" * 3000), (7, ("a" * 3001 + " ") * 7)]
    found = op13_spelling(spark, documents(spark, tmp_path, rows)).collect()
    assert {tuple(row) for row in found} == plain_variants(plain_counts(rows))
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    assert spelling.spelling_variants(spelling.word_counts(empty, 97)).collect() == []
