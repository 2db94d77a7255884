"""Token files, byte-level BPE, packing and token counts against the public libraries and exact round trips."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer
from tokenizers.models import BPE

from vertexloom.llm import ans, duck_bpe, token_counts
from vertexloom.llm.duck_bpe import Coder, encode_digests
from vertexloom.llm.packing import Bins, best_fit, pack_documents, plan
from vertexloom.llm.pieces import PieceEncoder
from vertexloom.llm.token_files import read_token_files, token_file_round_trip, write_token_files

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def odd_texts() -> list[str]:
    pick = random.Random(3)
    made = ["".join(pick.choice(" \n\ta.b,'s1 é\x1c漢<|endoftext|>İK") for _ in range(40)) for _ in range(300)]
    return [
        "", " ", "\n", "a", "The  cat\n\n sat. ", "x" * 500, "ab" * 300, "'s 'S it's", "a\0b c", "é é ́x", " a　b",
        "<|endoftext|>", "a <|endoftext|> b <|ENDOFTEXT|>", "MiXeD Case, WORDS. 12 345", *made,
    ]


@pytest.fixture(scope="module")
def documents(spark):
    """Odd texts, nulls, repeated rows and ids, and extra columns whose names clash."""
    texts = [*odd_texts(), None, "same row", "same row", "same id", "other text of it", "long " * 9000, "y" * 30_000]
    ids = [*range(len(texts) - 7), None, 9001, 9001, 9002, 9002, 9003, 9004]
    rows = [(doc_id, text, "x", 1, "y") for doc_id, text in zip(ids, texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, TEXT string, start int, Doc_ID string")


def sorted_rows(df, *names):
    return sorted((tuple(row[name] for name in names) for row in df.collect()), key=lambda row: tuple((x is None, x) for x in row))


def texts_of(documents):
    return [(row[0], row[1] or "") for row in documents.collect()]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_pieces_give_what_the_library_gives(path):
    own, library = PieceEncoder(path), Tokenizer.from_file(path)
    assert own.cut != own._whole
    for text, ids in zip(odd_texts(), own.encode(odd_texts())):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_words_are_learned_once_whatever_marks_follow(path, monkeypatch):
    own, library = PieceEncoder(path), Tokenizer.from_file(path)
    own.known, learned, learn = {"": b""}, Counter(), own._learn
    monkeypatch.setattr(own, "_learn", lambda pieces: (learned.update(pieces), learn(pieces))[1])
    words = ["thonat", "Übung", "niño", "x", "İK", "ab1", "no'"]
    texts = [" ".join(word + marks for word in words) + "\n" for marks in ("", ",", ".", "!!", "&&&", ",***", ".###", ";:")]
    for _ in range(2):
        for text, ids in zip(texts, own.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert set(learned.values()) == {1}
    assert not any("nat" in piece.lower() and not piece.strip().isalpha() for piece in learned)


def test_token_files_ask_the_library_for_each_word_once(monkeypatch):
    own, library, asked = PieceEncoder(WORDS, "<u2"), Tokenizer.from_file(WORDS), Counter()
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda pieces: (asked.update(pieces), learn(pieces))[1])
    text = "Thonat, thonat. THONAT!! thonat&&& thonat"
    assert np.frombuffer(own.encode([text])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert asked["thonat"] == 1 and not any(piece.startswith("thonat") and piece != "thonat" for piece in asked)


def test_pieces_after_forgetting(monkeypatch):
    monkeypatch.setattr("vertexloom.llm.pieces.MOST_PIECES", 40)
    own = PieceEncoder(BYTES)
    for _ in range(3):
        for text in odd_texts()[:60]:
            expected = own.library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == expected


@pytest.mark.parametrize("count, size", [(0, 3), (1, 3), (513, 300), (9000, 40_000), (5000, 1)])
def test_ans_round_trip(count, size):
    ids = np.minimum(np.random.default_rng(count).zipf(1.3, count) - 1, size - 1).astype(np.uint32)
    table = ans.table_of(ans.scaled(np.bincount(ids, minlength=size)))
    block = ans.encode(ids, table, lanes=32, every=8)
    assert ans.decode(block, table).tolist() == ids.tolist()
    if count > 32 * 8 * 3:
        assert ans.decode(block, table, 2, 1).tolist() == ids[2 * 256 : 3 * 256].tolist()
    if count:
        assert int(table.freq.sum()) == 1 << ans.SCALE
        with pytest.raises(ValueError):
            ans.decode(block[:-1] + bytes([block[-1] ^ 1]), table)


def test_ans_is_near_the_entropy():
    ids = np.random.default_rng(0).geometric(0.01, 400_000).astype(np.uint32)
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    assert len(ans.encode(ids, ans.table_of(ans.scaled(counts)))) < 1.06 * -(p * np.log2(p)).sum() * len(ids) / 8 + 50_000


def test_token_files(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr("vertexloom.llm.token_files.BLOCK", 1 << 12)  # read by this process only; workers use their own
    write_token_files(documents, str(tmp_path / "files"), WORDS, 2)
    got = read_token_files(spark, str(tmp_path / "files"), keep_ids=True)
    library, start, expected = Tokenizer.from_file(WORDS), 0, []
    rows = sorted(got.collect(), key=lambda row: row.start)
    assert [row.doc_id is None for row in rows] == [True] + [False] * (len(rows) - 1)
    assert [row.doc_id for row in rows[1:]] == sorted(row.doc_id for row in rows[1:])
    for row in rows:
        assert row.start == start
        start += row.n_tokens
        expected.append((row.n_tokens, row.ids_crc32))
        assert zlib.crc32(row.ids) == row.ids_crc32
    direct = Counter()
    for _, text in texts_of(documents):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()
        direct[len(ids) // 4, zlib.crc32(ids)] += 1
    assert Counter(expected) == direct


def test_token_files_of_an_empty_table(spark, documents):
    assert token_file_round_trip(documents.limit(0), WORDS, 2).count() == 0


def test_documents_longer_than_a_block(spark, tmp_path):
    docs = spark.createDataFrame([(2, "a b " * 700_000), (1, "c"), (3, None)], "doc_id long, text string")
    got = {row.doc_id: row for row in token_file_round_trip(docs, WORDS, 2).collect()}
    ids = np.array([*Tokenizer.from_file(WORDS).encode("a b " * 10, add_special_tokens=False).ids[:2] * 700_000, 2], "<u4").tobytes()
    assert (got[2].start, got[2].n_tokens, got[2].ids_crc32) == (2, 1_400_001, zlib.crc32(ids))
    assert (got[3].start, got[3].n_tokens) == (1_400_003, 1)


def library_of_ranks():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_recursive_queries_encode_as_the_library():
    own, library = Coder(RANKS, public_tokenizers.PATTERN), library_of_ranks()
    pick = random.Random(1)
    texts = [*odd_texts(), "a" * 300, "ab" * 200 + "aba" * 70, "".join(pick.choice("abcdeäßé") for _ in range(2000)), "漢字" * 300]
    ids = own.encode(texts)
    for text, found in zip(texts, ids):
        assert np.frombuffer(found, "<u4").tolist() == library.encode_ordinary(text), text
    assert own.decode(ids) == [text.encode() for text in texts]


def test_digests(spark, documents):
    library = library_of_ranks()
    expected = []
    for doc_id, text in texts_of(documents):
        ids = library.encode_ordinary(text)
        expected.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = encode_digests(documents, RANKS, public_tokenizers.PATTERN)
    assert Counter(map(tuple, got.collect())) == Counter(expected)
    assert encode_digests(documents.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_counts(spark, documents):
    library = Tokenizer.from_file(BYTES)
    expected = Counter()
    for doc_id, text in texts_of(documents):
        n = len(library.encode(text, add_special_tokens=False).ids)
        expected[doc_id, len(text.encode()), n, n > 1024] += 1
    for huge in (50, 2 * token_counts.CHUNK):
        assert Counter(map(tuple, token_counts.token_counts(documents, BYTES, huge=huge).collect())) == expected
    assert token_counts.token_counts(documents.limit(0), BYTES).count() == 0


def test_chunks_cover_the_text():
    pick = random.Random(5)
    for text in [*odd_texts(), " ".join("w" * pick.randint(1, 90) for _ in range(400)), "  ".join(["double"] * 200)]:
        parts = list(token_counts.chunks(text, size=60, overlap=8))
        assert [part[0] for part in parts] == list(range(len(parts))) and [part[1] for part in parts][-1]
        assert "".join(text[left:right] for *_, left, right in parts) == text
        for _, _, chunk, start, left, right in parts:
            assert chunk == text[max(left - 8, 0) : right + 8] and start == max(left - 8, 0)


def test_spliced_counts(spark, tmp_path, monkeypatch):
    pick = random.Random(8)
    texts = [" ".join("w" * pick.randint(1, 9) for _ in range(20_000)), "a b " * 40_000, "double  " * 30_000,
             "y" * 100_000, " ".join(str(i) for i in range(30_000)), None]
    frame = spark.createDataFrame([*enumerate(texts), (1, texts[1]), (None, texts[0])], "doc_id long, text string").repartition(3)
    # A tokenizer whose tokens cross spaces: no lone space is a boundary, so overlaps widen until the text is one chunk.
    crossing = Tokenizer(BPE({"a": 0, "b": 1, " ": 2, "a ": 3, "b ": 4, "a b ": 5}, [("a", " "), ("b", " "), ("a ", "b ")]))
    crossing.save(str(tmp_path / "crossing.json"))
    rounds = []
    plain = token_counts._spliced
    monkeypatch.setattr(token_counts, "_spliced", lambda *args: rounds.append(args[-1]) or plain(*args))
    for path, least, most in ((BYTES, 1, 1), (str(tmp_path / "crossing.json"), 2, 9)):
        library = Tokenizer.from_file(path)
        rounds.clear()
        found = Counter((row.doc_id, row.n_tokens) for row in token_counts.token_counts(frame, path).collect())
        expected = [(doc_id, len(library.encode(text or "", add_special_tokens=False).ids))
                    for doc_id, text in [*enumerate(texts), (1, texts[1]), (None, texts[0])]]
        assert found == Counter(expected)
        assert least <= len(rounds) <= most


def check_packing(rows, texts, size):
    library = Tokenizer.from_file(BYTES)
    places: dict[int, list] = {}
    pieces = Counter()
    for row in rows:
        places.setdefault(row.sequence_id, []).append((row.offset, row.length))
        pieces[row.doc_id, row.piece, row.start, row.length, row.ids_crc32] += 1
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= size
    expected = Counter()
    for doc_id, text in texts:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % size or size
        bounds = [0, *range(first, len(ids), size), len(ids)]
        for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
            expected[doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert pieces == expected
    rooms: list[int] = []
    for row in sorted(rows, key=lambda row: -row.length):  # first-fit decreasing
        at = next((i for i, room in enumerate(rooms) if room >= row.length), None)
        if at is None:
            rooms.append(size - row.length)
        else:
            rooms[at] -= row.length
    return len(places), len(rooms)


def test_packing(spark, documents):
    for size in (64, 2048):
        sequences, first_fit = check_packing(pack_documents(documents, BYTES, 0, size).collect(), texts_of(documents), size)
        assert sequences <= 1.01 * first_fit
    assert pack_documents(documents.limit(0), BYTES).count() == 0


@pytest.mark.parametrize("low, high, bound", [(1, 2048, 1.01), (1, 100, 1.01), (300, 1500, 1.01), (700, 2048, 1.14)])
def test_plans_use_few_sequences(low, high, bound):
    lengths = np.random.default_rng(low).integers(low, high + 1, 20_000)
    bins = plan(Counter(lengths.tolist()), 2048)
    used = Counter()
    for run in bins:
        assert 0 < sum(run.lengths) <= 2048
        for length in run.lengths:
            used[length] += run.count
    assert used == Counter(lengths.tolist())
    assert sum(run.count for run in bins) < bound * lengths.sum() / 2048 + 2


def test_best_fit_takes_the_least_room():
    bins = [Bins(2, [90]), Bins(1, [95]), Bins(1, [50])]
    assert best_fit(bins, {5: 2, 40: 1, 60: 1}, 100) == {60: 1}
    assert sorted((run.count, sorted(run.lengths)) for run in bins) == [(1, [5, 90]), (1, [5, 95]), (1, [40, 50]), (1, [90])]


def test_long_words_are_joined_from_parts():
    coder = Coder(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = np.random.default_rng(3)
    words = ["a" * 400_000, "ab" * 5_000, "=" * 777]
    for letters in ("a", "ab", "aab", "theandofing", "=-", "é漢a"):
        words += ["".join(rng.choice(list(letters), size)) for size in (63, 64, 65, 129, 700, 3_000)]
    for word in words:
        ids = coder.encode([word])
        assert np.frombuffer(ids[0], dtype="<u4").tolist() == library._core_bpe.encode_single_piece(word.encode())
        assert coder.decode(ids) == [word.encode()]


def test_words_are_forgotten_and_ids_decoded_in_parts(monkeypatch):
    coder = Coder(RANKS, public_tokenizers.PATTERN)
    texts = [f"zqxword{i % 70}wv vbnq{i}x again" for i in range(300)]
    expected = coder.encode(texts)
    monkeypatch.setattr(duck_bpe, "MOST_WORDS", 40)
    monkeypatch.setattr(duck_bpe, "QUERY_BYTES", 50)
    monkeypatch.setattr(duck_bpe, "QUERY_IDS", 37)
    coder.known, coder.earlier = {"": b""}, {}
    assert [coder.encode([text])[0] for text in texts] == expected
    assert len(coder.known) + len(coder.earlier) < 80
    assert coder.decode([*expected, b""]) == [*[text.encode() for text in texts], b""]


def test_ranks_are_looked_up_once_per_distinct_piece(monkeypatch):
    coder, asked = Coder(RANKS, public_tokenizers.PATTERN), []
    ids_of = Coder._ids_of
    monkeypatch.setattr(Coder, "_ids_of", lambda self, pieces: asked.extend(pieces) or ids_of(self, pieces))
    texts = ["one two one two", "two one", "", "a\0b  c"]
    ids = coder.encode(texts)
    assert len(asked) == len(set(asked)) and coder.decode(ids) == [text.encode() for text in texts]
