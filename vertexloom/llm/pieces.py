"""Ids of whole texts by the ``tokenizers`` library, remembering the ids of pieces that return.

The pre-tokenizers of the public files never join what stands before a single space or line break with what follows
it. So a text may be cut there, and each distinct piece needs the library only once per Python worker. Nor do they join
a word with the marks behind it, so a word needs it once whatever marks follow.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vertexloom.llm.common import worker_memory

MOST_PIECES = 1_100_000  # remembered per worker, about 200 bytes each; beyond that those not met for long are forgotten
DOUBLED = re.compile(r"\s\s|\0")
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
MARKS = ".,;:!?&%#$*"
SPACE = "\u0120"  # how a byte-level vocabulary writes a space

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

def encoder(path: str, id_type: str = "<u4") -> PieceEncoder:
    """The encoder of this worker for one tokenizer file."""
    return worker_memory("pieces", (path, id_type), lambda: PieceEncoder(path, id_type))


def joined_pieces(cuts: list[str], ids_of: Callable[[list[str]], list[bytes]], id_type: np.dtype) -> list[bytes]:
    """The ids of texts whose pieces a null character parts, from those of the distinct pieces. Arrow tells the distinct
    pieces of all texts; only these are Python strings."""
    split = pc.split_pattern(pa.array(["\0".join(cuts)], pa.large_string()), "\0").values.dictionary_encode()
    ids = ids_of(split.dictionary.to_pylist())
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // id_type.itemsize
    own = split.indices.to_numpy()
    number = sizes[own]
    end = np.cumsum(number)
    at = np.repeat((np.cumsum(sizes) - sizes)[own] - (end - number), number)
    at += np.arange(len(at))
    raw = memoryview(np.frombuffer(b"".join(ids), id_type)[at]).cast("B")
    last = np.cumsum([cut.count("\0") + 1 for cut in cuts]) - 1
    ends = (end[last] * id_type.itemsize).tolist()
    return [bytes(raw[start:stop]) for start, stop in zip([0, *ends], ends)]


class PieceEncoder:
    """``encode(texts)`` gives, per text, the little-endian ids that the library gives for the whole text."""

    def __init__(self, path: str, id_type: str = "<u4"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.id_type = np.dtype(id_type)
        self.known: dict[str, bytes] = {"": b""}
        self.earlier: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        special = [token["content"] for token in described["added_tokens"]]
        plain = not any(re.search(r"\s", token) for token in special) and not any(
            token["lstrip"] or token["rstrip"] or token["single_word"] for token in described["added_tokens"])
        self.cut = (self._keeping_spaces if described["normalizer"] is None else self._dropping_spaces) if plain else None
        self.closing = None  # of a tokenizer that marks word ends: which ids close a word
        if self.cut == self._dropping_spaces and (mark := described["model"].get("end_of_word_suffix")):
            self.closing = np.zeros(self.library.get_vocab_size(), dtype=bool)
            self.closing[[i for token, i in described["model"]["vocab"].items() if token.endswith(mark)]] = True
        self.opening = None  # of a tokenizer whose words take a space in front: which ids begin with one
        if self.cut == self._keeping_spaces:
            self.opening = np.zeros(self.library.get_vocab_size(), dtype=bool)
            self.opening[[i for token, i in described["model"]["vocab"].items() if token.startswith(SPACE)]] = True
        if not plain or not self._rules_hold():
            self.cut, self.closing, self.opening = self._whole, None, None

    def _rules_hold(self) -> bool:
        """The cuts are known to be right for the two pre-tokenizers of the public files; compare on a probe."""
        probe = "Yes, no.\nWell:*** \u00dcnd&&& n\u00e9e;,\n$$ x!? It's a b.c, d\n e  f\t12 345\n\ng ... h?! <|endoftext|> i j k 'll x' s\n"
        return b"".join(self.encode([probe])) == self._library_ids(probe)

    def _library_ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.id_type).tobytes()

    @staticmethod
    def _whole(text: str) -> None:
        return None

    @staticmethod
    def _dropping_spaces(text: str) -> str | None:
        """For a tokenizer of lower case that drops white space: any space or line break parts two pieces."""
        if "<|" not in text:  # a special token's string only counts as it is
            text = text.encode().translate(LOWER).decode()
        return text.replace("\n", "\0").replace(" ", "\0") if "\0" not in text else None

    @staticmethod
    def _keeping_spaces(text: str) -> str | None:
        """For one whose words take a space in front: a lone space opens a piece, a lone line break is a piece.
        White space that stands in runs is cut only where a lone space parts two words."""
        if not DOUBLED.search(text):
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0")
        return SINGLE_SPACE.sub("\0 ", text) if "\0" not in text else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """``tests`` compare this with the library on whole texts.

        ``cut`` puts a null character between two pieces, or gives nothing for a text that is not cut.
        """
        cuts = [self.cut(text) for text in texts]
        some = [cut for cut in cuts if cut is not None]
        if not some:
            return [self._library_ids(text) for text in texts]
        joined = iter(joined_pieces(some, self._ids_of, self.id_type))
        return [self._library_ids(text) if cut is None else next(joined) for text, cut in zip(texts, cuts)]

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        known = self.known
        if len(known) + len(pieces) > MOST_PIECES // 2:
            self.earlier, known = known, {"": b""}
            self.known = known
        missing = []
        for piece in [piece for piece in pieces if piece not in known]:
            if (ids := self.earlier.get(piece)) is not None:
                known[piece] = ids
            else:
                missing.append(piece)
        for at in range(0, len(missing), 20_000):
            self._learn_parts(missing[at : at + 20_000])
        return [known[piece] for piece in pieces]

    def _learn_parts(self, pieces: list[str]) -> None:
        """Both pre-tokenizers part a word from marks behind it: such pieces are put together from the two. Letters beyond
        U+00FF are left out: some become a letter and a mark in lower case."""
        known, whole, parts, needed = self.known, [], [], set()
        for piece in pieces:
            word = piece.rstrip(MARKS)
            if len(word) < len(piece) and (bare := word.removeprefix(" ")).isalpha() and (bare.isascii() or max(bare) <= "\u00ff"):
                parts.append((piece, word, piece[len(word) :]))
                needed.add(word)
                needed.add(parts[-1][2])
            else:
                whole.append(piece)
        for part in needed.difference(known, whole):
            if (ids := self.earlier.get(part)) is not None:
                known[part] = ids
            else:
                whole.append(part)
        self._learn(whole)
        for piece, word, marks in parts:
            known[piece] = known[word] + known[marks]

    def _learn(self, pieces: list[str]) -> None:
        """One call for many pieces; the library says of each id which piece it is from."""
        if self.closing is not None:
            pieces = self._learn_words(pieces)
        elif self.opening is not None:
            pieces = self._learn_spaced(pieces)
        found = self.library.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        if None in found.word_ids:  # a special token's string stands in a piece
            for piece in pieces:
                self.known[piece] = self._library_ids(piece)
            return
        owners = np.array(found.word_ids, dtype=np.int64)
        self._keep(pieces, np.array(found.ids, dtype=self.id_type), np.bincount(owners, minlength=len(pieces)))

    def _learn_words(self, pieces: list[str]) -> list[str]:
        """Learn those pieces that are a word, or a word and a mark, from one text of them all: each word and mark ends
        with an id that closes a word, which tells the pieces apart without offsets. Returns the other pieces."""
        plain, marked, other = [], [], []
        for piece in pieces:
            if piece.isalpha():
                plain.append(piece)
            elif piece[-1] in ".,;:!?" and piece[:-1].isalpha():
                marked.append(piece)
            else:
                other.append(piece)
        for own, words in ((plain, 1), (marked, 2)):
            ids = np.array(self.library.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, dtype=self.id_type)
            ends = np.flatnonzero(self.closing[ids])[words - 1 :: words] + 1
            if len(ends) != len(own) or (len(own) and ends[-1] != len(ids)):
                other += own  # not as expected: let the library tell
            else:
                self._keep(own, ids, np.diff(np.append(0, ends)))
        return other

    def _learn_spaced(self, pieces: list[str]) -> list[str]:
        """Learn those pieces that are a space and a word from one text of them all: each begins with an id that opens with
        a space, and no other id does. Returns the other pieces."""
        own, other = [], []
        for piece in pieces:
            (own if piece[0] == " " and piece[1:].isalpha() else other).append(piece)
        ids = np.array(self.library.encode_batch_fast(["".join(own)], add_special_tokens=False)[0].ids, dtype=self.id_type)
        starts = np.flatnonzero(self.opening[ids])
        if len(starts) != len(own) or (len(own) and starts[0]):
            return pieces  # not as expected: let the library tell
        self._keep(own, ids, np.diff(np.append(starts, len(ids))))
        return other

    def _keep(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        raw = ids.tobytes()
        start = 0
        for piece, end in zip(pieces, (np.cumsum(sizes) * self.id_type.itemsize).tolist()):
            self.known[piece] = raw[start:end]
            start = end
