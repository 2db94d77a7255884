"""Word shingles of many texts at once, as 64 bit hashes over one array of all bytes."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, count: int) -> np.ndarray:
    """Powers of an odd number or of its inverse modulo 2 ** 64."""
    if len(_powers[kind]) < count:
        base = np.uint64(_ODD if kind == "up" else pow(_ODD, -1, 1 << 64))
        steps = np.full(max(count, 1 << 21), base, dtype=np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:count]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, document, first byte, end byte)`` of every word; bytes are counted in the word's own text.

    Words are runs of bytes that are not white space (space, tab to carriage return), A-Z in lower case.
    """
    data = np.frombuffer(b" ".join(texts).translate(_LOWER), dtype=np.uint8)
    sizes = np.array([len(text) for text in texts], dtype=np.int64)
    text_start = np.cumsum(sizes + 1) - sizes - 1
    solid = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), out=total[1:])
    hashes = mixed((total[end] - total[first]) * _power("down", len(data))[first])
    document = np.searchsorted(text_start, first, side="right") - 1
    return hashes, document, first - text_start[document], end - text_start[document]


def shingles(hashes: np.ndarray, document: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, document)`` of every run of ``size`` words of one document, in order of place."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        total = total * np.uint64(_ODD) + hashes[i : i + n]
    inside = document[:n] == document[size - 1 :]
    return mixed(total)[inside], document[:n][inside]


def shingle_sets(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, document)``: the distinct shingles of each text, sorted by document and hash.

    A text with fewer words than ``size`` has its whole sequence as the only shingle; one without words has none.
    """
    hashes, document, _, _ = words(texts)
    found, owner = shingles(hashes, document, size)
    number = np.bincount(document, minlength=len(texts))
    short = (number[document] < size) if len(document) else np.empty(0, dtype=bool)
    if short.any():
        own, at = np.unique(document[short], return_index=True)
        bounds = np.append(at, short.sum())
        values = hashes[short]
        whole = []
        for start, end in zip(bounds, bounds[1:]):
            total = np.array([end - start], dtype=np.uint64)  # the number of words takes part: unlike a run of `size` words
            for i in range(start, end):
                total = mixed(total * np.uint64(_ODD) + values[i : i + 1])
            whole.append(total[0])
        found, owner = np.append(found, np.array(whole, dtype=np.uint64)), np.append(owner, own)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    fresh = np.ones(len(found), dtype=bool)
    fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[fresh], owner[fresh]
