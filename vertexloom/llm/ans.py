"""Static range asymmetric numeral system for blocks of token ids.

All blocks share one table of frequencies that sum to ``2 ** SCALE``. A block is coded by ``LANES`` interleaved coders:
lane ``j`` has the ids at ``j, j + LANES, ...``. A step codes one id per lane, in numpy over all lanes. States are 64 bit
numbers in ``[LOW, LOW << 32)``; a lane that would leave them moves 32 bits to or from the block's one stream of words.

Block format, little-endian: header (magic, ids, lanes, steps per checkpoint, words, crc32 of the rest, crc32 of the
ids), then per checkpoint the place in the stream as a 64 bit number and all lanes' states, then the words. The
checkpoint at step 0 starts the block; any other lets a decoder start there.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

SCALE = 20
LOW = 1 << 31
LANES = 2048
CHECKPOINT = 128  # steps between two checkpoints
HEADER = struct.Struct("<4sIIIIII")
MAGIC = b"RANS"


@dataclass
class Frequencies:
    """Shared table: ``freq`` and ``start`` per id, and the id of each of the ``2 ** SCALE`` slots."""

    freq: np.ndarray
    start: np.ndarray
    _slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def table_of(freq: np.ndarray) -> Frequencies:
    freq = freq.astype(np.uint64)
    return Frequencies(freq, np.cumsum(freq, dtype=np.uint64) - freq)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to ``2 ** SCALE``, at least 1 for every id that occurs."""
    counts = counts.astype(np.float64)
    seen = counts > 0
    if not seen.any():
        return np.zeros(len(counts), np.uint32)
    total, target = counts.sum(), 1 << SCALE
    if seen.sum() > target:
        raise ValueError("more distinct ids than the scale can hold")
    freq = np.where(seen, np.maximum(1, np.floor(counts / total * target)), 0).astype(np.int64)
    excess = int(freq.sum()) - target
    order = np.argsort(-freq, kind="stable")
    while excess:  # the most frequent ids give or take what rounding left, never falling below 1
        if excess < 0:
            freq[order[0]] -= excess
            break
        take = np.minimum(freq[order] - 1, -(-freq[order] * excess // target) + 1)
        take = np.minimum(take, np.maximum(0, excess - (np.cumsum(take) - take)))
        freq[order] -= take
        excess -= int(take.sum())
    return freq.astype(np.uint32)


def encode(ids: np.ndarray, table: Frequencies, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
    """The block of ``ids``; its last step may have fewer ids than lanes."""
    n = len(ids)
    steps = -(-n // lanes)
    freq, start = table.freq[ids], table.start[ids]
    if n and not freq.all():
        raise ValueError("an id has no frequency")
    state = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    checkpoints: list[tuple[int, bytes]] = []
    emitted = 0
    shift, scale = np.uint64(32), np.uint64(SCALE)
    limits = freq << np.uint64(31 - SCALE + 32)
    for step in range(steps - 1, -1, -1):
        part = slice(step * lanes, min(n, step * lanes + lanes))
        f, x = freq[part], state[: part.stop - part.start]
        full = x >= limits[part]
        if full.any():
            out = x[full]
            words.append(out.astype("<u4"))  # the low 32 bits
            emitted += len(out)
            x[full] = out >> shift
        quotient = x // f
        x += quotient * ((np.uint64(1) << scale) - f) + start[part]
        if step % every == 0:
            checkpoints.append((emitted, state.astype("<u8").tobytes()))
    words.reverse()
    stream = np.concatenate(words).tobytes() if words else b""
    marks = b"".join(struct.pack("<Q", emitted - at) + states for at, states in reversed(checkpoints))
    body = marks + stream
    return HEADER.pack(MAGIC, n, lanes, every, emitted, zlib.crc32(body), zlib.crc32(ids.astype("<u4"))) + body


def decode(block: bytes, table: Frequencies, first_checkpoint: int = 0, checkpoints: int | None = None) -> np.ndarray:
    """The ids of a block as 32 bit numbers, or those from one checkpoint on for a number of them.

    Raises ValueError if a checksum does not hold; the one over the ids is tested where all of them are decoded.
    """
    magic, n, lanes, every, emitted, crc_body, crc_ids = HEADER.unpack_from(block)
    if magic != MAGIC or zlib.crc32(memoryview(block)[HEADER.size :]) != crc_body:
        raise ValueError("damaged block")
    steps = -(-n // lanes)
    marks = -(-steps // every)
    last = marks if checkpoints is None else min(marks, first_checkpoint + checkpoints)
    if first_checkpoint >= last:
        return np.empty(0, dtype=np.uint32)
    size = 8 + 8 * lanes
    at = HEADER.size + first_checkpoint * size
    place = struct.unpack_from("<Q", block, at)[0]
    state = np.frombuffer(block, dtype="<u8", count=lanes, offset=at + 8).copy()
    stream = np.frombuffer(block, dtype="<u4", count=emitted, offset=HEADER.size + marks * size)
    begin, end = first_checkpoint * every, min(steps, last * every)
    ids = np.empty(min(n, end * lanes) - begin * lanes, dtype=np.uint32)
    slots, freq, start = table.slots, table.freq, table.start
    mask, scale, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    low = np.uint64(LOW)
    for step in range(begin, end):
        part = slice((step - begin) * lanes, min(len(ids), (step - begin + 1) * lanes))
        x = state[: part.stop - part.start]
        slot = x & mask
        found = slots[slot]
        ids[part] = found
        x >>= scale
        x *= freq[found]
        x += slot - start[found]
        empty = np.flatnonzero(x < low)
        if len(empty):
            x[empty] = (x[empty] << shift) | stream[place : place + len(empty)]
            place += len(empty)
    if begin == 0 and end == steps and zlib.crc32(ids.astype("<u4")) != crc_ids:
        raise ValueError("wrong ids")
    return ids
