"""Vectorised word hashing over Arrow string buffers.

Words are runs of bytes outside {0x20, 0x09-0x0D}; A-Z are lower-cased. A word's 64-bit hash is a polynomial over its
bytes modulo 2**64 followed by an avalanche step, found for a whole chunk of documents by one cumulative sum, so that no
Python object is made for a word. Chunks are cut between documents, at about `CHUNK` bytes, whatever the batch's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_ROLL = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """An invertible avalanche of 64-bit integers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = max(CHUNK, 1 << (n - 1).bit_length()) if n else CHUNK
    if size not in _powers:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.empty(size, dtype=np.uint64)
            out[0], have = 1, 1
            while have < size:
                out[have : 2 * have] = out[:have] * np.uint64(pow(base, have, 1 << 64))
                have *= 2
            both.append(out)
        if size > CHUNK:  # of one very long document: not kept
            return both[0], both[1]
        _powers[size] = (both[0], both[1])
    return _powers[size]


@dataclass
class Words:
    """The words of consecutive documents `first` to `first + len(count) - 1` of a batch."""

    first: int
    hashes: np.ndarray  # uint64, of all words in order
    count: np.ndarray  # words of each document
    bound: np.ndarray  # where each document's words begin in `hashes`; one more at the end

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offset = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)), offset


def words(column: pa.Array, chunk: int = CHUNK) -> Iterator[Words]:
    """Hashed words of a string column, some documents at a time."""
    data, offset = strings(column)
    first, n = 0, len(offset) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offset, offset[first] + chunk, side="right")) - 1)
        yield _hash(data[offset[first] : offset[last]], offset[first : last + 1] - offset[first], first)
        first = last


def _hash(raw: np.ndarray, offset: np.ndarray, first: int) -> Words:
    size = len(raw)
    if not size:
        none = np.zeros(len(offset) - 1, dtype=np.int64)
        return Words(first, np.empty(0, np.uint64), none, np.zeros(len(offset), dtype=np.int64))
    inside = _IS_WORD[raw]
    cut = np.zeros(size + 1, dtype=bool)  # a document starts here
    cut[offset] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:size]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:size]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    power, inverse = powers(size)
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * power[:size], out=sums[1:])
    bound = np.searchsorted(starts, offset)
    return Words(first, mix((sums[ends] - sums[starts]) * inverse[starts]), np.diff(bound), bound)


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's five-word windows in order, and where each document's begin; fewer words: all as one."""
    h = w.hashes
    n = np.where(w.count >= SHINGLE, w.count - SHINGLE + 1, np.minimum(w.count, 1))
    bound = np.concatenate([[0], np.cumsum(n)])
    if not len(h):
        return np.empty(0, np.uint64), bound
    padded = np.concatenate([h, np.zeros(SHINGLE - 1, np.uint64)])
    rolled = np.zeros(len(h), dtype=np.uint64)
    for k in range(SHINGLE):
        rolled += mix(padded[k : k + len(h)] ^ _ROLL[k]) * _ROLL[k]
    at = np.arange(bound[-1]) - np.repeat(bound[:-1], n) + np.repeat(w.bound[:-1], n)
    out = mix(rolled[at])
    for d in np.flatnonzero((w.count > 0) & (w.count < SHINGLE)):
        own = h[w.bound[d] : w.bound[d + 1]]
        out[bound[d]] = mix((mix(own ^ _ROLL[: len(own)]) * _ROLL[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
    return out, bound


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
