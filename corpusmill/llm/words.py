"""Vectorised word and shingle hashing over Arrow text buffers.

A word is a maximal run of bytes outside the separator set after A-Z are lower-cased; separators are ASCII,
so working on UTF-8 bytes gives the same words as working on code points. Hashes are 64-bit. Two different
words share a hash with probability 2**-64 a pair, which no result of these operators can notice in practice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at once; bounds the working memory of a Python worker.
BLOCK = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPAN = 4096
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(_SPAN - 1, 0x9E3779B97F4A7C15 | 1, np.uint64)], dtype=np.uint64)
_ORDER = _rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def separators(kind: str = "space") -> np.ndarray:
    """Boolean table of separator bytes. space: 0x20 and 0x09-0x0D. letters: every ASCII byte but letters and digits."""
    table = np.zeros(256, bool)
    if kind == "space":
        table[[0x20, *range(0x09, 0x0E)]] = True
    else:
        table[:128] = True
        for a, b in ((48, 58), (65, 91), (97, 123)):
            table[a:b] = False
    return table


SPACE = separators()
PUNCTUATED = separators("letters")


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on 64 bits (multiply and xor-shift)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def hash_block(data: np.ndarray, bounds: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of data, their start offsets and their lengths. Words do not cross the offsets in bounds."""
    inside = ~sep[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    packed = _LOWER[data[inside]]
    rank = np.cumsum(inside)
    begin = rank[starts] - 1
    lengths = np.diff(np.r_[begin, len(packed)])
    within = np.arange(len(packed)) - np.repeat(begin, lengths)
    values = _TABLE[packed] * _POWERS[within & (_SPAN - 1)]
    return mix(np.add.reduceat(values, begin) + lengths.astype(np.uint64) * _ORDER[7]), starts, lengths


def endings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each word its last two bytes, lower-cased, before one closing punctuation mark, as a number below 2**16."""
    last = starts + lengths - 1
    last = last - ((lengths > 1) & PUNCTUATED[data[last]])
    return _LOWER[data[last]].astype(np.int64) * 256 + np.where(last > starts, _LOWER[data[np.maximum(last - 1, 0)]], 0)


def _slices(piece: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of one long text of about BLOCK bytes, cut after a separator."""
    a = 0
    while a < len(piece):
        b = min(a + BLOCK, len(piece))
        while b < len(piece) and not sep[piece[b - 1]]:
            more = np.flatnonzero(sep[piece[b : b + BLOCK]])
            b = b + int(more[0]) + 1 if len(more) else min(b + BLOCK, len(piece))
        yield a, b
        a = b


def words(column: pa.Array, sep: np.ndarray = SPACE, ends: bool = False) -> Iterator[tuple]:
    """(first row, end row, word hashes, offsets of each row's words[, endings]) for consecutive groups of rows of about BLOCK bytes.

    A longer text forms a group of its own and is hashed piecewise, cut at separators.
    """
    data, at = text_buffer(column)
    low, n = 0, len(at) - 1
    while low < n:
        high = int(np.searchsorted(at, at[low] + BLOCK, "right")) - 1
        high = min(max(high, low + 1), n)
        piece, bounds = data[at[low] : at[high]], at[low : high + 1] - at[low]
        if len(piece) <= 2 * BLOCK:
            h, starts, lengths = hash_block(piece, bounds, sep)
            offsets, tails = np.searchsorted(starts, bounds), endings(piece, starts, lengths) if ends else None
        else:  # one long text
            parts = [(piece[a:b], hash_block(piece[a:b], np.array([0, b - a]), sep)) for a, b in _slices(piece, sep)]
            h = np.concatenate([x[0] for _, x in parts])
            offsets, tails = np.array([0, len(h)]), np.concatenate([endings(d, *x[1:]) for d, x in parts]) if ends else None
        yield (low, high, h, offsets, tails) if ends else (low, high, h, offsets)
        low = high


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of `size` words; a shorter text is one run; no words give none."""
    n = len(h)
    if n == 0:
        return h
    if n < size:
        return mix((h * _ORDER[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = h[: n - size + 1] * _ORDER[0]
    for k in range(1, size):
        total = total + h[k : n - size + 1 + k] * _ORDER[k]
    return np.unique(mix(total))


class Lookup:
    """Vectorised map from 64-bit keys to positions in the array of keys given (open addressing); -1 where absent."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = np.zeros(1 << bits, np.uint64)
        left, probe = np.arange(len(keys)), mix(keys) & self.mask
        self.rounds = 0
        while len(left):
            free = self.slots[probe] < 0
            self.slots[probe[free]] = left[free]  # of several writers one stays
            won = self.slots[probe] == left
            self.keys[probe[won]] = keys[left[won]]
            left, probe = left[~won], (probe[~won] + np.uint64(1)) & self.mask
            self.rounds += 1

    def find(self, query: np.ndarray) -> np.ndarray:
        probe = mix(query) & self.mask
        found = self.slots[probe]
        bad = np.flatnonzero((found >= 0) & (self.keys[probe] != query))
        for _ in range(self.rounds):
            if not len(bad):
                break
            probe_b = (probe[bad] + np.uint64(1)) & self.mask
            probe[bad] = probe_b
            found[bad] = self.slots[probe_b]
            bad = bad[(found[bad] >= 0) & (self.keys[probe_b] != query[bad])]
        found[bad] = -1  # no key lies further from its place
        return found
