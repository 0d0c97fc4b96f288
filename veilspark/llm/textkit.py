"""Vectorised views of text columns, shared by the operators of this folder.

Arrow string columns are one UTF-8 buffer plus offsets; the functions here work on that buffer with numpy, in blocks of
bounded size, so that memory does not follow the number of rows in a batch. Words are maximal runs of bytes other than
space and 0x09-0x0D (UTF-8 never uses those bytes inside a longer character). Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
BLOCK_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEED = np.random.default_rng(20240229)
BYTE_CODE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_CODE_LOWER = BYTE_CODE.copy()
BYTE_CODE_LOWER[65:91] = BYTE_CODE[97:123]
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int, kind: str) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        grown = np.full(max(n, 2 * BLOCK_BYTES), _STEP if kind == "up" else _BACK, np.uint64)
        grown[0] = 1
        have = np.multiply.accumulate(grown)
        if n <= 8 * BLOCK_BYTES:
            _powers[kind] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(column: pa.Array | pa.ChunkedArray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets): whole rows, together at most `most` bytes or a single row. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        own = offsets[at : to + 1]
        yield at, to, data[own[0] : own[-1]], own - own[0]
        at = to


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that stay within a row: starts, ends, and for each row the index of its first run (with a last entry)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < n]] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(~SPACE[data], offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """One 64-bit hash for each span; `lower` takes A-Z as a-z."""
    return coded((BYTE_CODE_LOWER if lower else BYTE_CODE)[data], starts, ends)


def coded(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As hashes(), from a random 64-bit code for each symbol."""
    n = len(codes)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * _power(n, "up")[:n], out=total[1:])
    h = (total[ends] - total[starts]) * _power(n + 1, "down")[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _ODD)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each span, from `first` as spans() gives it."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` words in a row of words, and for each row the index of its first. Rows with 1 to width - 1 words: all as one."""
    count = np.diff(first)
    made = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    at = np.zeros(len(count) + 1, np.int64)
    np.cumsum(made, out=at[1:])
    factor = [mix(np.array([k * 2 + 1], np.uint64))[0] | np.uint64(1) for k in range(width + 1)]
    m = max(0, len(h) - width + 1)
    rolled = np.full(m, factor[width], np.uint64)
    for k in range(width):
        rolled += h[k : k + m] * factor[k]
    starts = np.repeat(first[:-1] - at[:-1], made) + np.arange(at[-1])
    out = rolled[np.minimum(starts, max(m - 1, 0))] if m else np.zeros(at[-1], np.uint64)
    for r in np.flatnonzero((count > 0) & (count < width)):
        own = h[first[r] : first[r + 1]]
        total = len(own) * int(_ODD)
        for k, x in enumerate(own):
            total += int(x) * int(factor[k])
        out[at[r]] = np.uint64(total & 0xFFFFFFFFFFFFFFFF)
    return mix(out), at


class HashIndex:
    """Open addressing over 64-bit keys with vectorised look-up; slot numbers count from 0 in order of insertion."""

    def __init__(self, bits: int = 16):
        self.n = 0
        self._size(bits)

    def _size(self, bits: int) -> None:
        self.bits, self.keys, self.slots = bits, np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 if absent."""
        mask = np.int64((1 << self.bits) - 1)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        place = at[todo]
        while len(todo):
            place = (place + 1) & mask
            got = self.slots[place]
            out[todo] = got
            more = (got >= 0) & (self.keys[place] != h[todo])
            todo, place = todo[more], place[more]
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Inserts distinct keys that are absent; returns their slots."""
        if (self.n + len(h)) * 2 > 1 << self.bits:
            used = self.slots >= 0
            keys, slots = self.keys[used], self.slots[used]
            self._size(max(self.bits + 1, int(self.n + len(h)).bit_length() + 2))
            self._put(keys, slots)
        slots = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self._put(h, slots)
        self.n += len(h)
        return slots

    def _put(self, h: np.ndarray, slots: np.ndarray) -> None:
        mask = np.int64((1 << self.bits) - 1)
        place = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = self.slots[place] < 0
            self.slots[place[free]] = slots[todo[free]]
            self.keys[place[free]] = h[todo[free]]
            lost = (self.slots[place] != slots[todo])
            todo, place = todo[lost], (place[lost] + 1) & mask
