"""Text as byte arrays: Arrow string columns cut into words or pre-tokens and hashed with NumPy.

Prefix sums of `byte * base^place` modulo the prime 2^31 - 1, for two bases, give a 62-bit polynomial hash
of any slice in constant time, so a batch is hashed without making a Python string per word. (Modulo 2^64
such sums are equal for Thue-Morse words of every base; modulo a prime they are not.) Batches are cut into
blocks of a few MB at row ends, which bounds memory whatever the Arrow batch holds; one text longer than a
block is a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PRIME = (1 << 31) - 1
BASES = (1_229_782_938, 1_747_291_913)
BLOCK = 2 << 20
#: Up to so many bytes a prefix sum of unreduced terms stays below 2^64.
UNREDUCED = 1 << 24
_powers: dict[int, np.ndarray] = {}


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    p, bits = np.uint64(PRIME), np.uint64(31)
    x = (x & p) + (x >> bits)
    x = (x & p) + (x >> bits)
    return np.where(x >= p, x - p, x)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo PRIME; kept and grown by doubling."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, BLOCK + (1 << 16))
        out = np.ones(size, np.uint64)
        k = 1
        while k < size:
            m = min(k, size - k)
            out[k : k + m] = reduced(out[:m] * np.uint64(pow(base, k, PRIME)))
            k += m
        held = _powers[base] = out.astype(np.uint32)
    return held[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Slices:
    """Hashes of slices of one byte array."""

    def __init__(self, data: np.ndarray):
        self.sums, self.inverse = [], []
        wide = data.astype(np.uint64) + np.uint64(1)
        for base in BASES:
            term = wide * powers(base, len(data))
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(reduced(term) if len(data) > UNREDUCED else term, out=sums[1:])
            self.sums.append(sums)
            self.inverse.append(powers(pow(base, -1, PRIME), len(data) + 1))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = (reduced(reduced(s[end] - s[start]) * i[start]) for s, i in zip(self.sums, self.inverse, strict=True))
        return mixed((a << np.uint64(32) | b) + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets into them); nulls are empty texts."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs of bytes that are not space, tab, \\n, \\v, \\f or \\r."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = solid[inner]  # a row's first byte never continues the row before
    start = np.flatnonzero(begins)
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[inner - 1] = solid[inner - 1]
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


class HashTable:
    """64-bit key -> dense number, open addressing, looked up and filled a whole array at a time."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers, -1 for keys that are not there."""
        mask = np.uint64((1 << self.bits) - 1)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        at = keys & mask
        while len(todo):
            value = self.values[at]
            same = (self.keys[at] == keys[todo]) & (value >= 0)
            out[todo[same]] = value[same]
            on = (value >= 0) & ~same
            todo, at = todo[on], (at[on] + np.uint64(1)) & mask
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of new keys, which must be distinct and absent."""
        while (self.used + len(keys)) * 2 > 1 << self.bits:
            old = self.values >= 0
            k, v = self.keys[old], self.values[old]
            self.bits += 1
            self.keys = np.zeros(1 << self.bits, np.uint64)
            self.values = np.full(1 << self.bits, -1, np.int64)
            self._place(k, v)
        new = np.arange(self.used, self.used + len(keys), dtype=np.int64)
        self._place(keys, new)
        self.used += len(keys)
        return new

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        mask = np.uint64((1 << self.bits) - 1)
        todo, at = np.arange(len(keys)), keys & mask
        while len(todo):
            free = self.values[at] < 0
            self.values[at[free]] = values[todo[free]]
            self.keys[at[free]] = keys[todo[free]]
            won = free & (self.values[at] == values[todo])
            todo, at = todo[~won], (at[~won] + np.uint64(1)) & mask


def per_batch(body: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield body(b)

    return run
