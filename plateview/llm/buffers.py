"""Texts of an Arrow batch as one array of bytes, and the words in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Word characters by byte; bytes of 0x80 and above belong to code points outside ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of SplitMix64, a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def odd_powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values, and where each begins (one more than values); NULL is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0]: ends[-1]], ends - ends[0]


def chunks(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer value is a range of its own."""
    low, n = 0, len(ends) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + most, side="right")) - 1)
        yield low, min(high, n)
        low = high


def values(column: pa.Array, rows: int = 256) -> Iterator:
    """The values of a column one by one; only ``rows`` of them are Python objects at a time."""
    for low in range(0, len(column), rows):
        yield from column.slice(low, rows).to_pylist()


class Words:
    """Words of several texts: first and last byte, the text each belongs to, and a 64-bit hash.

    Words are runs of the bytes that ``allowed`` marks; they never cross texts. A-Z count as a-z.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, allowed: np.ndarray):
        inside = allowed[data]
        begins, stops = inside.copy(), inside.copy()
        if len(data):
            borders = ends[1:-1][ends[1:-1] < len(data)]
            border = np.zeros(len(data) + 1, dtype=bool)
            border[borders] = border[0] = border[-1] = True
            begins[1:] &= ~inside[:-1] | border[1:-1]
            stops[:-1] &= ~inside[1:] | border[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.bounds = np.searchsorted(self.start, ends)
        self.text = np.repeat(np.arange(len(ends) - 1), np.diff(self.bounds))
        self.hash = self._hashes(data, inside)

    def _hashes(self, data: np.ndarray, inside: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U64)
        size = self.end - self.start
        where = np.cumsum(size) - size
        letters = _LOWER[data[inside]].astype(U64) + U64(1)
        place = np.arange(len(letters)) - np.repeat(where, size)
        letters *= odd_powers(0x9E3779B97F4A7C15, int(size.max()))[place]
        return mix(np.add.reduceat(letters, where) + size.astype(U64))
