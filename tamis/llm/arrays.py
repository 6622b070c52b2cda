"""Numpy views of Arrow text columns: pieces of a batch, words, rolling identifiers, minimizers.

Everything here works on one piece of a batch at a time, so a task's memory is bounded by the piece
size (or by its longest document), not by the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 18
POSITION_BITS = np.uint64(28)

_SEED = np.random.default_rng(20240607)
BYTE_CODES = _SEED.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C13)  # 3 mod 8
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)

#: The contracts' word class is [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def cut(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows of a text column, their bytes in one array, offsets) with at most ``limit`` bytes unless one row has more."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    return cut(batch.column(text), limit)


def lean(run: Callable) -> Callable:
    """run, a task's generator of batches, and then give what the worker has freed back: workers stay for the tasks after."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return wrapped


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the word offsets of the rows. Words never cross rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    if n:
        out[0] = 1
        have = 1
        while have < n:
            more = min(have, n - have)
            out[have : have + more] = out[:more] * (out[have - 1 : have] * base)
            have += more
    return out


_UP, _DOWN = _powers(PIECE_BYTES + 1, _BASE), _powers(PIECE_BYTES + 1, _BASE_INVERSE)


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for n bytes; those of the rare longer texts are not kept."""
    return (_UP, _DOWN) if n <= len(_UP) else (_powers(n, _BASE), _powers(n, _BASE_INVERSE))


def finish(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def word_ids(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit identifier of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers_for(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[seed][data] * up[: len(data)], out=sums[1:])
    return finish((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Identifier of two neighbouring buckets: what refines a bucket by the one at a later offset."""
    x = b ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x *= _M3
    x ^= x >> np.uint64(32)
    x += a
    x *= _M1
    x ^= x >> np.uint64(29)
    return x


class Doubling:
    """Bucket identifiers of all substrings of 1, 2, 4, ... units; each length reuses those of the half length."""

    def __init__(self, units: np.ndarray, up_to: int):
        self.levels = [units]
        length = 1
        while length * 2 <= up_to and length * 2 <= len(units):
            a = self.levels[-1]
            self.levels.append(pair(a[:-length], a[length:], length))
            length *= 2

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Identifiers of the substrings of ``length`` units at ``starts``."""
        p = length.bit_length() - 1
        if not len(starts):
            return np.zeros(0, np.uint64)
        a = self.levels[p]
        return pair(a[starts], a[starts + (length - (1 << p))], length)

    def all(self, length: int) -> np.ndarray:
        p = length.bit_length() - 1
        if len(self.levels) <= p or len(self.levels[0]) < length:
            return np.zeros(0, np.uint64)
        a, n = self.levels[p], len(self.levels[0]) - length + 1
        return pair(a[:n], a[length - (1 << p) :][:n], length)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys."""
    m, length = keys, 1
    while length * 2 <= width:
        m = np.minimum(m[:-length], m[length:])
        length *= 2
    rest = width - length
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
