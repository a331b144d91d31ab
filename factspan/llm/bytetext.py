"""Vectorised work on batches of UTF-8 texts held as one byte array."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_LIBC = ctypes.CDLL(None)
_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A scrambled 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(_GOLDEN))

_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


class PrefixHash:
    """Prefix polynomial hashes: the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]


def binary(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("").cast(pa.large_binary()) if col.type != pa.large_binary() else col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data, offsets


def trim() -> None:
    """Give memory that is free back to the system: idle workers share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def chunks(batch: pa.RecordBatch, name: str, size: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Split a batch into runs of rows with about ``size`` bytes of text: (rows, bytes, offsets from 0)."""
    data, offsets = binary(batch.column(name))
    at, n = 0, batch.num_rows
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        stop = min(stop, n)
        yield batch.slice(at, stop - at), data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop
    trim()


def char_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words of letters and digits: 0-9, a-z and everything beyond ASCII.
ALNUM = char_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes of words between white space.
NONSPACE = ~char_class((0x09, 0x0D), (0x20, 0x20))


class Words:
    """Words of a run of texts: byte spans, the text each belongs to, and a hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = member[self.data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        self.start = np.flatnonzero(inside & (~before[:-1] | cut[:-1]))
        after = np.zeros(len(data), bool)
        if len(data):
            after[:-1] = inside[1:]
        self.stop = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)  # number of words before each text
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.count)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = mix(PrefixHash(self.data).of(self.start, self.stop) ^ (self.stop - self.start).astype(U64))
        return self._hash

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``n`` words that stays in one text."""
        h = self.hash
        if len(h) < n:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        m = len(h) - n + 1
        g = np.zeros(m, U64)
        for k in range(n):
            g = g * U64(0xD1342543DE82EF95) + h[k : k + m]
        at = np.flatnonzero(self.text[:m] == self.text[n - 1 :])
        return at, mix(g[at] ^ U64(n))

    def join(self, at: int, n: int) -> bytes:
        raw = self.data
        return b" ".join(raw[self.start[i] : self.stop[i]].tobytes() for i in range(at, at + n))


class StepTable:
    """A map from pairs of small numbers to numbers, for many lookups at once (open addressing)."""

    def __init__(self, pairs: dict[tuple[int, int], int], width: int):
        self.width = width
        keys = [a * width + b for a, b in pairs]
        bits = max(18, (4 * len(keys)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, U64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        homes = (mix(np.array(keys, np.int64).astype(U64)) >> self.shift).astype(np.int64)
        for k, at, to in zip(keys, homes.tolist(), pairs.values(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = k, to

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The value of each pair, or -1; pairs with a negative member have none."""
        key = a * self.width + b
        at = (mix(key.astype(U64)) >> self.shift).astype(np.int64)
        found = self.keys[at]
        known = (a >= 0) & (b >= 0)
        out = np.where((found == key) & known, self.values[at], -1)
        todo = np.flatnonzero((found != key) & (found >= 0) & known)
        spot = at[todo]
        while len(todo):
            spot = (spot + 1) & self.mask
            found = self.keys[spot]
            hit = found == key[todo]
            out[todo[hit]] = self.values[spot[hit]]
            go = ~hit & (found >= 0)
            todo, spot = todo[go], spot[go]
        return out
