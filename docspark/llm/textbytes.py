"""Texts of an Arrow batch as one byte array, with hashes of any of its spans.

A span's hash is a polynomial over its bytes modulo the prime 2**61 - 1, with a base drawn once at random, read off
prefix sums and then mixed with its length. Equal spans have equal hashes; two different spans of up to n bytes are
roots of a polynomial of that degree and agree for at most n of the 2**61 bases. (A power of two as modulus would let
strings built by doubling agree for every base.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PRIME = (1 << 61) - 1
BASE = 0x11D3A8C5F04B2E97
INVERSE = pow(BASE, -1, PRIME)
# Bytes handled at a time inside a task; a longer text is handled alone.
CHUNK = 1 << 20

_powers: dict[int, np.ndarray] = {}


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); a null is an empty text."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, body = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = max(i + 1, min(j, n))
        yield i, j
        i = j


_P, _LOW31, _LOW30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)
# Bytes whose products, below 2**40, can be added up in 64 bits.
BLOCK = 1 << 22


def _near(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime or up to 7 above it, for any 64-bit values."""
    out = x >> _61
    out += x & _P
    return out


def _folded(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime."""
    x = _near(x)
    x -= (x >= _P) * _P
    return x


def _shifted(x: np.ndarray) -> np.ndarray:
    """``x`` times 2**31 modulo the prime, unfolded, for values below 2**61 or so."""
    return (x >> _30) + ((x & _LOW30) << _31)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime."""
    ah, al, bh, bl = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    return _folded(_near(np.uint64(2) * ah * bh + _shifted(ah * bl + al * bh)) + al * bl)


def _power(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a base, by doubling; those of usual lengths are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, times(have, np.uint64(pow(base, len(have), PRIME)))])
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53]


def windows_of(data: np.ndarray, doublings: int) -> np.ndarray:
    """A hash of the ``2**doublings`` bytes from every place that has as many, by pairs of halves."""
    h = BYTE_HASH[data]
    for i in range(doublings):
        size = 1 << i
        if len(h) <= size:
            return np.zeros(0, np.uint64)
        left = h[:-size] * np.uint64(ODD[i % len(ODD)])
        left += h[size:]
        h = left
    return mixed(h)


class Spans:
    """Hashes of spans of one byte array."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power = _power(BASE, n)
        self.sums = np.zeros(n + 1, np.uint64)
        for i in range(0, n, BLOCK):
            v, w = data[i : i + BLOCK].astype(np.uint64), power[i : i + BLOCK]
            v += np.uint64(1)
            low = v * (w & _LOW31)
            v *= w >> _31
            np.cumsum(v, out=v)
            np.cumsum(low, out=low)
            total = _shifted(_near(v))
            total += _near(low)
            total = _near(total)
            total += self.sums[i]
            self.sums[i + 1 : i + 1 + len(v)] = _near(total)
        self.back = _power(INVERSE, n + 1)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return times(_near(self.sums[end] + (np.uint64(2) * _P - self.sums[start])), self.back[start])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed(self.raw(start, end) ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the total) of the runs of ``[^\\x20\\x09-\\x0D]``."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~SPACE[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | begins[1:]
    starts = np.flatnonzero(start[:n])
    stop = np.zeros(n + 1, bool)
    stop[1:] = inside[:-1] & (~inside[1:] | begins[1:])
    if n:
        stop[n] = inside[n - 1]
    ends = np.flatnonzero(stop)
    return starts, ends, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``start, start + 1, …`` of every range, one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def binary(parts: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array over one buffer of bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(parts))]).cast(pa.binary())
