"""Vectorised word splitting and hashing of Arrow text batches (numpy).

A word is a maximal run of bytes other than space and the bytes 9-13. All
functions work on one bounded slice of a batch at a time, so their memory
follows SLICE_BYTES (or the longest single text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept per worker."""
    if "up" not in _powers or len(_powers["up"]) < n:
        n = max(n, SLICE_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            p = np.full(n, _U(base), dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def text_slices(column: pa.Array, size: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into (first row, end row, bytes, offsets) slices.

    Nulls count as empty texts. A slice holds whole texts, `size` bytes of
    them (SLICE_BYTES by default) or a single longer one.
    """
    size = size or SLICE_BYTES
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of each word, its first byte, and for each text its first word (with an end mark)."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    begins[heads] = ~space[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(len(off), np.int64)
    up, down = _power_tables(len(raw))
    value = raw.astype(np.uint64)
    value += _U(1)
    value[space] = 0
    value *= up[: len(raw)]
    sums = np.add.reduceat(value, starts)
    return mix(sums * down[starts]), starts, np.searchsorted(starts, off)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n consecutive words from each position (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= _U(0xD6E8FEB86659FD93)
        out += h[k : k + m]
    return mix(out)
