"""Distinct pieces of Arrow text slices, so that a tokenizer sees each of them once.

A text is cut where its tokenizer cuts in any case. The pieces of a slice are
put into a dictionary by Arrow; only pieces that the worker has not met lately
go through the tokenizer, and the rest is gathered by number in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lengths[i]] of all i, one behind the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def white(raw: np.ndarray) -> np.ndarray:
    """Space and the bytes 9 to 13."""
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def distinct(raw: np.ndarray, off: np.ndarray, dropped: np.ndarray, cut: np.ndarray | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct pieces, the number of each piece in them, and each text's first piece (with an end mark).

    dropped marks the bytes between pieces, cut those that start a piece in
    any case. A piece is a run of other bytes of one text.
    """
    kept = ~dropped
    begins = kept.copy()
    begins[1:] &= dropped[:-1] if cut is None else dropped[:-1] | cut[1:]
    heads = off[:-1][off[:-1] < off[1:]]
    begins[heads] = kept[heads]
    at = np.flatnonzero(begins)
    if not len(at):
        return [], np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ends = np.cumsum(kept)
    offsets = np.append(ends[at] - 1, ends[-1]).astype(np.int64)
    data = pa.py_buffer(np.ascontiguousarray(raw[kept]))
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), data]).dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64), np.searchsorted(at, off)


class Pool:
    """Growing array of fixed item type; add() returns where the new items start."""

    def __init__(self, kind) -> None:
        self.items, self.n = np.zeros(1 << 12, kind), 0

    def add(self, new: np.ndarray) -> int:
        at, self.n = self.n, self.n + len(new)
        if self.n > len(self.items):
            self.items = np.concatenate([self.items[:at], np.zeros(max(len(self.items), len(new)) + at, self.items.dtype)])
        self.items[at : self.n] = new
        return at
