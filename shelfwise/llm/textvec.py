"""Whole-column text scans in numpy: words, word hashes and n-gram hashes of an Arrow
batch, without a Python object per word.

A batch is cut into chunks of whole documents of about ``CHUNK_BYTES`` (or as asked) so that
memory is bounded by a chunk (or by one longer document), whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
SMALL_BYTES = 1 << 18    # where many arrays of a word's or a byte's width live at once

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GRAM = _U(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""
    global _pow, _inv
    while len(_pow) < n:
        k = len(_pow)
        _pow = np.concatenate([_pow, _pow * _U(pow(_BASE, k, 1 << 64))])
        _inv = np.concatenate([_inv, _inv * _U(pow(_BASE_INV, k, 1 << 64))])
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def as_array(col) -> pa.Array:
    """One contiguous large_string array; null texts become empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    return pc.fill_null(col.cast(pa.large_string()), "")


def chunks(col, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents; the offsets have
    one entry more than there are rows and start at 0."""
    arr = as_array(col)
    n = len(arr)
    if not n:
        return
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, np.int64)[arr.offset:arr.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + size, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b, raw[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b


class Words:
    """Words of one chunk: byte bounds, document index, 64-bit hash; ``first`` has the
    index of each document's first word (one entry more than documents)."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, lower: bool = False,
                 table: np.ndarray = WORD, hashes: bool = True):
        n = len(raw)
        self.raw = LOWER[raw] if lower else raw
        inside = table[self.raw]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        shifted = np.zeros(n + 1, bool)
        shifted[1:] = inside
        self.start = np.flatnonzero(inside & (~shifted[:n] | edge[:n]))
        shifted[:n] = inside
        shifted[n] = False
        self.end = np.flatnonzero(inside & (~shifted[1:] | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offs, "left")
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))
        if hashes:
            power, inverse = _powers(n + 1)
            run = np.zeros(n + 1, np.uint64)
            np.cumsum((self.raw.astype(np.uint64) + _U(1)) * power[:n], out=run[1:])
            self.hash = mix((run[self.end] - run[self.start]) * inverse[self.start])

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive entries of h (ignoring document ends)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    m = len(h) - k + 1
    out = h[:m].copy()
    for j in range(1, k):
        out = out * _GRAM + h[j:j + m]
    return mix(out + _U(k))


def whole(h: np.ndarray) -> np.uint64:
    """Hash of one whole sequence, equal to ``grams(h, len(h))[0]``."""
    return grams(h, len(h))[0]


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated arange(start, start + len)."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)
    return np.arange(total) + shift
