"""Vectorised word kernels over Arrow batches.

Words are maximal runs of bytes outside space and 0x09-0x0D. Their 64-bit hashes come from one prefix sum over
the bytes (polynomial over a random byte table modulo 2**64, then mixed), so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of text that one kernel call works on, unless a single text is longer.
BLOCK = 1 << 20
_U = np.uint64
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE, _GRAM, _GRAM2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        out = np.full(max(n, BLOCK + 64), base, np.uint64)
        out[0] = 1
        _powers[int(base)] = have = np.multiply.accumulate(out)
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return _U(pow(int(base), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xFF51AFD7ED558CCD)
    return h ^ (h >> _U(32))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the offset of each (one more at the end). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes in all, one text at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    gap = space[data]
    word = ~gap
    first, last = word.copy(), word.copy()
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    lo, hi = offs[:-1], offs[1:]
    full = lo < hi
    first[lo[full]] = word[lo[full]]
    last[hi[full] - 1] = word[hi[full] - 1]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, offs)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    n = len(data)
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(_BASE, n), out=pre[1:])
    return mix((pre[e] - pre[s]) * powers(inverse(_BASE), n + 1)[s] + (e - s).astype(np.uint64))


def gram_hashes(h: np.ndarray, n: int, base: np.uint64 = _GRAM) -> np.ndarray:
    """Hash of h[i:i+n] for every i with n items after it."""
    m = len(h)
    if m < n:
        return np.zeros(0, np.uint64)
    pre = np.zeros(m + 1, np.uint64)
    np.cumsum(h * powers(base, m), out=pre[1:])
    return mix((pre[n:] - pre[:-n]) * powers(inverse(base), m + 1)[: m - n + 1])


def gram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Indices of words at which a window of n words starts that lies in one text. first: as from word_bounds."""
    m = int(first[-1])
    if m < n:
        return np.zeros(0, np.int64)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(m)
    return np.flatnonzero(left >= n)


def covered(starts: np.ndarray, n: int, m: int) -> np.ndarray:
    """Which of m words lie in a window of n words at one of starts."""
    d = np.bincount(starts, minlength=m + 1) - np.bincount(starts + n, minlength=m + 1)
    return np.cumsum(d[:m]) > 0


def per_text(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of values[offs[i]:offs[i+1]] for each i."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]
