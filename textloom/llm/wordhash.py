"""Words of Arrow string columns as 64-bit hashes, without making Python strings.

A word is a maximal run of bytes other than space and \\x09-\\x0D; A-Z counts as a-z. The hash of a word is a
polynomial over its bytes modulo 2**64, taken from running sums over the whole buffer, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
PIECE = 1 << 17  # bytes whose words are hashed at once: their sums stay in a core's cache
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(256, dtype=_U) + _U(77))
_BYTE[65:91] = _BYTE[97:123]
_powers: list = []


def _power(n: int):
    if not _powers or len(_powers[0]) < n:
        m = max(n, CHUNK + 1)
        out = []
        for base in (_BASE, _INVERSE):
            x = np.empty(m, _U)
            x[0] = 1
            size = 1
            step = base
            while size < m:  # doubling
                k = min(size, m - size)
                x[size : size + k] = x[:k] * _U(step)
                size += k
                step = step * step % (1 << 64)
            out.append(x)
        _powers[:] = out
    return _powers


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(col, most: int | None = None):
    """(first row, end row, bytes, offsets) pieces of about `most` or CHUNK bytes; a longer text is a piece of its own."""
    most = most or CHUNK
    data, off = buffers(col)
    n, at = len(off) - 1, 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def spans(data: np.ndarray, off: np.ndarray):
    """Byte starts and ends of all words, and how many words come before each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    first = off[:-1][off[:-1] < len(data)]
    start[first] = solid[first]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | start[1:]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, _U)
    power, inverse = _power(len(data) + 1)
    sums = np.empty(len(data) + 1, _U)
    sums[0] = 0
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))


def words(col):
    """(first row, end row, word hashes, words before each row) for each piece of a column."""
    for a, b, data, off in chunks(col, min(CHUNK, PIECE)):
        s, e, n = spans(data, off)
        yield a, b, hashes(data, s, e), n


def _windows(h: np.ndarray, size: int) -> np.ndarray:
    out = np.full(len(h) - size + 1, size, _U)
    for j in range(size):
        out *= _U(0xD6E8FEB86659FD93)
        out += h[j : len(h) - size + 1 + j]
        out = mix(out)
    return out


def _distinct(s: np.ndarray) -> np.ndarray:
    """The distinct values of an array of one or more, sorted; it is sorted in place."""
    s.sort()
    new = np.empty(len(s), bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s if new.all() else s[new]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of k consecutive words, sorted; fewer words make one shingle of them all, none make none."""
    return _distinct(_windows(h, min(len(h), k))) if len(h) else h


def row_shingles(h: np.ndarray, n: np.ndarray, k: int):
    """The shingles of each row of a piece, where n words come before it. All are hashed at once; those that cross the end
    of a row are left out."""
    out = _windows(h, k) if len(h) >= k else h[:0]
    for a, b in zip(n[:-1].tolist(), n[1:].tolist(), strict=True):
        yield _distinct(out[a : b - k + 1].copy()) if b - a >= k else shingles(h[a:b], k)
