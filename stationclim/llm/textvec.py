"""Words and word hashes of a whole batch of texts in numpy.

A byte table maps each byte to its normalised form, or to 0 where it
separates words, so that splitting, case folding and hashing need no
Python object per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_B = np.uint64(0x9E3779B97F4A7C15)          # odd, so that it has an inverse modulo 2^64
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def space_table() -> np.ndarray:
    """Words are runs of bytes outside 0x20 and 0x09-0x0D, as they are."""
    t = np.arange(256, dtype=np.uint8)
    t[[0x20, *range(0x09, 0x0E)]] = 0
    t[0] = 0xFF  # a NUL byte belongs to a word; 0xFF never occurs in UTF-8
    return t


def alnum_table() -> np.ndarray:
    """Words are runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII characters."""
    t = np.arange(256, dtype=np.uint8)
    t[ord("A"):ord("Z") + 1] += 32
    t[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if _POW.size < n:
        size = max(n, 2 * _POW.size)
        up, down = np.full(size, _B), np.full(size, _B_INV)
        up[0] = down[0] = 1
        _POW, _INV = np.cumprod(up), np.cumprod(down)
    return _POW, _INV


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the offsets of the rows; null is empty."""
    a = pc.fill_null(texts, "").cast(pa.large_string())
    bufs = a.buffers()
    off = np.frombuffer(bufs[1], np.int64)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def split_words(data: np.ndarray, off: np.ndarray, table: np.ndarray):
    """(normalised bytes, word starts, word ends, row of each word)."""
    m = table[data]
    isw = m != 0
    edge = np.zeros(data.size + 1, bool)
    edge[off] = True  # a row's first byte never continues the row before
    start = isw.copy()
    if data.size:
        start[1:] &= ~isw[:-1] | edge[1:-1]
        end = isw.copy()
        end[:-1] &= ~isw[1:] | edge[1:-1]
    else:
        end = isw
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return m, s, e, np.searchsorted(off, s, "right") - 1


def hash_words(m: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    up, down = _powers(m.size + 1)
    total = np.zeros(m.size + 1, np.uint64)
    np.cumsum(m.astype(np.uint64) * up[:m.size], out=total[1:])
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words; a text of fewer words, but not none, is one shingle."""
    count = np.bincount(row, minlength=n_rows)
    k = h.size
    if k == 0:
        return h, row
    acc = np.zeros(max(k - size + 1, 0), np.uint64)
    for j in range(size):
        acc = mix(acc + h[j:k - size + 1 + j]) if acc.size else acc
    ok = row[:acc.size] == row[size - 1:] if acc.size else np.zeros(0, bool)
    out_h, out_r = acc[ok], row[:acc.size][ok]
    small = np.flatnonzero((count > 0) & (count < size))
    if small.size:
        first = np.concatenate([[0], np.cumsum(count)])
        extra = np.zeros(small.size, np.uint64)
        for j in range(size - 1):
            has = count[small] > j
            extra[has] = mix(extra[has] + h[first[small[has]] + j])
        out_h = np.concatenate([out_h, mix(extra + count[small].astype(np.uint64))])
        out_r = np.concatenate([out_r, small])
    return out_h, out_r


def multiset(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, element) with counts, sorted by row.  Elements keep 43 bits of their hash."""
    key = np.sort((row.astype(np.uint64) << np.uint64(43)) | (h >> np.uint64(21)))
    if not key.size:
        return key, row, row
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.concatenate([first, [key.size]]))
    key = key[first]
    return key & np.uint64((1 << 43) - 1), (key >> np.uint64(43)).astype(np.int64), count
