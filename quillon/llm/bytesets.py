"""Vectorised work on batches of UTF-8 texts: Arrow buffers in, numpy arrays out, no Python object per text or word.

A block is a few whole texts: ``off`` (int64, n + 1 bounds) into ``data`` (uint8).  Null texts count as empty.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, as in ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one longer text is a block of its own.
BLOCK = 2_000_000

U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_rng = np.random.default_rng(20240607)
#: An odd number for each byte.
TABLE = _rng.integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = _rng.integers(0, 1 << 63, 64, dtype=U) * U(2) + U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse below n, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if n > 4 * BLOCK:  # of one very long text: not kept
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums S with S[j] - S[i] = sum of TABLE[byte] * base^position over [i, j)."""
    s = np.zeros(len(data) + 1, U)
    t = TABLE[data]
    t *= powers(len(data) + 1)[0][: len(data)]
    np.cumsum(t, out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, whatever their position."""
    h = s[end] - s[start]
    h *= powers(len(s))[1][start]
    h += (end - start).astype(U) * U(0xC2B2AE3D27D4EB4F)
    return mix(h)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(off, data) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with whole texts of at most ``most`` bytes together, at least one text each."""
    off, data = buffers(batch.column(column))
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), off[i : j + 1] - off[i], data[off[i] : off[j]]
        i = j


def owner(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The index of the text in which each byte position lies (sorted or not)."""
    return np.searchsorted(off, at, "right") - 1


def words(off: np.ndarray, data: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of every word; ``space`` marks the bytes that part words."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~space[data]
    before = np.empty(n + 1, bool)
    before[0] = before[n] = False
    before[1:] = inside
    cut = off[(off > 0) & (off < n)]
    first = inside.copy()
    first &= ~before[:n]
    first[cut] = inside[cut]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    end = np.flatnonzero(last) + 1
    return start, end, owner(off, start)


#: Bytes other than ASCII letters and digits and the parts of wider characters.
PUNCTUATION = np.array([not (chr(b).isalnum() or b >= 0x80) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def folded(data: np.ndarray) -> np.ndarray:
    """A copy in lower case, as far as U+00DE."""
    low = _LOWER[data]
    wide = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    low[wide] += 32
    return low


def word_hashes(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every word."""
    start, end, doc = words(off, data)
    return span_hash(prefix(data), start, end), doc


def shingles(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every run of n words of one text; a text of 1 to n - 1 words has one shingle, all its words."""
    if not len(h):
        return h, doc
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    count = np.diff(np.r_[first, len(doc)])
    at = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1]) if len(doc) >= n else np.zeros(0, np.int64)
    s = np.zeros(len(at), U)
    for k in range(n):
        s += h[at + k] * _STEP[k]
    short = count < n
    if short.any():
        f, c = first[short], count[short]
        t = c.astype(U) * _STEP[63]
        for k in range(n - 1):
            has = c > k
            t[has] += h[f[has] + k] * _STEP[k]
        at, s = np.r_[at, f], np.r_[s, t]
        order = np.argsort(at, kind="stable")
        at, s = at[order], s[order]
    return mix(s), doc[at]


def per_text(n: int, doc: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Counts (or sums of whole numbers) per text."""
    return np.bincount(doc, weight, n).astype(np.int64)
