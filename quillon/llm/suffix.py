"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(symbol: np.ndarray, text: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sa, rank) of all suffixes of a block of texts; ``text`` (ascending) has the text of each position.

    Suffixes end with their text and are sorted by text first, so no match crosses texts.  The order of symbols is that
    of their numbers.  As in Larsson and Sadakane's refinement, each round doubles the depth and sorts only groups that
    are still tied, by the ranks that the last round left; with ``depth`` it stops once ties are as long as that.
    Equal ranks remain only for suffixes tied at that depth.
    """
    n = len(symbol)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((symbol, text))
    s, t = symbol[order], text[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (t[1:] != t[:-1])]
    sa, rank, _ = _refined(order, new, np.searchsorted(text, text, "right"), 1, depth, None)
    return sa, rank


def _refined(sa: np.ndarray, new: np.ndarray, end: np.ndarray, h: int, depth: int | None, watch: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Refines suffixes sorted by h symbols, ``new`` where a group begins; also the slots still tied at depth ``watch``."""
    n = len(sa)
    rank = np.empty(n, np.int64)
    heads = np.flatnonzero(new)
    size = np.diff(np.r_[heads, n])
    rank[sa] = np.repeat(heads, size)
    slots = np.flatnonzero(np.repeat(size > 1, size))
    watched = None
    while len(slots) and (depth is None or h < depth):
        if watched is None and watch is not None and 2 * h > watch:
            watched = slots, rank[sa[slots]]
        at = sa[slots]
        nxt = at + h
        inside = nxt < end[at]
        nxt[~inside] = 0
        key = rank[nxt]
        key += 1
        key[~inside] = 0
        key += rank[at] * (n + 1)
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[slots] = at
        new = np.r_[True, key[1:] != key[:-1]]
        heads = np.flatnonzero(new)
        size = np.diff(np.r_[heads, len(slots)])
        rank[at] = np.repeat(slots[heads], size)
        slots = slots[np.repeat(size > 1, size) & inside[order]]  # what ends within the depth is equal for good
        h *= 2
    # Equal suffixes (of several texts) stand in the order of their positions, on which Kasai's rule relies.
    r = rank[sa]
    equal = np.r_[False, r[1:] == r[:-1]] if n else np.zeros(0, bool)
    equal[:-1] |= equal[1:]
    at = np.flatnonzero(equal)
    sa[at] = sa[at][np.lexsort((sa[at], r[at]))]
    tied = np.zeros(n, bool)
    if watched is not None:
        at, group = watched
        tied[at[1:]] = group[1:] == group[:-1]
    return sa, rank, tied


def byte_suffix_array(off: np.ndarray, data: np.ndarray, watch: int) -> tuple[np.ndarray, np.ndarray]:
    """(sa, tied) of the suffixes of all texts together, each ending with its text.

    The first round sorts by as many bytes as fit into 63 bits.  tied[k]: sa[k - 1] and sa[k] may share ``watch`` bytes.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    symbol = np.zeros(256, np.int64)
    symbol[used] = np.arange(1, len(used) + 1)
    bits = int(len(used)).bit_length()
    width = min(63 // bits, watch)
    code = symbol[data]
    end = np.repeat(off[1:], np.diff(off))
    left = end - np.arange(n)
    key = code.copy()
    for i in range(1, width):
        key <<= bits
        if i < n:
            key[: n - i] += np.where(left[: n - i] > i, code[i:], 0)
    sa = np.argsort(key)
    key = key[sa]
    sa, _, tied = _refined(sa, np.r_[True, key[1:] != key[:-1]], end, width, None, watch)
    return sa, tied


def common_prefixes(symbol: np.ndarray, text: np.ndarray, sa: np.ndarray, tied: np.ndarray | None = None) -> np.ndarray:
    """lcp[k]: the common prefix of the suffixes sa[k - 1] and sa[k] (0 at 0).

    Without ``tied`` it is 0 between texts; with it, texts are compared with each other, but only where tied[k].

    Kasai's rule, in its permuted form: if the symbols before two neighbours agree, the prefix is one less than that of
    the position before.  Only the other positions are compared, all at once; the rest follow by a running maximum.
    """
    n = len(symbol)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = np.where(text[sa[1:]] == text[sa[:-1]] if tied is None else tied[1:], sa[:-1], -1)
    i = np.arange(n)
    follows = np.zeros(n, bool)
    j = before[1:]
    ok = (j > 0) & (text[1:] == text[:-1])
    jj = np.where(ok, j, 1)
    follows[1:] = ok & (text[jj] == text[jj - 1]) & (symbol[:-1] == symbol[jj - 1])
    heads = np.flatnonzero(~follows)
    known = np.zeros(n, np.int64)
    a, b, at = heads, before[heads], heads
    alive = b >= 0
    a, b, at = a[alive], b[alive], at[alive]
    end = np.searchsorted(text, text[a], "right") if len(a) else a
    stop = np.searchsorted(text, text[b], "right") if len(b) else b
    length = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    if symbol.dtype == np.uint8:  # eight at a time, as far as that goes
        eight = np.ndarray(n, "<u8", np.r_[symbol, np.zeros(8, np.uint8)].tobytes(), 0, (1,))
        while len(live):
            x, y = a[live] + length[live], b[live] + length[live]
            fits = (x + 8 <= end[live]) & (y + 8 <= stop[live])
            live, x, y = live[fits], x[fits], y[fits]
            live = live[eight[x] == eight[y]]
            length[live] += 8
        live = np.arange(len(a))
    while len(live):
        x, y = a[live] + length[live], b[live] + length[live]
        fits = (x < end[live]) & (y < stop[live])
        live, x, y = live[fits], x[fits], y[fits]
        same = symbol[x] == symbol[y]
        live = live[same]
        length[live] += 1
    known[at] = length
    total = np.where(follows, 0, known + i)
    head = np.maximum.accumulate(np.where(follows, 0, i))
    plcp = total[head] - i
    lcp[1:] = np.where(before[sa[1:]] >= 0, plcp[sa[1:]], 0)
    return lcp
