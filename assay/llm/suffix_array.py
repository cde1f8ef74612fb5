"""Suffix arrays by induced sorting, and permuted longest common prefixes, in numpy.

Induced-sorting scans over small alphabets go bucket by bucket: all suffixes that
a bucket induces are placed by one vectorised step (two or more for runs of one
character).  Reduced strings have large alphabets and buckets of a few suffixes
each; their scans go suffix by suffix.  Both are linear in the text.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are scanned by buckets, larger ones by suffixes.
BUCKETS = 2048


def types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S), False where it is larger (L)."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    run = np.zeros(n, np.int64)
    run[change + 1] = 1
    run = np.cumsum(run)
    kind = np.zeros(int(run[-1]) + 1, bool)
    kind[: len(change)] = t[change] < t[change + 1]
    return kind[run]


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """Suffixes in the order that follows from the order of ``lms`` (leftmost-smaller ones)."""
    n = len(t)
    count = np.bincount(t, minlength=k)
    end = np.cumsum(count)
    start = end - count
    sa = np.empty(n, np.int64)
    c = t[lms]
    order = np.argsort(c, kind="stable")
    mine, n_lms = lms[order], np.bincount(c, minlength=k)
    lms_end = np.cumsum(n_lms)
    head, tail = start.copy(), end.copy()

    def put(seq: np.ndarray, small: bool) -> None:
        p = seq[seq > 0] - 1
        p = p[s[p] == small]
        if not len(p):
            return
        ch = t[p]
        o = np.argsort(ch, kind="stable")
        p, ch = p[o], ch[o]
        first = np.concatenate([[0], np.flatnonzero(ch[1:] != ch[:-1]) + 1])
        size = np.diff(np.append(first, len(ch)))
        within = np.arange(len(ch)) - np.repeat(first, size)
        which = ch[first]
        if small:
            sa[tail[ch] - 1 - within] = p
            tail[which] -= size
        else:
            sa[head[ch] + within] = p
            head[which] += size

    put(np.array([n]), False)
    some = np.flatnonzero(count)
    for b in some.tolist():
        lo = start[b]
        while lo < head[b]:
            hi = head[b]
            put(sa[lo:hi], False)
            lo = hi
        if n_lms[b]:
            put(mine[lms_end[b] - n_lms[b] : lms_end[b]], False)
    for b in some[::-1].tolist():
        hi = end[b]
        while tail[b] < hi:
            lo = tail[b]
            put(sa[lo:hi][::-1], True)
            hi = lo
        if head[b] > start[b]:
            put(sa[start[b] : head[b]][::-1], True)
    return sa


def _induce_singly(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """``_induce`` for alphabets of many small buckets."""
    n = len(t)
    end = np.cumsum(np.bincount(t, minlength=k))
    start = end - np.bincount(t, minlength=k)
    # leftmost-smaller suffixes stand at the ends of their buckets, in order
    at = np.full(n, -1, np.int64)
    c = t[lms]
    order = np.argsort(c, kind="stable")
    first = np.concatenate([[0], np.flatnonzero(np.diff(c[order])) + 1]) if len(lms) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(lms)))
    within = np.arange(len(lms)) - np.repeat(first, size)
    at[end[c[order]] - np.repeat(size, size) + within] = lms[order]
    sa, head, text = at.tolist(), start.tolist(), t.tolist()
    larger = [-1, *np.where(~s, np.arange(n), -1).tolist()]  # of position i: i - 1, if that is a larger one
    j = larger[n]
    if j >= 0:
        sa[head[text[j]]] = j
        head[text[j]] += 1
    for i in sa:  # the list grows ahead of the scan, never behind it
        if i > 0:
            j = larger[i]
            if j >= 0:
                b = text[j]
                sa[head[b]] = j
                head[b] += 1
    smaller = [-1, *np.where(s, np.arange(n), -1).tolist()]
    tail = end.tolist()
    for x in range(n - 1, -1, -1):
        i = sa[x]
        if i > 0:
            j = smaller[i]
            if j >= 0:
                b = text[j]
                tail[b] -= 1
                sa[tail[b]] = j
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray, k: int = 256) -> np.ndarray:
    """Starts of the suffixes of ``t`` (numbers below ``k``) in lexicographic order; an end is smaller than any number."""
    n = len(t)
    if n <= 1:
        return np.arange(n)
    s = types(t)
    induce = _induce if k <= BUCKETS else _induce_singly
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(lms):
        sa = induce(t, s, lms, k)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        found = sa[is_lms[sa]]  # leftmost-smaller substrings in order
        stop = np.append(lms[1:], n - 1)
        length = np.zeros(n, np.int64)
        length[lms] = stop - lms
        a, b = found[:-1], found[1:]
        same = (length[a] == length[b]) & (a != lms[-1]) & (b != lms[-1])  # the last one ends with the text
        left = np.flatnonzero(same)
        j = 0
        while len(left):
            left = left[j <= length[a[left]]]
            differs = t[a[left] + j] != t[b[left] + j]
            same[left[differs]] = False
            left = left[~differs]
            j += 1
        name = np.concatenate([[0], np.cumsum(~same)])
        place = np.empty(n, np.int64)
        place[found] = name
        reduced = place[lms]
        if name[-1] + 1 == len(lms):
            order = found
        else:
            kind = np.uint16 if name[-1] < 1 << 16 else np.int64
            order = lms[suffix_array(reduced.astype(kind), int(name[-1]) + 1)]
    else:
        order = lms
    return induce(t, s, order, k)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length of the prefix that its suffix shares with the
    suffix before it in order, and where that suffix starts (-1: none).

    Only where the bytes before differ are prefixes compared; elsewhere the value
    is one less than at the position before."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    plain = np.ones(n, bool)
    i = np.flatnonzero(before[1:] > 0) + 1
    plain[i] = t[i - 1] != t[before[i] - 1]
    at = np.flatnonzero(plain & (before >= 0))
    lcp = np.zeros(n, np.int64)
    padded = np.concatenate([t.astype(np.uint8), np.zeros(8, np.uint8)])
    word = np.ndarray((n + 1,), "<u8", padded.tobytes(), 0, (1,))
    size = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):  # eight bytes at a time
        x, y = at[live] + size[live], before[at[live]] + size[live]
        ok = np.maximum(x, y) + 8 <= n
        ok[ok] = word[x[ok]] == word[y[ok]]
        live = live[ok]
        size[live] += 8
    live = np.arange(len(at))
    while len(live):
        x, y = at[live] + size[live], before[at[live]] + size[live]
        ok = np.maximum(x, y) < n
        ok[ok] = t[x[ok]] == t[y[ok]]
        live = live[ok]
        size[live] += 1
    lcp[at] = size
    last = np.maximum.accumulate(np.where(plain, np.arange(n), 0))
    return np.maximum(0, lcp[last] - (np.arange(n) - last)), before
