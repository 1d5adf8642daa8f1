"""Suffix arrays by induced sorting, and permuted longest common prefixes, in numpy.

Suffixes are classified as smaller or larger than their right neighbour; the
leftmost-smaller (LMS) suffixes are sorted through their substrings, and both
induction passes follow from them.  The passes go bucket by bucket, each
bucket's stretches as whole arrays.  The string of substring names is sorted by
the same function while its buckets are large enough for that; a string of
mostly different names is sorted by doubling its ranks.
"""

from __future__ import annotations

import numpy as np

from pedshade.llm.common import load64

#: Mean bucket size below which names are sorted by rank doubling.
SMALL_BUCKETS = 64


def _smaller(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their right neighbour; the last counts as such."""
    n = len(t)
    d = t[1:].astype(np.int64) - t[:-1]
    at = np.where(d != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    inside = at < n
    out[:-1][inside] = d[at[inside]] > 0
    return out


def _deal(order: np.ndarray, symbols: np.ndarray, fill: np.ndarray, sa: np.ndarray, step: int) -> None:
    """Appends ``order`` to its symbols' buckets, each at ``fill`` and on by ``step``."""
    by = np.argsort(symbols, kind="stable")
    s = symbols[by]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(start, len(s)))
    nth = np.arange(len(s)) - np.repeat(start, size)
    bucket = s[start].astype(np.int64)
    base = np.repeat(fill[bucket], size)
    sa[base + nth if step > 0 else base - 1 - nth] = order[by]
    fill[bucket] += step * size


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The suffix array that follows from LMS suffixes in the order given."""
    n = len(t)
    sa = np.full(n, -1, np.int32 if n < 2**31 else np.int64)
    first = t[lms]
    count = np.bincount(first, minlength=len(heads))
    _deal(lms, first, low := tails - count, sa, 1)
    low -= count
    larger_end = heads.copy()
    full = np.flatnonzero(tails > heads)

    def spread(block: np.ndarray, want_smaller: bool, fill: np.ndarray, step: int) -> None:
        j = block[block > 0] - 1
        j = j[smaller[j] == want_smaller]
        if len(j):
            _deal(j, t[j], fill, sa, step)

    for c in full.tolist():
        done = heads[c]
        while done < larger_end[c]:
            block = sa[done : larger_end[c]]
            done = larger_end[c]
            spread(block, False, larger_end, 1)
        if count[c]:
            spread(sa[low[c] : tails[c]], False, larger_end, 1)
    smaller_start = tails.copy()
    smaller_start[t[n - 1]] -= 1  # the sentinel is induced by nothing
    sa[tails[t[n - 1]] - 1] = n - 1
    for c in full[::-1].tolist():
        done = tails[c]
        while done > smaller_start[c]:
            block = sa[smaller_start[c] : done][::-1]
            done = smaller_start[c]
            spread(block, True, smaller_start, -1)
        if larger_end[c] > heads[c]:
            spread(sa[heads[c] : larger_end[c]][::-1], True, smaller_start, -1)
    return sa


def _names(t: np.ndarray, order: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names, ascending along ``order``, of the LMS substrings; equal ones share theirs."""
    n = len(t)
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    open_ = np.flatnonzero(same)
    depth = 0
    while len(open_):
        differs = t[a[open_] + depth] != t[b[open_] + depth]
        same[open_[differs]] = False
        depth += 1
        open_ = open_[~differs]
        open_ = open_[length[a[open_]] > depth]
    return np.concatenate([[0], np.cumsum(~same)])


def _by_doubling(t: np.ndarray) -> np.ndarray:
    n, width = len(t), 1
    rank = t.astype(np.int64)
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - width)] = rank[width:] + 1
        key = rank * (rank.max() + 2) + ahead
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        width *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of symbols; the last must be the only smallest one."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = _smaller(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sizes = np.bincount(t)
    tails = np.cumsum(sizes)
    heads = tails - sizes
    if len(lms) > 1:
        guess = _induce(t, smaller, lms, heads, tails)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = guess[is_lms[guess]]
        names = _names(t, order, lms)
        if names[-1] + 1 < len(lms):
            at = np.empty(n, np.int64)
            at[order] = names
            reduced = at[lms]
            few = names[-1] * SMALL_BUCKETS < len(lms)
            sub = suffix_array(reduced.astype(np.uint16 if names[-1] < 65_536 else np.int64)) if few else _by_doubling(reduced)
            order = lms[sub]
        lms = order
    return _induce(t, smaller, lms, heads, tails)


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of ``text`` (bytes) the common prefix with the suffix before it in order.

    Only irreducible values, where the bytes before differ, are compared; each
    of the others is one less than its left neighbour's.  ``sa`` is of the text
    and a sentinel behind it.
    """
    n = len(text)
    before = np.full(n + 1, n, np.int64)
    before[sa[1:]] = sa[:-1]
    before = before[:n]
    i = np.arange(n)
    prior = np.where(before > 0, before, 1) - 1
    irreducible = (i == 0) | (before == 0) | (before == n) | (text[np.maximum(i - 1, 0)] != text[np.minimum(prior, n - 1)])
    at = np.flatnonzero(irreducible)
    # 8 bytes at a time; the padding after the text differs from the text itself only
    # in length, so a common prefix is cut where the later place reaches the end.
    loads = load64(np.concatenate([text, np.zeros(16, np.uint8)]))
    a, b = at, before[at]
    most = n - np.maximum(a, b)
    common = np.zeros(len(at), np.int64)
    open_ = np.flatnonzero(most > 0)
    while len(open_):
        x = loads[a[open_] + common[open_]] ^ loads[b[open_] + common[open_]]
        equal = np.where(x == 0, 8, np.bitwise_count(~x & (x - np.uint64(1))).astype(np.int64) >> 3)
        common[open_] += equal
        open_ = open_[(equal == 8) & (common[open_] < most[open_])]
    common = np.minimum(common, most)
    last = np.maximum.accumulate(np.where(irreducible, i, 0))
    start = np.zeros(n, np.int64)
    start[at] = common
    return start[last] - (i - last)
