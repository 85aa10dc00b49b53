"""Suffix array by induced sorting, and permuted common prefixes, for one shard of bytes.

Suffixes are classed as smaller (S) or larger (L) than their successor; the leftmost S suffixes are put in order by
their substrings (recursively, where substrings repeat), and all others are induced from them bucket by bucket. For an
alphabet that is small beside the text a whole bucket is induced at once with array operations; the reduced texts of the
recursion, whose alphabet is large, take the same steps one by one.
"""

from __future__ import annotations

import numpy as np


def _classes(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last symbol is the unique smallest one."""
    n = len(t)
    differs = t[1:] != t[:-1]
    at = np.where(differs, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return np.append((t[:-1] < t[1:])[nearest], True)


def _group_ranks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank within its run, first of each run, run lengths) of sorted symbols."""
    first = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
    count = np.diff(np.append(first, len(symbols)))
    return np.arange(len(symbols)) - np.repeat(first, count), first, count


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes, induced from ``lms`` in the given order."""
    n = len(t)
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    larger = np.bincount(t[~s], minlength=size)
    sa = np.full(n, -1, np.int32)
    order = np.argsort(t[lms], kind="stable")
    placed = lms[order]
    symbols = t[placed]
    rank, first, count = _group_ranks(symbols)
    seeds = np.zeros(size, np.int64)
    seeds[symbols[first]] = count
    sa[(ends - seeds)[symbols] + rank] = placed
    present = np.flatnonzero(counts).tolist()

    head = starts.copy()

    def push_larger(batch: np.ndarray) -> None:
        p = batch - 1
        p = p[p >= 0]
        p = p[~s[p]]
        if len(p):
            c = t[p]
            o = np.argsort(c, kind="stable")
            p, c = p[o], c[o]
            rank, first, count = _group_ranks(c)
            sa[head[c] + rank] = p
            head[c[first]] += count

    for c in present:
        done = starts[c]
        while done < head[c]:
            batch, done = sa[done : head[c]], head[c]
            push_larger(batch)
        if seeds[c]:
            push_larger(sa[ends[c] - seeds[c] : ends[c]])

    tail = ends.copy()
    tail[0] = 0  # the last symbol stands already

    def push_smaller(batch: np.ndarray) -> None:
        p = batch - 1
        p = p[p >= 0]
        p = p[s[p]]
        if len(p):
            c = t[p]
            o = np.argsort(c, kind="stable")
            p, c = p[o], c[o]
            rank, first, count = _group_ranks(c)
            sa[tail[c] - 1 - rank] = p
            tail[c[first]] -= count

    for c in present[:0:-1]:
        done = ends[c]
        while done > tail[c]:
            batch, done = sa[tail[c] : done][::-1], tail[c]
            push_smaller(batch)
        if larger[c]:
            push_smaller(sa[starts[c] : starts[c] + larger[c]][::-1])
    return sa


def _equal_neighbours(t: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each substring of a sorted list but the first: equal to the one before."""
    same = length[1:] == length[:-1]
    out = np.zeros(len(same), bool)
    which = np.flatnonzero(same)
    for lo in range(0, len(which), 1 << 16):
        own = which[lo : lo + (1 << 16)]
        n = length[own].astype(np.int64)
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        equal = t[np.repeat(starts[own], n) + step] == t[np.repeat(starts[own + 1], n) + step]
        out[own] = np.logical_and.reduceat(equal, first)
    return out


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of symbols 0..size-1 whose last symbol is 0 and stands nowhere else."""
    if len(t) == 1:
        return np.zeros(1, np.int32)
    if size > max(256, len(t) >> 6):
        return np.array(_by_steps(t.tolist(), size), np.int32)
    s = _classes(t)
    lms = (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(np.int32)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    sa = _induce(t, s, lms, size)
    by_substring = sa[is_lms[sa]]
    at = np.zeros(len(t), np.int32)
    at[lms] = np.append(np.diff(lms) + 1, 1)
    name = np.append(0, np.cumsum(~_equal_neighbours(t, by_substring, at[by_substring])))
    if name[-1] + 1 < len(lms):
        names = np.zeros(len(t), np.int64)
        names[by_substring] = name
        by_substring = lms[suffix_array(names[lms], int(name[-1]) + 1)]
    return _induce(t, s, by_substring, size)


def _by_steps(t: list[int], size: int) -> list[int]:
    """The same construction symbol by symbol."""
    n = len(t)
    if n == 1:
        return [0]
    s = bytearray(n)
    s[n - 1] = 1
    for i in range(n - 2, -1, -1):
        s[i] = t[i] < t[i + 1] or (t[i] == t[i + 1] and s[i + 1])
    counts = [0] * size
    for c in t:
        counts[c] += 1
    starts, ends, total = [0] * size, [0] * size, 0
    for c, k in enumerate(counts):
        starts[c] = total
        total += k
        ends[c] = total
    lms = [i for i in range(1, n) if s[i] and not s[i - 1]]

    def induce(seeds: list[int]) -> list[int]:
        sa = [-1] * n
        tail = ends[:]
        for i in reversed(seeds):
            c = t[i]
            tail[c] -= 1
            sa[tail[c]] = i
        head = starts[:]
        for k in range(n):
            i = sa[k] - 1
            if i >= 0 and not s[i]:
                c = t[i]
                sa[head[c]] = i
                head[c] += 1
        tail = ends[:]
        for k in range(n - 1, -1, -1):
            i = sa[k] - 1
            if i >= 0 and s[i]:
                c = t[i]
                tail[c] -= 1
                sa[tail[c]] = i
        return sa

    sa = induce(lms)
    after = dict(zip(lms, [*lms[1:], n - 1], strict=True))
    names, name, last = {}, -1, None
    for i in sa:
        if i > 0 and s[i] and not s[i - 1]:
            here = t[i : after[i] + 1]
            if here != last:
                name += 1
                last = here
            names[i] = name
    if name + 1 == len(lms):
        order = sorted(lms, key=names.__getitem__)
    else:
        order = [lms[k] for k in _by_steps([names[i] for i in lms], name + 1)]
    return induce(order)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, most: int, border: int = -1) -> np.ndarray:
    """Common prefix of every suffix with its predecessor in the suffix array, in text order, counted up to ``most``.

    Where the symbols before both suffixes agree, the value is one less than that of the suffix before; only the other
    suffixes are compared symbol by symbol. So are those after a ``border`` symbol: a value that was cut off at ``most``
    holds only for the piece it began in.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    reducible = (i > 0) & (before > 0)
    reducible[reducible] = t[i[reducible] - 1] == t[before[reducible] - 1]
    reducible[1:] &= t[:-1] != border
    own = np.flatnonzero(~reducible & (before >= 0))
    step = 32
    padded = np.concatenate([t.astype(np.int32), np.arange(-1, -most - 2 * step, -1, dtype=np.int32)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, step)
    values = np.zeros(n, np.int64)
    for lo in range(0, len(own), 1 << 15):
        a = own[lo : lo + (1 << 15)]
        b = before[a]
        length = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            off = length[live]
            equal = rows[a[live] + off] == rows[b[live] + off]
            full = equal.all(axis=1)
            length[live] += np.where(full, step, equal.argmin(axis=1))
            live = live[full & (length[live] < most)]
        values[a] = np.minimum(length, most)
    source = np.maximum.accumulate(np.where(reducible, 0, i))
    return np.maximum(values[source] - (i - source), 0)
