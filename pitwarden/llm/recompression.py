"""Recompression: a run-length grammar of a sequence, and longest common extensions answered on it.

Blocks of equal symbols and pairs of unequal ones are replaced in turn until one symbol is left. Which symbols are
joined depends on the symbols alone, so equal stretches are cut alike except near their ends. A longest common extension
therefore climbs the levels while both positions stand at the start of a symbol and descends again from the first
difference, with one comparison a level. Every step handles all queries at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Level:
    """Symbols of one level and how they are grouped into those of the next; every array has one place for the end."""

    symbol: np.ndarray  # -1 at the end
    head: np.ndarray  # first of its group
    rest: np.ndarray  # symbols to the end of the block; 1 where pairs are joined
    up: np.ndarray  # index of its group in the next level
    first: np.ndarray  # index of the first symbol of each group of the next level
    blocks: bool


def _renamed(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def _level(symbol: np.ndarray, first: np.ndarray, blocks: bool) -> Level:
    n = len(symbol)
    head = np.zeros(n + 1, bool)
    head[first] = True
    head[n] = True
    ends = np.r_[first[1:], n]
    rest = np.repeat(ends, ends - first) - np.arange(n) if blocks else np.ones(n, np.int64)
    return Level(np.r_[symbol, -1], head, np.r_[rest, 0], np.cumsum(head) - 1, np.r_[first, n], blocks)


def grammar(symbol: np.ndarray) -> list[Level]:
    """Levels over ``symbol`` (non-negative integers), blocks first; the last one has a single symbol or none."""
    levels: list[Level] = []
    symbol = _renamed(np.asarray(symbol, np.int64))
    blocks = True
    while len(symbol) > 1:
        if blocks:
            first = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
            following = symbol[first] * (len(symbol) + 1) + np.diff(np.r_[first, len(symbol)])
        else:
            names = int(symbol.max()) + 1
            left = np.random.default_rng(len(levels)).integers(0, 2, names).astype(bool)[symbol]
            joined, other = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
            if other.sum() > joined.sum():
                joined = other
            first = np.flatnonzero(np.r_[True, ~joined])
            following = symbol[first]
            pair = np.flatnonzero(joined)
            following[np.searchsorted(first, pair)] = (symbol[pair] + 1) * names + symbol[pair + 1]
        levels.append(_level(symbol, first, blocks))
        symbol = _renamed(following)
        blocks = not blocks
    levels.append(_level(symbol, np.arange(len(symbol)), True))
    return levels


def common_extension(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest equal stretches that start at i and at j, for each i < j (j may be the end)."""
    a, b = i.astype(np.int64), j.astype(np.int64)
    at = np.zeros(len(a), np.int64)  # level of the first difference
    live = np.arange(len(a))
    for k, level in enumerate(levels):
        x, y = a[live], b[live]
        same = level.symbol[x] == level.symbol[y]
        at[live[~same]] = k
        live, x, y = live[same], x[same], y[same]
        if not len(live):
            break
        inside = ~(level.head[x] & level.head[y])
        least = np.minimum(level.rest[x], level.rest[y])
        uneven = inside & (level.rest[x] != level.rest[y])
        step = np.where(inside, least, 0)
        a[live], b[live] = x + step, y + step
        at[live[uneven]] = k
        live = live[~uneven]
        a[live], b[live] = level.up[a[live]], level.up[b[live]]
    for k in range(int(at.max(initial=0)), 0, -1):
        below = levels[k - 1]
        down = np.flatnonzero(at >= k)
        x, y = below.first[a[down]], below.first[b[down]]
        step = np.where(below.symbol[x] == below.symbol[y], np.minimum(below.rest[x], below.rest[y]), 0)
        a[down], b[down] = x + step, y + step
    return a - i
