"""Periodic run detection in word sequences by recompression.

A run is a stretch of words with smallest period q, at least ``times`` periods and ``least`` words long, that no
neighbouring word extends. It holds ``times`` neighbouring points of the grid 0, q, 2q, ..., with equal words on them; so
the grids of all periods (n log n points in all) give every candidate, and the candidates' exact ends are longest common
extensions, to the right on a grammar of the sequence and to the left on one of its reverse (``recompression``). A
stretch found with a multiple of its smallest period has the same ends, so the least period of equal ends is the
smallest one. Texts are handled where they are, without a shuffle.

Defined results: a null or empty text, or one without words, has no runs and an empty collapsed text; repeated rows have
the same runs; texts of any length are handled whole, their grids in pieces of ``GRID`` points; runs that overlap are all
reported; an empty table gives an empty result; a column named like a result column gives way to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pitwarden.llm.common import add_columns
from pitwarden.llm.recompression import common_extension, grammar


@dataclass(frozen=True)
class RunRule:
    least: int = 6  # words
    times: int = 4  # periods


GRID = 1 << 20  # points of the grids looked at together
SMALL = 1 << 15  # words of a text whose grids are kept as a table
_tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _points(n: int, low: int, high: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points (place, period) of the periods low <= q < high that have ``times - 1`` points after them below n."""
    q = np.arange(low, high)
    count = np.maximum(0, (n - 1 - (times - 1) * q) // q + 1)
    period = np.repeat(q, count)
    return (np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)) * period, period


def grids(n: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grid points of all periods of a text of n words, in pieces."""
    if n <= SMALL:
        if times not in _tables:
            place, period = _points(SMALL, 1, SMALL // times + 1, times)
            order = np.argsort(place + (times - 1) * period, kind="stable")
            place, period = place[order].astype(np.int32), period[order].astype(np.int32)
            _tables[times] = place, period, place + (times - 1) * period
        place, period, last = _tables[times]
        upto = int(np.searchsorted(last, n))
        yield place[:upto], period[:upto]
        return
    low = 1
    while low * times <= n:
        high = low + max(1, GRID * low // n)
        yield _points(n, low, min(high, n // times + 1), times)
        low = high


def candidates(symbol: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid points (place, period) that start ``times`` equal words."""
    for place, period in grids(len(symbol), times):
        for k in range(1, times):
            same = symbol[place] == symbol[place + k * period]
            place, period = place[same], period[same]
        if len(place):
            yield place.astype(np.int64), period.astype(np.int64)


def runs(texts: list[np.ndarray], rule: RunRule = RunRule()) -> list[np.ndarray]:
    """Rows (start, length, period) of all runs of each text (word numbers), ordered by start, then period.

    Texts with candidates share a grammar: they stand one behind the other, each closed by a symbol of its own.
    """
    asked: list[tuple[int, np.ndarray, np.ndarray]] = []
    placed: dict[int, int] = {}
    at = 0
    for t, symbol in enumerate(texts):
        for place, period in candidates(symbol, rule.times):
            if t not in placed:
                placed[t] = at
                at += len(symbol) + 1
            asked.append((t, place + placed[t], period))
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    if not asked:
        return out
    names = 1 + max(int(texts[t].max()) for t in placed)
    joined = np.concatenate([np.r_[texts[t], names + t] for t in placed])
    forward, backward = grammar(joined), grammar(joined[::-1])
    found: list[np.ndarray] = []
    for text, place, period in _even(asked):
        right = common_extension(forward, place, place + period)
        left = common_extension(backward, at - place - period, at - place)
        length = left + period + right
        long = (length >= rule.times * period) & (length >= rule.least)
        found.append(np.unique(np.stack([text, place - left, length, period], axis=1)[long], axis=0))
    every = np.unique(np.concatenate(found), axis=0)  # by text, start, length, period
    least = np.ones(len(every), bool)
    least[1:] = (every[1:, :3] != every[:-1, :3]).any(axis=1)
    every = every[least]
    every = every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]
    edges = np.searchsorted(every[:, 0], np.arange(len(texts) + 1))
    for t, start in placed.items():
        out[t] = every[edges[t] : edges[t + 1], 1:] - (start, 0, 0)
    return out


def _even(asked: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same (text, place, period) in arrays of about ``GRID`` / 4 points."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for t, place, period in asked:
        for lo in range(0, len(place), GRID // 4):
            held.append((np.full(len(place[lo : lo + GRID // 4]), t), place[lo : lo + GRID // 4], period[lo : lo + GRID // 4]))
            size += len(held[-1][0])
            if size >= GRID // 4:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def collapse(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(found):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def plant(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document after the test edit: in every tenth (by checksum of the id) a tail that repeats."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _groups(rows: list[tuple], most: int = 1 << 18) -> Iterator[list[tuple]]:
    """Rows (key, words) in groups of at most ``most`` words, or one row."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        if held and size + len(row[1]) > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[1])
    if held:
        yield held


def find_runs(docs: DataFrame, rule: RunRule = RunRule(), text: str = "text", edit: Callable | None = None, key: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` with ``runs`` (start, length, period in words) and the ``collapsed`` text.

    ``edit`` maps (key, words) to the words to look at; without it they are those of ``text``.
    """

    def run(keys, texts):
        out: dict[str, list] = {"runs": [], "collapsed": []}
        for group in _groups([(k, (t or "").encode().split()) for k, t in zip(keys, texts, strict=True)]):
            names: dict[bytes, int] = {}
            edited = [words if edit is None else edit(k, words) for k, words in group]
            symbols = [np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)) for words in edited]
            for words, found in zip(edited, runs(symbols, rule), strict=True):
                out["runs"].append([{"start": a, "length": n, "period": q} for a, n, q in found.tolist()])
                out["collapsed"].append(collapse(words, found).decode())
        return out

    return add_columns(docs, (key, text), "runs array<struct<start:long,length:long,period:long>>, collapsed string", run)


def run_report(docs: DataFrame, rule: RunRule = RunRule(), edit: Callable | None = plant) -> DataFrame:
    """Per document its number of runs, its longest one (ties: least start, then period) and digests of all of them."""
    found = find_runs(docs.select("doc_id", "text"), rule, edit=edit)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    line = lambda r: F.concat_ws(",", r.start, r.length, r.period)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
