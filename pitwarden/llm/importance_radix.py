"""Importance resampling towards a target corpus, ranked by a distributed radix sort.

Features are the runs of one to three words of a text, hashed into buckets. The counts of the buckets in the corpus and
in the target give every bucket a gain (a scaled logarithm of the ratio of its smoothed shares), one array of fixed size;
a document's weight is the sum of the gains of its features. A Gumbel draw seeded by the document's id is added, so the
highest scores are a sample without replacement in proportion to the weights' exponentials.

The ranks come from a least-significant-digit radix sort. The composite key (score falling, id rising, n_features
rising) is cut into digits. A pass counts each digit in each block of neighbouring places, sums the counts of smaller
digits and of earlier blocks to offsets, and moves a row to its offset plus its place among equal digits of its block,
which keeps the order of the passes before. Rows are dealt by (block, digit), so no task holds more than one block's rows
of a digit, however frequent the digit is; the only unpartitioned sum is over the digits' totals, at most 2**``DIGIT_BITS``.

Defined results: a null or empty text has no words, no features and weight 0, and is never drawn; ties in the score go
to the smaller id, then to fewer features, and rows equal in all three are interchangeable; a row without an id counts as id "None"
in its draw and comes after all others of its score; repeated rows are documents of their own; an empty target gives all buckets t = T = 0;
an empty corpus gives an empty result; texts of any length are scored whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from pitwarden.llm.common import by_batch, stage


@dataclass(frozen=True)
class ResampleRule:
    buckets: int = 10_000
    words: int = 3  # of the longest feature
    least_words: int = 20  # of a document that can be drawn
    percent: int = 5  # of those documents
    seed: str = "42"


DIGIT_BITS = 12
BLOCK = 1 << 16  # neighbouring places whose digits are counted together
PIECE = 1 << 16  # words hashed at a time

# A-Z are lower-cased, 0-9, a-z and all bytes above 127 are parts of words, the rest separates them.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def features(words: list[bytes], rule: ResampleRule = ResampleRule()):
    """Arrays of the buckets of all features of a text, repeats included."""
    spaced = [b" " + w for w in words]
    for lo in range(0, len(words), PIECE):
        first = words[lo : lo + PIECE]
        check = list(map(zlib.crc32, first))
        yield np.array(check, np.int64) % rule.buckets
        for k in range(1, rule.words):
            # The checksum of a longer feature goes on from that of the feature without its last word.
            check = list(map(zlib.crc32, spaced[lo + k : lo + k + PIECE], check))
            yield np.array(check, np.int64) % rule.buckets


def n_features(n_words: int, rule: ResampleRule) -> int:
    return sum(max(0, n_words - k) for k in range(rule.words))


def bucket_counts(texts: DataFrame, rule: ResampleRule = ResampleRule()) -> np.ndarray:
    """Features per bucket over all rows of ``texts`` (text): summed in tasks, then by Spark, then as one array."""

    def count(batches):
        held = np.zeros(rule.buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for found in features(words_of(text.as_py()), rule):
                    held += np.bincount(found, minlength=rule.buckets)
        at = np.flatnonzero(held)
        yield {"bucket": at, "n": held[at]}

    parts = by_batch(texts.select(F.col("text").cast("string").alias("text")), "bucket int, n long", count)
    out = np.zeros(rule.buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    size = float(len(source))
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, rule: ResampleRule = ResampleRule()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain.tobytes())

    def run(batches):
        own = np.frombuffer(shared.value, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                ids = batch.slice(lo, 512).column(0).to_pylist()
                sizes, weights = [], []
                for text in batch.slice(lo, 512).column(1):
                    words = words_of(text.as_py())
                    sizes.append(len(words))
                    weights.append(sum(int(own[found].sum()) for found in features(words, rule)))
                yield {
                    "doc_id": ids, "n_words": sizes, "n_features": [n_features(n, rule) for n in sizes], "weight": weights,
                    "score": [w + gumbel(i, rule.seed) for i, w in zip(ids, weights, strict=True)],
                }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return by_batch(rows, "doc_id long, n_words long, n_features long, weight long, score long", run)


def key_parts(rows: DataFrame, key: list[tuple[str, bool]]) -> list[tuple[Column, int]]:
    """(value, bits) of the parts of the composite key, most significant first. ``key``: column, falling.

    A column goes in halves of 32 bits, each less the least one, so that any longs fit; a null comes after all values.
    """
    parts: list[tuple[Column, int]] = []
    for name, falling in key:
        col = F.bitwise_not(name) if falling else F.col(name)
        halves = [F.shiftright(col, 32), col.bitwiseAND(0xFFFFFFFF)]
        # Values close together lie in one half unless a multiple of 2**32 is between them.
        bounds = rows.agg(F.count(F.when(F.col(name).isNull(), 1)), *[f(h) for h in halves for f in (F.min, F.max)]).first()
        if bounds[0]:
            parts.append((F.col(name).isNull().cast("long"), 1))
        for h, low, high in zip(halves, bounds[1::2], bounds[2::2], strict=True):
            if low is not None and high > low:
                parts.append((F.coalesce(h - F.lit(low), F.lit(0)), (high - low).bit_length()))
    return parts


def digits(parts: list[tuple[Column, int]], width: int = DIGIT_BITS) -> list[Column]:
    """The key's digits, least significant first; a digit may join the bits of several parts."""
    out: list[Column] = []
    pieces: list[tuple[Column, int]] = []
    room = width
    for value, bits in reversed(parts):
        at = 0
        while at < bits:
            take = min(room, bits - at)
            pieces.append((F.shiftright(value, at).bitwiseAND((1 << take) - 1), width - room))
            at += take
            room -= take
            if not room:
                out.append(_joined(pieces))
                pieces, room = [], width
    if pieces:
        out.append(_joined(pieces))
    return out


def _joined(pieces: list[tuple[Column, int]]) -> Column:
    total = F.lit(0).cast("long")
    for value, shift in pieces:
        total = total + F.shiftleft(value, shift)
    return total


def counting_pass(rows: DataFrame, digit: str, place: str, block: int) -> DataFrame:
    """``rows`` with ``place`` set to the place of a stable sort by ``digit``; places were distinct before."""
    cut = rows.withColumn("__block", F.floor(F.col(place) / block).cast("long"))
    counts = cut.groupBy(digit, "__block").agg(F.count(F.lit(1)).alias("__n"))
    totals = counts.groupBy(digit).agg(F.sum("__n").alias("__all"))
    before = totals.select(digit, (F.sum("__all").over(Window.orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__all")).alias("__base"))
    blocks = Window.partitionBy(digit).orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)
    offsets = counts.withColumn("__earlier", F.sum("__n").over(blocks) - F.col("__n")).join(before, digit).select(digit, "__block", (F.col("__base") + F.col("__earlier")).alias("__offset"))
    inside = cut.withColumn("__rank", F.row_number().over(Window.partitionBy("__block", digit).orderBy(place)) - 1)
    return inside.join(offsets, ["__block", digit]).withColumn(place, F.col("__offset") + F.col("__rank")).drop("__block", "__offset", "__rank")


def radix_sort(rows: DataFrame, key: list[tuple[str, bool]], place: str = "place", width: int = DIGIT_BITS, block: int = BLOCK) -> DataFrame:
    """``rows`` with their places 0, 1, 2, ... in the order of ``key``, a list of (long column, falling); nulls last.

    Rows equal in the key keep the order in which they were stored.
    """
    columns = rows.columns
    found = digits(key_parts(rows, key), width)
    names = [f"__digit{i}" for i in range(len(found))]
    # Starting places: dense inside a file part, and parts follow each other; the first pass makes them dense.
    start = stage(rows.withColumns(dict(zip(names, found, strict=True))).withColumn(place, F.monotonically_increasing_id()), "radix")
    if not names:
        names = ["__digit0"]
        start = start.withColumn("__digit0", F.lit(0).cast("long"))
    for name in names:
        start = stage(counting_pass(start, name, place, block).drop(name), "radix")
    return start.select(*columns, place)


def resample(docs: DataFrame, target: DataFrame, rule: ResampleRule = ResampleRule()) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of ``docs`` (doc_id, text).

    ``target`` has the texts (text) that the sample should resemble.
    """
    texts = docs.select("doc_id", "text")
    rows = stage(score(texts, gains(bucket_counts(texts, rule), bucket_counts(target, rule)), rule), "scores")
    able = rows.filter(F.col("n_words") >= rule.least_words)
    draws = rule.percent * able.count() // 100
    ordered = radix_sort(able, [("score", True), ("doc_id", False), ("n_features", False)])
    ranked = ordered.withColumn("rank", F.when(F.col("place") < draws, F.col("place") + 1))
    rest = rows.filter(F.col("n_words") < rule.least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(rest.columns).unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
