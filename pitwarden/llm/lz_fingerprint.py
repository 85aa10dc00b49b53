"""Lempel-Ziv phrase fingerprint.

A text is parsed into dictionary phrases (each phrase is the longest one seen before plus one code point), every phrase
is hashed from prefix sums of its code points, and the phrase set is kept as a signature of minimum hashes. The share of
equal places of two signatures estimates the Jaccard likeness of the phrase sets, which follows how well one text
compresses given the other.

``edited_pairs`` walks documents in descending id. Documents are dealt into id ranges; each range also gets the first
document of the next one as a guest, so that neighbours meet without one global window.

Defined results: a null text counts as empty; an empty text has the signature of the empty set, which is like itself
only; rows with the same id follow each other by text; rows without an id come last; a single row is its own successor.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from pitwarden.llm.common import by_batch

HASHES = 64
EMPTY = np.uint32(0xFFFFFFFF)
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n, grown by doubling and kept."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASE, np.uint64)], dtype=np.uint64)
            down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, pow(BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        _powers.update(up=up, down=down)
    return _powers["up"], _powers["down"]


def parse(text: str, seen: set[str], out: list[str]) -> str:
    """Append the phrases of ``text`` to ``out`` and ``seen``; returns the unfinished rest, a phrase seen before."""
    cur = ""
    add, take = seen.add, out.append
    for c in text:
        cur += c
        if cur not in seen:
            add(cur)
            take(cur)
            cur = ""
    return cur


def phrase_hashes(text: str, phrases: list[str]) -> np.ndarray:
    """One 64-bit hash per phrase of consecutive ``phrases`` that make up ``text``."""
    if not phrases:
        return np.zeros(0, np.uint64)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    up, down = _power_tables(len(code) + 1)
    length = np.fromiter(map(len, phrases), np.int64, len(phrases))
    ends = np.cumsum(length)
    starts = ends - length
    with np.errstate(over="ignore"):
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code + np.uint64(1)) * up[: len(code)], dtype=np.uint64, out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def signature(hashes: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, EMPTY, np.uint32)
    for lo in range(0, len(hashes), 2048):
        with np.errstate(over="ignore"):
            mixed = hashes[lo : lo + 2048][None, :] * _A[:, None] + _B[:, None]
        np.minimum(out, (mixed >> np.uint64(32)).astype(np.uint32).min(axis=1), out=out)
    return out


def _signed(text: str, phrases: list[str], rest: str) -> np.ndarray:
    return signature(phrase_hashes(text, [*phrases, rest] if rest else phrases))


def fingerprint(text: str) -> np.ndarray:
    out: list[str] = []
    rest = parse(text, set(), out)
    return _signed(text, out, rest)


def fingerprint_pair(text: str, edited: str, common: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of two texts whose first ``common`` code points agree; that part is parsed once."""
    seen: set[str] = set()
    head: list[str] = []
    end = common - len(parse(text[:common], seen, head))
    base = _signed(text[:end], head, "")
    found = []
    for tail in (text[end:], edited[end:]):
        phrases: list[str] = []
        rest = parse(tail, seen, phrases)
        found.append(np.minimum(base, _signed(tail, phrases, rest)))
        seen.difference_update(phrases)  # back to the phrases of the common part
    return found[0], found[1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edit(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as many code points from the start of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """(part, guest, id, text): documents dealt into id ranges, each range closed by a guest from the next one."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = base.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).head()[0] or []
    edges = sorted(set(cuts))  # one per range, whatever the rows
    part = F.lit(0)
    if edges:
        # Ranges by descending id; null ids come after all others.
        part = F.when(F.col("doc_id").isNull(), len(edges) + 1).otherwise(F.lit(len(edges)) - F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("doc_id"))))
    dealt = base.withColumn("part", part)
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("doc_id")).orderBy("part").collect()  # one row per range
    rows = [(h.part, h.doc_id, heads[i - 1].part) for i, h in enumerate(heads)]
    table = docs.sparkSession.createDataFrame(rows, "first_of int, first_id long, closes int")
    guests = (
        dealt.join(F.broadcast(table), (F.col("part") == F.col("first_of")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy("closes", "doc_id").agg(F.min("text").alias("text"))
        .select("doc_id", "text", F.col("closes").alias("part"), F.lit(True).alias("guest"))
    )
    return dealt.withColumn("guest", F.lit(False)).unionByName(guests)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_pairs(docs: DataFrame, parts: int) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document."""
    dealt = neighbours(docs, parts)
    ordered = dealt.repartition(max(1, parts), "part").sortWithinPartitions(F.col("part"), F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("text"))

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def walk(batches):
        # Rows come range by range in document order, and a range's guest ends it.
        waiting = held = None  # a result that lacks its successor's signature; a document that lacks its successor
        out: list[tuple] = []
        for batch in batches:
            for part, guest, doc_id, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "guest", "doc_id", "text")), strict=True):
                if held is not None:
                    own, result = finish(*held, text)
                    if waiting is not None:
                        out.append((*waiting[1], likeness(waiting[0], own)))
                    waiting = own, result
                if guest:
                    out.append((*waiting[1], likeness(waiting[0], fingerprint(text))))
                    waiting = held = None
                else:
                    held = doc_id, text
                if len(out) >= 500:
                    yield columns(out)
                    out = []
        if out:
            yield columns(out)

    def finish(doc_id, text, following):
        edited = edit(text, following)
        own, other = fingerprint_pair(text, edited, len(text) - len(text) // 3)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        return own, (doc_id, len(text), digest, *(x.astype(">u4").tobytes().hex() for x in (own, other)), likeness(own, other))

    def columns(rows):
        return dict(zip(names, zip(*rows, strict=True), strict=True))

    return by_batch(ordered, SCHEMA, walk)
