"""Byte-level BPE with a hierarchical-bitmap rank queue.

The symbols of a pre-token form a linked list. Each merge rank has a bucket of list positions whose pair had that rank
when it was put there; a bitmap of three levels marks the filled buckets, so find-first-set gives the lowest rank in a
constant number of steps, however long the pre-token is. Entries whose pair has changed since are stale and skipped.
Within a bucket the leftmost position goes first.

Defined results: a null text counts as empty, with no tokens; repeated rows each get their own result; an empty table
gives an empty result; a column named like a result column gives way to it.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import regex
from pyspark.sql import DataFrame, SparkSession

from pitwarden.llm.common import add_columns

LOW = 63
CACHE_ENTRIES = 200_000  # in each of two generations, at some 225 bytes: under 100 MB in a worker
CACHED_CHARS = 32  # longer pre-tokens are not kept


class RankQueue:
    """Positions by merge rank, for ranks below 2**18; empty again after every pre-token, so it is made once."""

    __slots__ = ("buckets", "bottom", "middle", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.bottom = [0] * (1 << 12)  # a bit per rank
        self.middle = [0] * (1 << 6)  # a bit per filled word of the bottom
        self.top = 0  # a bit per filled word of the middle

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        low = rank >> 6
        word = self.bottom[low]
        self.bottom[low] = word | 1 << (rank & LOW)
        if not word:
            high = low >> 6
            word = self.middle[high]
            self.middle[high] = word | 1 << (low & LOW)
            if not word:
                self.top |= 1 << high

    def take(self) -> tuple[int, int]:
        """Remove the leftmost position of the lowest filled rank, found by find-first-set on three levels."""
        top = self.top
        high = (top & -top).bit_length() - 1
        word = self.middle[high]
        low = high << 6 | (word & -word).bit_length() - 1
        word = self.bottom[low]
        rank = low << 6 | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        word &= word - 1
        self.bottom[low] = word
        if not word:
            word = self.middle[high]
            word &= word - 1
            self.middle[high] = word
            if not word:
                self.top = top & (top - 1)
        return rank, bucket[0]


class Vocabulary:
    def __init__(self, lines: bytes) -> None:
        pairs = [line.split() for line in lines.splitlines() if line]
        self.rank = {base64.b64decode(token): int(number) for token, number in pairs}
        size = max(self.rank.values()) + 1
        if size > 1 << 18:
            raise ValueError("the rank queue holds ranks below 2**18")
        self.token: list[bytes] = [b""] * size
        for token, number in self.rank.items():
            self.token[number] = token
        self.decimal = list(map(str, range(size)))
        self.byte = [self.rank[bytes([i])] for i in range(256)]
        # Rank of every pair of tokens that merges: all splits of a token into two others.
        self.pair = {
            left << 18 | right: number for token, number in self.rank.items() for i in range(1, len(token))
            if (left := self.rank.get(token[:i])) is not None and (right := self.rank.get(token[i:])) is not None
        }
        self.queue = RankQueue()

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        pair = self.pair.get
        parts = [self.byte[b] for b in piece]  # -1: merged into the part on its left
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = self.queue
        push, take = queue.push, queue.take
        for i in range(n - 1):
            r = pair(parts[i] << 18 | parts[i + 1])
            if r is not None:
                push(r, i)
        while queue.top:
            r, i = take()
            left = parts[i]
            if left < 0:
                continue  # stale
            j = after[i]
            if j >= n or pair(left << 18 | parts[j]) != r:
                continue  # stale
            parts[i], parts[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                s = pair(r << 18 | parts[k])
                if s is not None:
                    push(s, i)
            h = before[i]
            if h >= 0:
                s = pair(parts[h] << 18 | r)
                if s is not None:
                    push(s, h)
        return [p for p in parts if p >= 0]


class Encoder:
    """Encodes pre-token by pre-token and keeps up to ``cache`` results in each of two generations; results do not depend on it."""

    def __init__(self, lines: bytes, pattern: str, cache: int = CACHE_ENTRIES) -> None:
        self.cache = cache
        self.vocabulary = Vocabulary(lines)
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}  # filled before; what is used again moves back

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, merge = self.known, self.vocabulary.merge
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.older.get(piece)
                if ids is None:
                    ids = tuple(merge(piece.encode()))
                if len(piece) <= CACHED_CHARS:
                    if len(known) >= self.cache:
                        self.older, self.known = known, {}
                        known = self.known
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(lines: bytes, pattern: str, cache: int = CACHE_ENTRIES) -> Encoder:
    return Encoder(lines, pattern, cache)


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The rank file, under a MB whatever the corpus is: from the driver's disk, or by Spark if ``path`` is a URL."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])
    with open(path, "rb") as file:
        return file.read()


IDS = "n_tokens long, ids array<int>"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_column(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with token ids."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(texts):
        ids = [encoder(shared.value, pattern).encode(t or "") for t in texts]
        return {"n_tokens": list(map(len, ids)), "ids": ids}

    return add_columns(docs, (text,), IDS, run)


def decode_column(encoded: DataFrame, ranks: bytes, pattern: str, ids: str = "ids") -> DataFrame:
    """All rows and columns of ``encoded`` with the bytes of their token ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(rows):
        return {"decoded": [encoder(shared.value, pattern).decode(r or []) for r in rows]}

    return add_columns(encoded, (ids,), "decoded binary", run)


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", cache: int = CACHE_ENTRIES) -> DataFrame:
    """All rows and columns of ``docs`` with digests of their ids and of the bytes decoded from them.

    ``cache``: kept pre-tokens in each of two generations of a worker, memory (225 bytes an entry) against time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(texts):
        coder = encoder(shared.value, pattern, cache)
        got: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in texts:
            ids = coder.encode(t or "")
            got["n_tokens"].append(len(ids))
            got["ids_sha256"].append(hashlib.sha256(",".join(map(coder.vocabulary.decimal.__getitem__, ids)).encode()).hexdigest())
            got["decoded_sha256"].append(hashlib.sha256(coder.decode(ids)).hexdigest())
        return got

    return add_columns(docs, (text,), DIGESTS, run)
