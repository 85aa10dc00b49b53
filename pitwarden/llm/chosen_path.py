"""Near-duplicates by a chosen-path similarity join on word shingles.

A document is the set of its 5-word shingles; documents with equal sets are one class from the start. Each of several
independent trees branches the classes recursively: a node picks one of the minwise tokens by a hash of its path, and
its members go to the child named by their own token. Branching stops in nodes of at most ``node_limit`` classes, which
are compared exhaustively on their sketches. A node that stays large (copies of one text agree on almost every token) is
compared in chunks that share its first member.

Candidates are confirmed on the full sets in two turns. First the greatest spanning forest of each node's candidate
links; after it, the candidates between classes that are still in different components. A link inside a component cannot
change it, so nothing is lost by not writing all pairs of a group of copies. Where a node has few such candidates they
are written as pairs, once for all trees; where it has many, the full sets of its members are brought to the node and
compared there, and only the links that join components are written. Either way a node writes rows in proportion to its
members.

Recall: a pair of similarity s shares a node of depth d in one tree with probability s**d, so it escapes all trees with
(1 - s**d)**trees: below 1e-9 at depth 1 and 1e-3 at ``max_depth`` for s = 0.85 and 16 trees, or s = 0.8 and 26.

Defined results: a document without words (null, empty, white space) has an empty set and is its own component; with
fewer than five words its one shingle is the whole sequence; repeated rows share a class; a row without an id is never
the smallest of its component unless all its members lack one; an empty table gives an empty result; other columns are
not read, but ``keep_first`` returns all of them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from pitwarden.llm.common import by_batch, stage, width
from pitwarden.operators.components import connected_components


@dataclass(frozen=True)
class JoinRule:
    percent: int = 85  # 100 * intersection >= percent * union
    words: int = 5
    trees: int = 16
    max_depth: int = 6
    node_limit: int = 64
    chunk: int = 1024  # classes of a large node compared at once
    seed: int = 23

    @property
    def sketch_least(self) -> int:
        """Equal sketch places of a candidate: over four standard deviations below the expectation at ``percent``."""
        p = self.percent / 100
        return int(TOKENS * p - 4.6 * (TOKENS * p * (1 - p)) ** 0.5)


TOKENS = 128
_rng = np.random.default_rng(98765)
_A = _rng.integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, TOKENS, dtype=np.uint64)
BASE = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}
CHUNK = 1 << 20


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASE, np.uint64)], dtype=np.uint64)
            down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, pow(BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        _powers.update(up=up, down=down)
    return _powers["up"], _powers["down"]


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased word shingles, hashed as spans of the joined words."""
    parts = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return np.zeros(0, np.uint64)
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    k = min(words, len(parts))
    data = np.frombuffer(b" ".join(parts), np.uint8)
    found = []
    # Long texts in pieces of words; neighbours share the words of the shingles across their border.
    step = max(1, int(CHUNK // max(1, length.max() + 1)))
    for lo in range(0, len(parts) - k + 1, step):
        hi = min(lo + step, len(parts) - k + 1)
        a, b = starts[lo:hi], ends[lo + k - 1 : hi + k - 1]
        base = int(a[0])
        piece = data[base : int(b[-1])]
        up, down = _tables(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], dtype=np.uint64, out=total[1:])
            h = (total[b - base] - total[a - base]) * down[a - base] + (b - a).astype(np.uint64)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        found.append(h ^ (h >> np.uint64(32)))
    return np.unique(np.concatenate(found))


def tokens_of(found: np.ndarray) -> np.ndarray:
    """Minwise tokens: per hash function the least 32-bit value over the set."""
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(found), 2048):
        with np.errstate(over="ignore"):
            mixed = found[lo : lo + 2048][None, :] * _A[:, None] + _B[:, None]
        np.minimum(out, (mixed >> np.uint64(32)).astype(np.uint32).min(axis=1), out=out)
    return out


def text_id(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def describe(docs: DataFrame, rule: JoinRule) -> DataFrame:
    """(doc_id, tid, cid, n, tokens, sketch): set class, set size and minwise tokens of every row; the sketch has the
    lowest byte of each token."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id(F.col("text")).alias("tid"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                ids, tids, texts = (batch.slice(lo, 512).column(i) for i in range(3))
                cids, sizes, tokens, sketch = [], [], [], []
                for text in texts.to_pylist():
                    found = shingles(text, rule.words)
                    sizes.append(len(found))
                    cids.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    own = tokens_of(found) if len(found) else None
                    tokens.append(None if own is None else own.view(np.int32))
                    sketch.append(None if own is None else own.astype(np.uint8).tobytes())
                yield {"doc_id": ids, "tid": tids, "cid": cids, "n": sizes, "tokens": tokens, "sketch": sketch}

    return by_batch(rows, "doc_id long, tid binary, cid binary, n long, tokens array<int>, sketch binary", run)


def _token(path: Column) -> Column:
    """The member's token at the position that the node's path picks."""
    return F.element_at("tokens", (F.pmod(path, F.lit(TOKENS)) + 1).cast("int"))


def tree_nodes(classes: DataFrame, rule: JoinRule) -> tuple[DataFrame, DataFrame]:
    """(node, cid) of the small nodes, and (node, cid, size) of those still large at ``max_depth``."""
    roots = F.transform(F.sequence(F.lit(1), F.lit(rule.trees)), lambda t: F.xxhash64(F.lit(rule.seed), t))
    level = classes.select("cid", "tokens", F.explode(roots).alias("path")).select("cid", F.xxhash64("path", _token(F.col("path"))).alias("node"))
    small = None
    for depth in range(1, rule.max_depth + 1):
        level = stage(level, "level")
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        held = stage(level.join(sizes, "node"), "nodes")
        few = held.filter(F.col("size") <= rule.node_limit).select("node", "cid")
        small = few if small is None else small.unionByName(few)
        large = held.filter(F.col("size") > rule.node_limit)
        if depth == rule.max_depth or large.isEmpty():
            return small, large
        level = large.join(classes.select("cid", "tokens"), "cid").select("cid", F.xxhash64("node", _token(F.col("node"))).alias("node"))
    raise AssertionError


def forest(sketch: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The greatest spanning forest of the candidate links of one node, grown from one member after the other."""
    out = []
    free = np.arange(len(sketch))
    best = np.full(len(sketch), -1)
    near = np.zeros(len(sketch), np.int64)
    while len(free):
        at = int(np.argmax(best[free]))
        one = int(free[at])
        if best[one] >= least:
            out.append((int(near[one]), one))
        free = np.delete(free, at)
        alike = (sketch[free] == sketch[one]).sum(axis=1)
        closer = alike > best[free]
        best[free[closer]], near[free[closer]] = alike[closer], one
    return out


def across(sketch: np.ndarray, component: list, least: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Candidate links between members of different components, at most ``DENSE`` per member; if there are more, none,
    but which members have any."""
    names: dict = {}
    number = np.array([names.setdefault(c, len(names)) for c in component])
    out: list[tuple[int, int]] = []
    busy = np.zeros(len(sketch), bool)
    dense = False
    for i in range(len(sketch) - 1):
        near = np.flatnonzero(((sketch[i + 1 :] == sketch[i]).sum(axis=1) >= least) & (number[i + 1 :] != number[i])) + i + 1
        busy[i] |= len(near) > 0
        busy[near] = True
        if not dense:
            out += [(i, int(j)) for j in near]
            dense = len(out) > DENSE * len(sketch)
    return ([], busy) if dense else (out, np.zeros(len(sketch), bool))


DENSE = 4


def by_node(members: DataFrame, columns: list[str], schema: str, solve) -> DataFrame:
    """Call ``solve`` with the rows of each node (node first, then cid, ...) and collect the tuples it returns."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    dealt = members.select(columns).repartition(width(members.sparkSession), "node").sortWithinPartitions("node", "cid")

    def run(batches):
        held: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(columns))), strict=True):
                if held and row[0] != held[0][0]:
                    if len(held) > 1:
                        out += solve(held)
                    held = []
                held.append(row)
            if out:
                yield dict(zip(names, zip(*out, strict=True), strict=True))
                out = []
        if len(held) > 1 and (out := solve(held)):
            yield dict(zip(names, zip(*out, strict=True), strict=True))

    return by_batch(dealt, schema, run)


def _sketches(rows: list[tuple]) -> np.ndarray:
    return np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), TOKENS)


def _ordered(a: bytes, b: bytes) -> tuple[bytes, bytes]:
    return (a, b) if a < b else (b, a)


def first_links(members: DataFrame, rule: JoinRule) -> DataFrame:
    """Candidate pairs (a < b): the greatest spanning forest of every node. ``members``: node, cid, sketch."""

    def solve(rows):
        return [_ordered(rows[i][1], rows[j][1]) for i, j in forest(_sketches(rows), rule.sketch_least)]

    return by_node(members, ["node", "cid", "sketch"], "a binary, b binary", solve).distinct()


def open_links(members: DataFrame, rule: JoinRule) -> DataFrame:
    """(node, a, b): candidates between components; from a node with many of them its members (b is null).

    ``members``: node, cid, sketch, component.
    """

    def solve(rows):
        pairs, busy = across(_sketches(rows), [r[3] for r in rows], rule.sketch_least)
        return [(rows[i][0], *_ordered(rows[i][1], rows[j][1])) for i, j in pairs] + [(rows[i][0], rows[i][1], None) for i in np.flatnonzero(busy)]

    return by_node(members, ["node", "cid", "sketch", "component"], "node long, a binary, b binary", solve)


def compare_nodes(members: DataFrame, rule: JoinRule) -> DataFrame:
    """Links (a, b) that join the components of a node, found by comparing all full sets in it.

    ``members``: node, cid, items, component. One pass over the node's shingles gives a member's intersections with all.
    """

    def solve(rows):
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        size = np.array(list(map(len, sets)))
        ends = np.cumsum(size)
        starts = ends - size
        number = np.unique(np.concatenate(sets), return_inverse=True)[1]
        parent = {r[3]: r[3] for r in rows}

        def top(c):
            while parent[c] != c:
                c = parent[c]
            return c

        out = []
        for i, row in enumerate(rows):
            mark = np.zeros(int(ends[-1]), bool)
            mark[number[starts[i] : ends[i]]] = True
            common = np.add.reduceat(mark[number].astype(np.int64), starts)
            for j in np.flatnonzero(100 * common >= rule.percent * (size[i] + size - common)):
                p, q = top(row[3]), top(rows[j][3])
                if p != q:
                    parent[q] = p
                    out.append(_ordered(row[1], rows[j][1]))
        return out

    return by_node(members, ["node", "cid", "items", "component"], "a binary, b binary", solve).distinct()


def confirm(pairs: DataFrame, sets: DataFrame, rule: JoinRule) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    both = pairs.join(sets.withColumnsRenamed({"cid": "a", "items": "x"}), "a").join(sets.withColumnsRenamed({"cid": "b", "items": "y"}), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(y, x)
                inside = at < len(y)
                common = int((y[at[inside]] == x[inside]).sum())
                if 100 * common >= rule.percent * (len(x) + len(y) - common):
                    out.append((a, b))
            yield {"a": [p[0] for p in out], "b": [p[1] for p in out]}

    return by_batch(both, "a binary, b binary", run)


def full_sets(docs: DataFrame, wanted: DataFrame, rule: JoinRule) -> DataFrame:
    """(cid, items) of the wanted classes, from one text of each. ``wanted``: cid, tid."""
    texts = docs.select(text_id(F.col("text")).alias("tid"), F.col("text").cast("string").alias("text")).join(wanted, "tid").groupBy("cid").agg(F.first("text").alias("text"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield {"cid": part.column(0), "items": [shingles(t, rule.words).tobytes() for t in part.column(1).to_pylist()]}

    return by_batch(texts.select("cid", "text"), "cid binary, items binary", run)


def _chunked(large: DataFrame, rule: JoinRule) -> DataFrame:
    """Members of large nodes in chunks of their node; each chunk also has the node's first member."""
    chunk = F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / rule.chunk))
    first = large.groupBy("node", "size").agg(F.min("cid").alias("cid")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / rule.chunk) - 1)))
    rows = large.select("node", "cid", chunk.alias("chunk")).unionByName(first.select("node", "cid", "chunk")).distinct()
    return rows.select(F.xxhash64("node", "chunk").alias("node"), "cid")


def _chunk_pairs(open_nodes: DataFrame, rule: JoinRule) -> DataFrame:
    """Members of large nodes that hold several components, dealt so that every two chunks meet."""
    chunks = F.ceil(F.col("size") / rule.chunk)
    own = F.pmod(F.xxhash64("cid"), chunks)
    dealt = open_nodes.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return dealt.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "cid", "component")


def components(docs: DataFrame, rule: JoinRule = JoinRule()) -> DataFrame:
    """(doc_id, tid, cid, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    rows = stage(describe(docs, rule), "sets")
    filled = rows.filter("cid IS NOT NULL")
    classes = stage(filled.groupBy("cid").agg(F.min("tid").alias("tid"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")), "classes")
    small, large = tree_nodes(classes, rule)
    sketches = classes.select("cid", "sketch")
    has_large = not large.isEmpty()
    near = small.unionByName(_chunked(large, rule)) if has_large else small
    pairs = stage(first_links(near.join(sketches, "cid"), rule), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "tid"), "cid")
    sets = stage(full_sets(docs, wanted, rule), "items")
    links = stage(confirm(pairs, sets, rule), "links")
    found = stage(connected_components(links, [], "a", "b"), "components")
    # What is left: candidates between different components. Outside chunks only classes with a candidate can have one.
    label = wanted.select("cid").join(found.withColumnsRenamed({"node": "cid"}), "cid", "left").select("cid", F.coalesce("component", "cid").alias("component"))
    label = stage(label, "labels")
    mixed = lambda nodes: nodes.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("node")
    inside = small.join(label, "cid")
    rest = inside.join(mixed(inside), "node")
    if has_large:
        # In chunks, a member without a first link has not met the other chunks.
        inside = large.join(label, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        rest = rest.select("node", "cid", "component").unionByName(_chunk_pairs(inside.join(mixed(inside), "node"), rule))
    late = stage(open_links(rest.join(sketches, "cid"), rule), "open")
    if has_large:
        unread = late.select(F.explode(F.array("a", "b")).alias("cid")).filter("cid IS NOT NULL").distinct().join(wanted.select("cid"), "cid", "left_anti")
        sets = sets.unionByName(stage(full_sets(docs, unread.join(classes.select("cid", "tid"), "cid"), rule), "items"))
    if not late.isEmpty():
        few = late.filter("b IS NOT NULL").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
        many = late.filter("b IS NULL").select("node", F.col("a").alias("cid")).join(sets, "cid").join(label, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        found = stage(connected_components(links.unionByName(confirm(few, sets, rule)).unionByName(compare_nodes(many, rule)), [], "a", "b"), "components")
    placed = rows.drop("tokens", "sketch").join(found.withColumnsRenamed({"node": "cid"}), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = placed.filter("cid IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "component", "left").select(
        "doc_id", "tid", "cid", F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def near_duplicates(docs: DataFrame, rule: JoinRule = JoinRule()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    return components(docs.select("doc_id", "text"), rule).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, rule: JoinRule = JoinRule()) -> DataFrame:
    """The rows of ``docs``, one of each component (the smallest id), with their own columns.

    Rows that are repeated in full stay once.
    """
    placed = stage(components(docs.select("doc_id", "text"), rule), "placed")
    last = ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = stage(placed.filter(last).select(F.col("doc_id").alias("__id"), F.col("tid").alias("__tid")).distinct(), "gone")
    keyed = docs.withColumn("__text", text_id(F.col("text")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__tid"))
    kept = keyed.join(gone, same, "left_anti")
    again = stage(placed.filter(~last).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("doc_id").alias("__id")), "again")
    if not again.isEmpty():
        # Several rows with the smallest id of one component: the least text stays.
        match = F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
        doubled = kept.join(again, match, "left_semi").dropDuplicates(["doc_id", "__text"])
        cid = placed.filter(~last).select(F.col("doc_id").alias("__id"), F.col("tid").alias("__tid"), F.coalesce("cid", "tid").alias("__cid")).distinct()
        one = cid.groupBy("__id", "__cid").agg(F.min("__tid").alias("__tid")).select("__id", "__tid")
        kept = kept.join(again, match, "left_anti").unionByName(doubled.join(one, same, "left_semi"))
    return kept.drop("__text")
