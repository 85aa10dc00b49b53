"""Near-duplicate vectors by a forest of random-projection trees.

Vectors are compared only with those of an equal label and length. Equal ones are one class from the start. A tree splits
a node at the median of its members' projections on a random direction, and members near the cut go to both sides (spill
overlap); a node that would spill too many of its members, such as a group of near copies, is not split further. The
trees are fitted on a bounded sample, then every class is sent through all of them to its leaves.

Leaves are compared in two turns. First with codes of one byte per component, whose rounding error is known, so that no
pair at the bound is missed: it tells which members have a possible partner in the leaf. Only those bring their exact
vectors there, and the cosine in double precision decides. A pair that meets in several leaves is counted in the first of
them, which both sides know from the list of leaves they carry; a leaf returns one row per member, with its number of new
links and a spanning link, never the pairs. Spanning links give the components. A leaf of more than ``block`` members is
cut into blocks of which every two meet, so no task holds more than two blocks; its members are sent once per block,
which is what exact link counts inside one such group cost.

Recall: per level a pair at the bound is separated with probability of about 4 % at ``spill`` = 1/3, so it escapes one
tree of depth d with 1 - 0.96**d and all with that to the power ``trees``: 1e-5 at depth 6, 2e-3 at depth 12. Closer pairs are
separated less often. ``tests/llm`` measures it against brute force.

Defined results: a vector that is null, empty or zero, or holds a null or non-finite component, and one without a label
link with nothing and are their own component; repeated rows link with each other; a row without an id is never the
smallest of its component unless all its members lack one; vectors of any length are compared whole (directions use their
first ``width`` components); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pitwarden.llm.common import by_batch, stage, width
from pitwarden.operators.components import connected_components


@dataclass(frozen=True)
class ForestRule:
    cosine: float = 0.93
    trees: int = 8
    leaf: int = 256  # classes of one label that a leaf should hold
    spill: float = 1 / 3  # half width of the overlap, in standard deviations of a boundary pair's projected distance
    spill_most: float = 0.3  # share of a node's sample in the overlap beyond which it is not split
    sample: int = 131_072  # vectors that the trees are fitted on
    least: int = 8  # sampled vectors of a node that is split
    depth: int = 16
    directions: int = 512
    width: int = 1024  # components that a direction uses
    tries: int = 3  # directions tried per node
    block: int = 4096  # members of a leaf compared at once
    seed: int = 71


SLAB = 512  # rows of a leaf's matrix at a time
KEY = ["label", "dim", "leaf"]


@dataclass(frozen=True)
class Forest:
    bank: np.ndarray  # directions x width
    direction: np.ndarray  # trees x nodes: which of them
    cut: np.ndarray  # trees x nodes; infinite where a node is not split
    margin: float
    depth: int


def _rows(column) -> list[np.ndarray | None]:
    """The vectors of an Arrow list column as doubles; None for those that link with nothing."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component becomes NaN
    ends = np.cumsum(size)
    out: list[np.ndarray | None] = []
    for lo, hi in zip((ends - size).tolist(), ends.tolist(), strict=True):
        v = values[lo:hi]
        out.append(v if len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def _packed(v: np.ndarray) -> bytes:
    """The bytes of a vector, as single precision where that is exact."""
    with np.errstate(over="ignore"):
        short = v.astype(np.float32)
    return short.tobytes() if (short == v).all() else v.tobytes()


def _units(packed: list[bytes], dim: int) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    out = np.empty((len(packed), dim))
    for i, raw in enumerate(packed):
        out[i] = np.frombuffer(raw, np.float32 if len(raw) == 4 * dim else np.float64)
    out /= np.abs(out).max(axis=1)[:, None]  # so that no square over- or underflows
    return out / np.sqrt((out * out).sum(axis=1))[:, None]


def describe(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, cid, vec): class and packed vector of every row; all but vec_id null where nothing can link."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                ids, labels, lists = (batch.slice(lo, 4096).column(i) for i in range(3))
                out: dict[str, list] = {c: [] for c in ("label", "dim", "cid", "vec")}
                for label, v in zip(labels.to_pylist(), _rows(lists), strict=True):
                    able = label is not None and v is not None
                    raw = _packed(v + 0.0) if able else None  # + 0.0: one zero
                    out["label"].append(label if able else None)
                    out["dim"].append(len(v) if able else None)
                    out["cid"].append(hashlib.blake2b(f"{len(v)}:{label}:".encode() + raw, digest_size=16).digest() if able else None)
                    out["vec"].append(raw)
                yield {"vec_id": ids} | out

    return by_batch(rows, "vec_id long, label string, dim int, cid binary, vec binary", run)


def _padded(packed: list[bytes], dims: list[int], wide: int) -> np.ndarray:
    """The first ``wide`` components of unit vectors of any lengths."""
    out = np.zeros((len(packed), wide))
    for dim in set(dims):
        at = [i for i, d in enumerate(dims) if d == dim]
        out[at, : min(dim, wide)] = _units([packed[i] for i in at], dim)[:, :wide]
    return out


def fit(classes: DataFrame, rule: ForestRule = ForestRule()) -> Forest:
    """Trees fitted on at most about ``rule.sample`` classes, drawn by a hash; as deep as the largest label asks."""
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    total, most, widest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("dim"), F.lit(1))).first()
    depth = min(rule.depth, max(0, math.ceil(math.log2(max(1, most) / rule.leaf))))
    wide = min(widest, rule.width)
    rng = np.random.default_rng(rule.seed)
    bank = rng.normal(size=(rule.directions, wide))
    bank /= np.sqrt((bank * bank).sum(axis=1))[:, None]
    nodes = (1 << depth) - 1
    direction = rng.integers(0, rule.directions, (rule.tries, rule.trees, max(1, nodes)))
    cut = np.full((rule.trees, max(1, nodes)), np.inf)
    margin = rule.spill * math.sqrt(2 * (1 - rule.cosine) / wide)
    chosen = direction[0].copy()
    if nodes:
        share = min(1.0, rule.sample / total)
        drawn = classes.filter(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("dim", "vec").toArrow()
        along = _padded(drawn.column("vec").to_pylist(), drawn.column("dim").to_pylist(), wide) @ bank.T
        for t in range(rule.trees):
            node = np.zeros(len(along), np.int64)
            for level in range(depth):
                first, count = (1 << level) - 1, 1 << level
                size = np.bincount(node - first, minlength=count)
                least = np.full(count, np.inf)
                for k in range(rule.tries):
                    found = direction[k, t, first : first + count]
                    value = along[np.arange(len(node)), found[node - first]]
                    order = np.lexsort((value, node))
                    middle = value[order[np.minimum(np.cumsum(size) - size + size // 2, len(node) - 1)]]
                    near = np.bincount(node - first, np.abs(value - middle[node - first]) < margin, count) / np.maximum(1, size)
                    better = (near < least) & (near <= rule.spill_most) & (size >= rule.least)
                    least[better] = near[better]
                    chosen[t, first : first + count][better] = found[better]
                    cut[t, first : first + count][better] = middle[better]
                value = along[np.arange(len(node)), chosen[t, node]]
                node = 2 * node + 1 + (value >= cut[t, node])
    return Forest(bank, chosen, cut, margin, depth)


def leaves_of(forest: Forest, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of all rows of the projections ``along``; a leaf's number tells its tree."""
    every_row, every_leaf = [], []
    for t in range(len(forest.cut)):
        row, node = np.arange(len(along)), np.zeros(len(along), np.int64)
        for _ in range(forest.depth):
            value, cut = along[row, forest.direction[t, node]], forest.cut[t, node]
            right = value >= cut - forest.margin
            left = value < cut + forest.margin
            row, node = np.r_[row[left], row[right]], np.r_[2 * node[left] + 1, 2 * node[right] + 2]
        every_row.append(row)
        every_leaf.append((np.int64(t) << 32) + node)
    return np.concatenate(every_row), np.concatenate(every_leaf)


def route(classes: DataFrame, forest: Forest, codes: bool) -> DataFrame:
    """(label, dim, leaf) of every class in all its leaves, and with ``codes`` also (cid, code, scale, slack)."""
    shared = classes.sparkSession.sparkContext.broadcast((forest.bank, forest.direction.astype(np.int16), forest.cut, forest.margin, forest.depth))

    def run(batches):
        bank, direction, cut, margin, depth = shared.value
        own = type("Own", (), {"direction": direction, "cut": cut, "margin": margin, "depth": depth})
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                labels, dims, cids, packed = (batch.slice(lo, 2048).column(i) for i in range(4))
                lengths, raw = dims.to_pylist(), packed.to_pylist()
                row, leaf = leaves_of(own, _padded(raw, lengths, bank.shape[1]) @ bank.T)
                out = {"label": labels.take(pa.array(row)), "dim": dims.take(pa.array(row)), "leaf": leaf}
                if codes:
                    code, scale, slack = _codes(raw, lengths)
                    out |= {"cid": cids.take(pa.array(row)), "code": pa.array(code, pa.binary()).take(pa.array(row)), "scale": scale[row], "slack": slack[row]}
                yield out

    schema = "label string, dim int, leaf long" + ", cid binary, code binary, scale float, slack float" * codes
    return by_batch(classes.select("label", "dim", "cid", "vec"), schema, run)


def _codes(packed: list[bytes], dims: list[int]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """One signed byte per component of the unit vectors, the step, and the length of what rounding loses."""
    code: list[bytes] = [b""] * len(packed)
    scale, slack = np.zeros(len(packed), np.float32), np.zeros(len(packed), np.float32)
    for dim in set(dims):
        at = [i for i, d in enumerate(dims) if d == dim]
        unit = _units([packed[i] for i in at], dim)
        step = (np.abs(unit).max(axis=1) / 127).astype(np.float32)
        rounded = np.rint(unit / step[:, None]).clip(-127, 127)
        lost = unit - rounded * step[:, None]
        scale[at], slack[at] = step, np.sqrt((lost * lost).sum(axis=1)) * 1.00001 + 1e-7
        for i, c in zip(at, rounded.astype(np.int8), strict=True):
            code[i] = c.tobytes()
    return code, scale, slack


def in_blocks(members: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """``members`` with (low, high, side): the blocks of a large leaf that meet, and which of them a row is in.

    ``sizes``: the keys of leaves and their number n of members.
    """
    large = stage(sizes.filter(F.col("n") > block), "large")
    if large.isEmpty():
        return members.withColumns({"low": F.lit(0).cast("long"), "high": F.lit(0).cast("long"), "side": F.lit(0)})
    chunks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1))
    own = members.join(large, KEY, "left").withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("chunks")))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return met.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("n", "chunks", "own", "other")


def by_block(members: DataFrame, columns: list[str], schema: str, solve) -> DataFrame:
    """Call ``solve`` with each block's key and the rows (columns) in it; it returns tuples of ``schema``."""
    key = [*KEY, "low", "high"]
    names = [c.split(" ")[0] for c in schema.split(", ")]
    dealt = members.select(*key, *columns).repartition(width(members.sparkSession), *key).sortWithinPartitions(*key, "cid")
    n = len(key)

    def run(batches):
        held: list[tuple] = []
        at = None
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != at:
                    if len(held) > 1:
                        out += solve(at, held)
                    at, held = row[:n], []
                held.append(row[n:])
            if out:
                yield dict(zip(names, zip(*out, strict=True), strict=True))
                out = []
        if len(held) > 1 and (out := solve(at, held)):
            yield dict(zip(names, zip(*out, strict=True), strict=True))

    return by_batch(dealt, schema, run)


def possible(members: DataFrame, rule: ForestRule) -> DataFrame:
    """(label, dim, leaf, cid) of the members that may have a partner in their leaf. ``members``: routed codes in blocks."""

    def solve(key, rows):
        dim = key[1]
        scale, slack = (np.array([r[i] for r in rows], np.float32) for i in (2, 3))
        side = np.array([r[4] for r in rows])
        value = np.frombuffer(b"".join(r[1] for r in rows), np.int8).reshape(len(rows), dim).astype(np.float32) * scale[:, None]
        met = np.zeros(len(rows), bool)
        for lo in range(0, len(rows), SLAB):
            part = slice(lo, min(lo + SLAB, len(rows)))
            near = value[part] @ value.T >= rule.cosine - 1e-4 - (slack[part, None] * (1 + slack) + slack)
            near &= _meet(part, side, key)
            met |= near.any(axis=0)
            met[part] |= near.any(axis=1)
        return [(*key[:3], rows[i][0]) for i in np.flatnonzero(met)]

    return by_block(members, ["cid", "code", "scale", "slack", "side"], "label string, dim int, leaf long, cid binary", solve)


def _meet(part: slice, side: np.ndarray, key: tuple) -> np.ndarray:
    """Which pairs of the block are its business: all within one block of a leaf, or those across two."""
    if key[3] != key[4]:
        return side[part, None] != side
    out = np.ones((part.stop - part.start, len(side)), bool)
    out[np.arange(part.stop - part.start), np.arange(part.start, part.stop)] = False
    return out


def links(members: DataFrame, rule: ForestRule) -> DataFrame:
    """(cid, links, root): per member its links first met in this leaf and one member it is joined to by them.

    ``members``: possible partners in blocks with vec, copies and leaves (all leaves where the member may have a partner).
    """

    def solve(key, rows):
        unit = _units([r[1] for r in rows], key[1])
        copies = np.array([r[2] for r in rows], np.int64)
        side = np.array([r[4] for r in rows])
        earlier = _earlier([r[3] for r in rows], key[2])
        count = np.zeros(len(rows), np.int64)
        top = np.arange(len(rows))
        for lo in range(0, len(rows), SLAB):
            part = slice(lo, min(lo + SLAB, len(rows)))
            near = (unit[part] @ unit.T >= rule.cosine) & _meet(part, side, key)
            if earlier is not None and near.any():
                near &= ~(earlier[part] @ earlier.T > 0)
            count[part] += near @ copies
            for i in np.flatnonzero(near.any(axis=1)):
                joined = np.unique(top[np.r_[i + lo, np.flatnonzero(near[i])]])
                if len(joined) > 1:
                    top[np.isin(top, joined)] = joined[0]
        return [(rows[i][0], int(count[i]), rows[top[i]][0]) for i in np.flatnonzero(count)]

    return by_block(members, ["cid", "vec", "copies", "leaves", "side"], "cid binary, links long, root binary", solve)


def _earlier(leaves: list[list[int]], leaf: int) -> np.ndarray | None:
    """Members x leaves before ``leaf`` that several of them are in."""
    size = np.array([sum(x < leaf for x in own) for own in leaves])
    flat = np.array([x for own in leaves for x in own if x < leaf], np.int64)
    if not len(flat):
        return None
    _, name, times = np.unique(flat, return_inverse=True, return_counts=True)
    several = times > 1
    if not several.any():
        return None
    out = np.zeros((len(leaves), int(several.sum())), np.float32)
    keep = several[name]
    out[np.repeat(np.arange(len(leaves)), size)[keep], (np.cumsum(several) - 1)[name[keep]]] = 1
    return out


def near_vectors(vectors: DataFrame, rule: ForestRule = ForestRule()) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label)."""
    rows = stage(describe(vectors), "vectors")
    filled = rows.filter("cid IS NOT NULL").groupBy("cid")
    classes = stage(filled.agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies")), "classes")
    forest = fit(classes, rule)
    routed = in_blocks(route(classes, forest, True), route(classes, forest, False).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), rule.block)
    able = stage(possible(routed, rule).distinct(), "possible")
    own = able.groupBy("cid").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))  # as many as the trees have for it
    exact = able.join(own, "cid").join(classes.select("cid", "vec", "copies"), "cid")
    found = stage(links(in_blocks(exact, able.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), rule.block), rule), "links")
    joined = connected_components(found.select("cid", "root"), [], "cid", "root").withColumnsRenamed({"node": "cid"})
    per_class = (
        classes.select("cid", "copies").join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left").join(joined, "cid", "left")
        .select("cid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    )
    placed = stage(rows.select("vec_id", "cid").join(per_class, "cid", "left"), "placed")
    least = placed.filter("cid IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("least"))
    own_id = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return placed.join(least, "component", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own_id.alias("component_id"), F.col("vec_id").eqNullSafe(own_id).alias("kept"))
