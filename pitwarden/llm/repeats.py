"""Suffix-array dedup: remove every byte that lies in a long string which also starts somewhere else.

1. Each window of ``length`` bytes is assigned to one of its k-grams, the one with the least hash (the rightmost in a
   tie). Equal windows are assigned to equal k-grams at the same place in them, so all that can be equal meets under
   one key. Windows of neighbouring starts with the same k-gram form a segment, and a few neighbouring segments, cut
   where their k-grams say so, form a group. Where a whole group occurs again, every window of it repeats; only one
   occurrence of it goes on, counted as several, so the inside of a frequent passage is handled once, not per document.
2. Keys that occur once have nothing to remove. Where all segments of a key are equal, or a segment itself occurs again,
   every window of theirs repeats, which counts tell without bringing the segments together.
3. Only distinct segments of one key remain, less the windows whose core no other segment of the key has. They are packed into shards of about ``shard_bytes``, and a suffix array
   with permuted common prefixes (``induced_sort``) finds the windows that several of them share. The few keys with more
   than ``key_segments`` distinct segments are cut into blocks of windows that must share a core, ever finer; blocks of
   one window are settled by counting. So no key, however frequent, is gathered in one task.
4. The starts go back to the texts, whose covered bytes are removed.

Texts that are equal as wholes are treated as one with a count.

Defined results: a null text counts as empty; texts shorter than ``length`` have no window and stay; repeated rows are
copies of each other and lose everything that a copy loses; an empty table gives an empty result; a column named like a
result column gives way to it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pitwarden.llm.common import add_columns, by_batch, stage
from pitwarden.llm.induced_sort import permuted_lcp, suffix_array


@dataclass(frozen=True)
class RepeatRule:
    length: int = 400  # bytes of a string that counts as repeated
    gram: int = 32  # bytes of the k-grams that windows are assigned to
    shard_bytes: int = 1 << 20
    key_segments: int = 1000
    blocks: tuple[int, ...] = (32, 1)  # windows in a block, for keys with more segments
    group: int = 3  # segments in a group, on average
    pieces: int = 8  # ranges of windows of a segment that are ruled out before sorting


CHUNK = 1 << 20  # windows of one text handled at a time
GROUP_MOST = 64  # segments in a group; where groups are cut only decides how much is settled early
PLACE = (1 << 24) - 1
BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASE, np.uint64)], dtype=np.uint64)
            down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, pow(BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        _powers.update(up=up, down=down)
    return _powers["up"], _powers["down"]


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _prefix_sums(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=total[1:])
    return total


def _span_hash(total: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def _least_in_windows(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, from minima up to and from the borders of blocks."""
    n = len(v)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    square = padded.reshape(blocks, w)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def group_cuts(key: np.ndarray, mean: int) -> np.ndarray:
    """Whether a new group starts at each segment: by its k-gram, and after ``GROUP_MOST`` segments."""
    cut = _mix(key) % np.uint64(mean) == 0
    at = np.arange(len(key))
    last = np.maximum.accumulate(np.where(cut, at, 0))
    return cut | ((at - last) % GROUP_MOST == 0)


@dataclass(frozen=True)
class Groups:
    """Groups of one chunk: hash of all bytes, first window, windows and place of the first segment; then their segments."""

    whole: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    first: np.ndarray
    key: np.ndarray
    seg: np.ndarray
    n: np.ndarray
    at: np.ndarray


def groups_of(data: np.ndarray, rule: RepeatRule) -> list[Groups]:
    """Segments of one text and their groups, by chunks; a segment has its key, hash, windows and the place of its k-gram."""
    out = []
    for base in range(0, max(0, len(data) - rule.length + 1), CHUNK):
        part = data[base : base + CHUNK + rule.length - 1]
        up, down = _tables(len(part) + 1)
        total = _prefix_sums(part, up)
        grams = len(part) - rule.gram + 1
        with np.errstate(over="ignore"):
            key = _mix((total[rule.gram :] - total[:-rule.gram]) * down[:grams])
        packed = (key & ~np.uint64(PLACE)) | (np.uint64(PLACE) - np.arange(grams, dtype=np.uint64))
        least = _least_in_windows(packed, rule.length - rule.gram + 1)
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        count = np.diff(np.append(first, len(least)))
        place = PLACE - (least[first] & np.uint64(PLACE)).astype(np.int64)
        seg = _span_hash(total, down, first, first + count + rule.length - 1)
        begin = np.flatnonzero(group_cuts(key[place], rule.group))
        start = first[begin]
        windows = np.diff(np.append(start, len(least)))
        whole = _span_hash(total, down, start, start + windows + rule.length - 1)
        out.append(Groups(whole.view(np.int64), start + base, windows, begin, key[place].view(np.int64), seg.view(np.int64), count, place - first))
    return out


def text_id(text: Column) -> Column:
    """128 bits of the text; a null text is empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


GROUP_ROW = "whole long, lead long, tid binary, start long, windows int, key array<long>, seg array<long>, n array<int>, at array<int>"


def find_groups(texts: DataFrame, rule: RepeatRule) -> DataFrame:
    """Groups of every row of ``texts`` (tid, body); no row is long, and only texts with a window have any."""

    def run(batches):
        longs, ints = (pa.list_(pa.field("element", t)) for t in (pa.int64(), pa.int32()))
        for batch in batches:
            tids, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(tids), 256):
                found, owners, firsts, segments = [], [], [], 0
                for tid, body in zip(tids[lo : lo + 256], bodies[lo : lo + 256], strict=True):
                    for g in groups_of(np.frombuffer(body, np.uint8), rule):
                        found.append(g)
                        owners += [tid] * len(g.start)
                        firsts.append(g.first + segments)
                        segments += len(g.key)
                if found:
                    def joined(name):
                        return np.concatenate([getattr(g, name) for g in found])

                    first = np.concatenate(firsts)
                    offsets = pa.array(np.append(first, segments), pa.int32())
                    key = joined("key")
                    yield {
                        "whole": joined("whole"), "lead": key[first], "tid": owners, "start": joined("start"), "windows": joined("windows"),
                        "key": pa.ListArray.from_arrays(offsets, pa.array(key), type=longs), "seg": pa.ListArray.from_arrays(offsets, pa.array(joined("seg")), type=longs),
                        "n": pa.ListArray.from_arrays(offsets, pa.array(joined("n"), pa.int32()), type=ints), "at": pa.ListArray.from_arrays(offsets, pa.array(joined("at"), pa.int32()), type=ints),
                    }

    return by_batch(texts.filter(F.octet_length("body") >= rule.length), GROUP_ROW, run)


def single_segments(groups: DataFrame, again: DataFrame) -> DataFrame:
    """Segments of the groups that occur once, and of one occurrence of every other (``weight`` 2: they repeat anyway)."""
    met = groups.join(again, ["whole", "lead"], "left").filter(F.col("one").isNull() | (F.col("one") == F.xxhash64("tid", "start")))
    ahead = F.transform("n", lambda n, i: F.aggregate(F.slice("n", 1, i), F.lit(0), lambda a, x: a + x))
    each = F.explode(F.arrays_zip("key", "seg", "n", "at", ahead.alias("ahead")))
    cut = met.select("tid", F.col("start").alias("group_start"), F.when(F.col("one").isNull(), 1).otherwise(2).alias("weight"), each.alias("s"))
    return cut.select("s.key", "s.seg", "tid", (F.col("group_start") + F.col("s.ahead")).alias("start"), "s.n", "s.at", "weight")


def _runs(mask: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"lo": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


RUNS = "array<struct<lo:int,n:int>>"


def shared_windows(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each body, which of its windows also stand elsewhere in ``bodies``."""
    size = sum(map(len, bodies)) + len(bodies) + 1
    t = np.ones(size, np.uint16)  # 1 ends a body, 0 the text
    t[-1] = 0
    left = np.zeros(size, np.int64)
    starts, at = [], 0
    for b in bodies:
        t[at : at + len(b)] = np.frombuffer(b, np.uint8).astype(np.uint16) + 2
        left[at : at + len(b)] = np.arange(len(b), 0, -1)
        starts.append(at)
        at += len(b) + 1
    sa = suffix_array(t, 258)
    common = permuted_lcp(t, sa, max(map(len, bodies)) + 1, border=1)
    long = common[sa] >= length
    hit = np.zeros(size, bool)
    hit[sa[long]] = True
    hit[sa[np.flatnonzero(long) - 1]] = True
    hit &= left >= length
    return [hit[a : a + len(b) - length + 1] for a, b in zip(starts, bodies, strict=True)]


def possible_windows(rows: list[tuple[int, int, int, bytes]], rule: RepeatRule) -> list[tuple[int, int] | None]:
    """For each distinct segment (key, seg, at, body): first and last window that another of its key may share, or None.

    Windows are sorted by the bytes ahead of their k-gram into ``rule.pieces`` ranges. All windows of a range contain the
    same core, so where no other segment of the key has that core, none of them is shared.
    """
    reach = rule.length - rule.gram
    step = -(-(reach + 1) // rule.pieces)
    ranges = [(a, min(a + step - 1, reach)) for a in range(0, reach + 1, step)]
    met: dict[tuple[int, int, int], int] = {}
    cores = []
    for key, _, at, body in rows:
        mine = []
        for a, b in ranges:
            least, most = max(a, at - len(body) + rule.length), min(b, at)
            if least <= most:
                core = (key, a, hash(body[at - a : at + rule.length - b]))
                met[core] = met.get(core, 0) + 1
                mine.append((core, at - most, at - least))
        cores.append(mine)
    found = []
    for mine in cores:
        shared = [(first, last) for core, first, last in mine if met[core] > 1]
        found.append((min(x for x, _ in shared), max(x for _, x in shared)) if shared else None)
    return found


def sort_shards(segs: DataFrame, shards: int, rule: RepeatRule) -> DataFrame:
    """(key, seg, runs): windows that the distinct segments of a key share. ``segs``: key, seg, at, body."""
    dealt = segs.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).repartition(shards, "shard").sortWithinPartitions("shard", "key", "seg")

    def solve(rows):
        near = [(k, s, x, body) for (k, s, _, body), x in zip(rows, possible_windows(rows, rule), strict=True) if x]
        hits = shared_windows([body[a : b + rule.length] for _, _, (a, b), body in near], rule.length) if near else []
        got = [(k, s, [{"lo": r["lo"] + a, "n": r["n"]} for r in _runs(h)]) for (k, s, (a, _), _), h in zip(near, hits, strict=True) if h.any()]
        return {"key": [g[0] for g in got], "seg": [g[1] for g in got], "runs": [g[2] for g in got]}

    def run(batches):
        shard, held = None, []
        for batch in batches:
            for s, *row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "key", "seg", "at", "body")), strict=True):
                if s != shard and held:
                    yield solve(held)
                    held = []
                shard = s
                held.append(row)
        if held:
            yield solve(held)

    return by_batch(dealt, f"key long, seg long, runs {RUNS}", run)


def cut_blocks(segs: DataFrame, windows: int, rule: RepeatRule) -> DataFrame:
    """Blocks of at most ``windows`` windows of each segment, under keys that equal windows share.

    All windows of a block contain its core, so its hash belongs to the key. Adds the block's place in its segment.
    """

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("key", "seg", "body", "at", "copies", "parent_key", "parent", "lo", "n")}
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "seg", "body", "at", "copies"))
            for key, seg, body, at, copies in zip(*columns, strict=True):
                n = len(body) - rule.length + 1
                for block in range((at - n + 1) // windows, at // windows + 1):
                    # The window at offset x holds the k-gram at at - x.
                    a, b = max(0, at - (block + 1) * windows + 1), min(n - 1, at - block * windows)
                    core = body[at - block * windows : at - (block + 1) * windows + 1 + rule.length]
                    piece = body[a : b + rule.length]
                    sign = hashlib.blake2b(core, digest_size=8, salt=(key & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little") + (block & 0xFFFFFFFF).to_bytes(8, "little")).digest()
                    for name, value in (
                        ("key", int.from_bytes(sign, "little", signed=True)), ("seg", int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True)),
                        ("body", piece), ("at", at - a), ("copies", copies), ("parent_key", key), ("parent", seg), ("lo", a), ("n", b - a + 1),
                    ):
                        out[name].append(value)
            yield out

    return by_batch(segs, "key long, seg long, body binary, at int, copies long, parent_key long, parent long, lo int, n int", run)


def shared_runs(segs: DataFrame, rule: RepeatRule, depth: int = 0) -> DataFrame:
    """(key, seg, runs) of windows that other segments of the same key also have.

    ``segs``: one row per distinct (key, seg) with body, at and copies; only keys with several segments.
    """
    per_key = segs.groupBy("key").agg(F.count(F.lit(1)).alias("segs"), F.sum(F.octet_length("body")).alias("bytes"))
    sizes = stage(per_key, "keys")
    total = sizes.filter(F.col("segs") <= rule.key_segments).agg(F.sum("bytes")).head()[0] or 0
    hot = sizes.filter(F.col("segs") > rule.key_segments).select("key")
    if hot.isEmpty():
        return sort_shards(segs.select("key", "seg", "at", "body"), 1 + total // rule.shard_bytes, rule)
    usual = segs.join(hot, "key", "left_anti")
    found = sort_shards(usual.select("key", "seg", "at", "body"), 1 + total // rule.shard_bytes, rule)
    blocks = stage(cut_blocks(segs.join(hot, "key"), rule.blocks[depth], rule), "blocks")
    distinct = blocks.groupBy("key", "seg").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("parents"), F.first("body").alias("body"), F.first("at").alias("at"), F.first("n").alias("n"))
    distinct = stage(distinct, "blocks")
    again = distinct.filter("parents > 1").select("key", "seg", F.array(F.struct(F.lit(0).alias("lo"), F.col("n"))).alias("runs"))
    if rule.blocks[depth] > 1:
        several = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key")
        again = again.unionByName(shared_runs(distinct.join(several, "key").drop("parents", "n"), rule, depth + 1))
    back = blocks.select("key", "seg", "parent_key", "parent", F.col("lo").alias("base")).join(again, ["key", "seg"])
    moved = F.transform("runs", lambda r: F.struct((r.lo + F.col("base")).alias("lo"), r.n.alias("n")))
    return found.unionByName(back.select(F.col("parent_key").alias("key"), F.col("parent").alias("seg"), moved.alias("runs")))


def repeated_starts(texts: DataFrame, rule: RepeatRule = RepeatRule()) -> DataFrame:
    """(tid, starts): runs (start, n) of windows of each text that also start elsewhere. ``texts``: tid, body."""
    groups = stage(find_groups(texts, rule), "groups")
    met = groups.groupBy("whole", "lead").agg(F.count(F.lit(1)).alias("k"), F.min(F.xxhash64("tid", "start")).alias("one"))
    again = stage(met.filter("k > 1").drop("k"), "again")
    settled = groups.select("whole", "lead", "tid", F.struct("start", F.col("windows").alias("n")).alias("x")).join(again, ["whole", "lead"], "left_semi")
    segments = stage(single_segments(groups, again), "segments")
    keys = segments.groupBy("key").agg(F.sum("weight").alias("k"), F.min("seg").alias("least"), F.max("seg").alias("most")).filter("k > 1")
    keys = stage(keys.select("key", (F.col("least") == F.col("most")).alias("same")), "shared")
    shared = segments.join(keys, "key")
    # Distinct segments of keys with several: counted before they meet.
    mixed = stage(
        shared.filter("NOT same").groupBy("key", "seg").agg(F.sum("weight").alias("copies"), F.min(F.struct("tid", "start", "n", "at")).alias("one"))
        .select("key", "seg", "copies", "one.*"), "mixed")
    wanted = mixed.groupBy("tid").agg(F.collect_list(F.struct("key", "seg", "copies", "start", "n", "at")).alias("want"))
    once = texts.groupBy("tid").agg(F.first("body").alias("body"))

    def extract(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                out: dict[str, list] = {c: [] for c in ("key", "seg", "copies", "at", "body")}
                for want, body in zip(part.column(part.schema.get_field_index("want")).to_pylist(), part.column(part.schema.get_field_index("body")).to_pylist(), strict=True):
                    for w in want:
                        for c in ("key", "seg", "copies", "at"):
                            out[c].append(w[c])
                        out["body"].append(body[w["start"] : w["start"] + w["n"] + rule.length - 1])
                yield out

    bodies = stage(by_batch(once.join(wanted, "tid"), "key long, seg long, copies long, at int, body binary", extract), "bodies")
    runs = shared_runs(bodies, rule)
    full = mixed.filter("copies > 1").select("key", "seg", F.lit(None).cast(RUNS).alias("runs"))
    partial = runs.join(full.select("key", "seg"), ["key", "seg"], "left_anti")
    hits = segments.filter("weight = 1").join(full.unionByName(partial), ["key", "seg"]).select("tid", F.explode(F.coalesce(
        F.transform("runs", lambda r: F.struct((F.col("start") + r.lo).alias("start"), r.n.alias("n"))), F.array(F.struct("start", "n")))).alias("x"))
    whole = shared.filter("same AND weight = 1").select("tid", F.struct("start", "n").alias("x"))
    return hits.unionByName(whole).unionByName(settled.select("tid", "x")).groupBy("tid", "x").agg(F.lit(1)).groupBy("tid").agg(F.sort_array(F.collect_list("x")).alias("starts"))


def covered(starts: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte spans under the windows."""
    out: list[list[int]] = []
    for s in starts or ():
        a, b = s["start"], s["start"] + s["n"] + length - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def with_starts(docs: DataFrame, rule: RepeatRule, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``starts`` (null: nothing repeats)."""
    keyed = docs.withColumn("__tid", text_id(F.col(f"`{text}`")))
    texts = keyed.select(F.col("__tid").alias("tid"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("body"))
    found = repeated_starts(texts, rule).withColumnsRenamed({"tid": "__tid", "starts": "__starts"})
    return keyed.join(found, "__tid", "left").drop("__tid")


def keep_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    cut, at = [], 0
    for a, b in spans:
        cut.append(raw[at:a])
        at = b
    return b"".join([*cut, raw[at:]])


def _char_spans(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without characters that are only partly inside."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, rule: RepeatRule = RepeatRule(), text: str = "text", count: str | None = None) -> DataFrame:
    """All rows and columns of ``docs``, repeated bytes removed from ``text``; characters cut by a span stay whole.

    ``count`` names a column of ``docs`` that holds the text's length and follows it.
    """
    given = with_starts(docs, rule, text)

    def run(texts, starts):
        out = []
        for t, s in zip(texts, starts, strict=True):
            raw = (t or "").encode()
            out.append(keep_bytes(raw, _char_spans(raw, covered(s, rule.length))).decode() if s else t)
        return {text: out}

    kept = add_columns(given, (text, "__starts"), f"`{text}` string", run)
    if count in docs.columns:
        kept = kept.withColumn(count, F.length(F.col(f"`{text}`")).cast(docs.schema[count].dataType))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def repeat_report(docs: DataFrame, rule: RepeatRule = RepeatRule(), text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the removed spans and the digest of what stays."""
    given = with_starts(docs, rule, text)

    def run(texts, starts):
        got: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for t, s in zip(texts, starts, strict=True):
            raw = (t or "").encode()
            spans = covered(s, rule.length)
            for c, v in zip(got, (len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(keep_bytes(raw, spans)).hexdigest(), [{"start": a, "end": b} for a, b in spans]), strict=True):
                got[c].append(v)
        return got

    return add_columns(given, (text, "__starts"), DIGEST, run).drop("__starts")
