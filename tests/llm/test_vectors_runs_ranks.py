"""Projection forest, periodic runs and importance resampling against brute force, with their edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwarden.llm import importance_radix, periodic_runs, projection_forest
from pitwarden.llm.recompression import common_extension, grammar

VECTORS = "vec_id long, embedding array<double>, label int, n_links string, cid int"
DOCS = "doc_id long, text string, rank string, runs int"


def linked(rows, least=0.93):
    """{vec_id: (links, smallest reachable id)} by comparing all pairs; rows of (vec_id, embedding, label), ids distinct."""
    able = [(i, np.array(e, float) / np.abs(e).max(), label) for i, e, label in rows if label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    near = {i: set() for i, *_ in rows}
    for i, x, a in able:
        for j, y, b in able:
            if i < j and a == b and len(x) == len(y) and float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)) >= least:
                near[i].add(j)
                near[j].add(i)
    low = {}
    for i in sorted(near):
        todo = [i] if i not in low else []
        while todo:
            k = todo.pop()
            if k not in low:
                low[k] = i
                todo += near[k]
    return {i: (len(near[i]), low[i]) for i in near}


def planted_vectors():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist(), i % 3) for i in range(300)]
    for k in range(40):  # a group of near copies, some of them equal, across two labels
        rows.append((1000 + k, (np.array(rows[7][1]) + (k % 9 > 0) * rng.normal(size=16) * 0.05).tolist(), 1 if k % 4 else 2))
    chain = rng.normal(size=(2, 16))
    for k in range(20):  # neighbours are alike, the ends are not
        rows.append((2000 + k, (math.cos(k / 4) * chain[0] + math.sin(k / 4) * chain[1]).tolist(), 0))
    base = rows[3][1]
    rows += [(3000, None, 0), (3001, [], 0), (3002, [0.0] * 16, 0), (3003, [math.nan] + base[1:], 0), (3004, [None] + base[1:], 0), (3005, [math.inf] + base[1:], 0),
             (3006, base, None), (3007, [x * 1e200 for x in base], 0), (3008, [x * 1e-200 for x in base], 0), (3009, base[:15], 0), (3010, [-x for x in base], 0), (3011, base, 0)]
    return rows


@pytest.mark.parametrize("rule", [
    projection_forest.ForestRule(leaf=8, trees=12, least=4), projection_forest.ForestRule(leaf=1000, block=16), projection_forest.ForestRule(leaf=64, block=7)], ids=["deep", "blocks", "both"])
def test_forest_equals_all_pairs(spark, rule):
    rows = planted_vectors()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id) for r in projection_forest.near_vectors(table, rule).collect()}
    assert got == linked(rows)


def test_forest_recall_at_the_bound(spark):
    rng = np.random.default_rng(0)
    n, c = 3000, 0.931
    one = rng.normal(size=(n, 64))
    one /= np.linalg.norm(one, axis=1)[:, None]
    off = rng.normal(size=(n, 64))
    off -= (off * one).sum(axis=1)[:, None] * one
    two = c * one + math.sqrt(1 - c * c) * off / np.linalg.norm(off, axis=1)[:, None]
    table = spark.createDataFrame([(i, x.tolist(), 1, None, None) for i, x in enumerate(np.r_[one, two])], VECTORS).repartition(4)
    got = projection_forest.near_vectors(table, projection_forest.ForestRule(leaf=64)).filter("n_links = 1").count()
    assert got >= 0.999 * 2 * n


def test_forest_of_repeated_and_missing_ids(spark):
    table = spark.createDataFrame([(5, [1.0, 0.0], 1, None, None), (5, [1.0, 0.0], 1, None, None), (None, [1.0, 0.01], 1, None, None), (None, None, 1, None, None)], VECTORS)
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in projection_forest.near_vectors(table).collect())
    assert got == sorted([("5", 2, 5, True), ("5", 2, 5, True), ("None", 2, 5, False), ("None", 0, None, True)])
    empty = projection_forest.near_vectors(table.limit(0))
    assert empty.columns == ["vec_id", "n_links", "component_id", "kept"] and empty.count() == 0


def test_codes_never_hide_a_pair():
    rng = np.random.default_rng(3)
    packed = [projection_forest._packed(v) for v in rng.normal(size=(50, 24))]
    unit = projection_forest._units(packed, 24)
    code, scale, slack = projection_forest._codes(packed, [24] * 50)
    value = np.frombuffer(b"".join(code), np.int8).reshape(50, 24) * scale[:, None]
    assert (value @ value.T + slack[:, None] * (1 + slack) + slack + 1e-6 >= unit @ unit.T).all()


def all_runs(s):
    """{(start, length, smallest period)} by walking every period."""
    found = {}
    for q in range(1, len(s) // 4 + 1):
        i = 0
        while i + q < len(s):
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def looping(rng):
    s = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 90))]
    for _ in range(rng.randint(0, 3)):
        if s:
            a = rng.randrange(len(s))
            p = 1 + rng.randrange(1 + (len(s) - a) // 3)
            for i in range(a, rng.randint(a, len(s))):
                s[i] = s[a + (i - a) % p]
    return s


def test_runs_equal_all_periods():
    rng = random.Random(2)
    texts = [looping(rng) for _ in range(600)]
    for lo in range(0, 600, 20):
        got = periodic_runs.runs([np.array(s, np.int64) for s in texts[lo : lo + 20]])
        assert [list(map(tuple, g.tolist())) for g in got] == [all_runs(s) for s in texts[lo : lo + 20]]


def test_runs_of_long_texts_in_pieces(monkeypatch):
    rng = random.Random(3)
    s = [rng.randrange(50) for _ in range(900)]
    s[100:300] = [s[100 + i % 37] for i in range(200)]
    s[400:800] = [s[400 + i % 99] for i in range(400)]
    whole = periodic_runs.runs([np.array(s)])[0].tolist()
    monkeypatch.setattr(periodic_runs, "SMALL", 100)
    monkeypatch.setattr(periodic_runs, "GRID", 500)
    assert periodic_runs.runs([np.array(s)])[0].tolist() == whole == list(map(list, all_runs(s)))
    assert [q for _, _, q in whole] == [37, 99]


def test_grammar_extensions():
    rng = random.Random(4)
    for _ in range(200):
        s = looping(rng)
        if len(s) < 2:
            continue
        i = np.array([rng.randrange(len(s) - 1) for _ in range(20)])
        j = np.array([rng.randint(x + 1, len(s)) for x in i])
        expected = [next((k for k in range(len(s)) if b + k >= len(s) or s[a + k] != s[b + k]), 0) for a, b in zip(i, j, strict=True)]
        assert common_extension(grammar(np.array(s)), i, j).tolist() == expected


def test_run_report(spark):
    rng = random.Random(6)
    rows = [(i, " \t".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 7, 60, 300]))), None, 1) for i in range(120)]
    rows += [(500, "a a a a a a b", None, 1), (501, "a a a a a", None, 1), (502, None, None, 1), (503, " \n", None, 1), (None, "x y x y x y x y", None, 1), (504, "é \U0001f642 " * 9000, None, 1), (500, "a a a a a a b", None, 1)]
    table = spark.createDataFrame(rows, DOCS)
    got = sorted(map(str, periodic_runs.run_report(table).collect()))

    def row(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = all_runs(words) if n < 1000 else [(0, n, 2)]
        dropped = {k for a, length, q in found for k in range(a + q, a + length)}
        start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return (i, len(found), start, length, period, found and 1000 * length // period or None, sha("".join(f"{a},{m},{q}\n" for a, m, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in dropped)))

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    wanted = [row(i, t) for i, t, *_ in rows]
    assert got == sorted("Row(" + ", ".join(f"{c}={v!r}" for c, v in zip(names, w, strict=True)) + ")" for w in wanted)
    assert sum(w[1] for w in wanted) > 5 and periodic_runs.run_report(table.limit(0)).count() == 0
    kept = periodic_runs.find_runs(table)
    assert kept.columns == ["doc_id", "text", "rank", "runs", "collapsed"] and kept.filter("collapsed = 'a b'").count() == 2


def expected_ranks(docs, target, percent=5):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    buckets = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    own = [buckets(fold(t)) for _, t in docs]
    wanted = [b for t in target for b in buckets(fold(t))]
    s, t = np.bincount([b for o in own for b in o], minlength=10000), np.bincount(wanted, minlength=10000)
    big_s, big_t = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (big_s + 10000) / ((int(s[b]) + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for (i, text), o in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in o)
        rows.append([i, len(o), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(fold(text))])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted((str(r[0]), *r[1:4], rank.get(id(r), 0)) for r in rows)


def test_resampling_equals_brute_force(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["Tax", "form", "ÄRGER", "x9", "the-law", "of", "plain"]) + rng.choice("abcde") for _ in range(n))
    docs = [(i, text(rng.choice([3, 19, 20, 40, 200]))) for i in range(300)]
    docs += [(-7, text(50)), (1 << 62, text(50)), (-(1 << 62), text(50)), (600, None), (601, ""), (602, "--"), (None, text(30)), (603, text(70_000)), (5, docs[5][1]), (5, docs[5][1] + " more")]
    target = [text(30), None, "", "tax forma " * 30]
    table = spark.createDataFrame([(*d, None, 1) for d in docs], DOCS).repartition(6)
    rule = importance_radix.ResampleRule(percent=60)
    result = importance_radix.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), rule)
    assert result.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = sorted((str(r.doc_id), r.n_features, r.weight, r.score, r["rank"] or 0) for r in result.collect())
    assert got == expected_ranks(docs, target, 60)
    assert importance_radix.resample(table.limit(0), table.select("text").limit(0)).count() == 0
    assert importance_radix.resample(table, table.select("text").limit(0)).filter("rank = 1").count() == 1


@pytest.mark.parametrize(("width", "block"), [(9, 16), (12, 1 << 16)])
def test_radix_sort(spark, width, block):
    rng = random.Random(9)
    rows = [(rng.choice([None, -(1 << 63), (1 << 63) - 1, *range(-40, 40)]), rng.randrange(3), i) for i in range(500)] + [(1, 1, 900)] * 200
    table = spark.createDataFrame(rows, "a long, b long, c long").repartition(7)
    got = [(r.a, r.b) for r in sorted(importance_radix.radix_sort(table, [("a", True), ("b", False)], width=width, block=block).collect(), key=lambda r: r.place)]
    assert got == sorted([(a, b) for a, b, _ in rows], key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    same = importance_radix.radix_sort(table.withColumn("a", F.lit(4).cast("long")), [("a", True)], width=width, block=block)
    assert sorted(r.place for r in same.collect()) == list(range(700))
