import random

from pyspark.sql import functions as F

from pitwarden.functions.exprs import norm_cdf, order_tag, top_abs
from pitwarden.operators.asof import asof_next, asof_previous, range_sums
from pitwarden.operators.components import connected_components
from pitwarden.operators.islands import number_islands, number_segments
from pitwarden.operators.ranges import overlap_join


def points(spark, seed=1):
    rnd = random.Random(seed)
    pts = sorted({(rnd.choice("ab"), rnd.randrange(-500, 20000)) for _ in range(150)})
    return pts, spark.createDataFrame([(k, t, float(t) * 2) for k, t in pts], "k string, t long, v double")


def test_asof_both_ways(spark):
    pts, df = points(spark)
    rnd = random.Random(2)
    qs = [(rnd.choice("abc"), rnd.randrange(-600, 21000)) for _ in range(200)]
    q = spark.createDataFrame([(i, *x) for i, x in enumerate(qs)], "i int, k string, t long")
    back = {r["i"]: r["v"] for r in asof_previous(q, df, ["k"], "t", ["v"], bucket_ticks=700).collect()}
    ahead = {r["i"]: r["v"] for r in asof_next(q, df, ["k"], "t", ["v"], bucket_ticks=700).collect()}
    for i, (k, t) in enumerate(qs):
        before, after = [p for kk, p in pts if kk == k and p <= t], [p for kk, p in pts if kk == k and p >= t]
        assert back[i] == (2.0 * before[-1] if before else None)
        assert ahead[i] == (2.0 * after[0] if after else None)


def test_range_sums(spark):
    pts, df = points(spark, 4)
    rnd = random.Random(5)
    qs = [(rnd.choice("ab"), lo := rnd.randrange(20000), lo + rnd.randrange(-50, 3000)) for _ in range(100)]
    q = spark.createDataFrame([(i, *x) for i, x in enumerate(qs)], "i int, k string, lo long, hi long")
    got = {r["i"]: r["v"] for r in range_sums(q, df.withColumnRenamed("t", "tick"), ["k"], "lo", "hi", ["v"], 900).collect()}
    for i, (k, lo, hi) in enumerate(qs):
        assert abs(got[i] - sum(2.0 * p for kk, p in pts if kk == k and lo <= p <= hi)) < 1e-6


def test_overlap_join_pairs_once(spark):
    rnd = random.Random(7)
    a = [(rnd.choice("xy"), s := rnd.randrange(3000), s + rnd.randrange(900)) for _ in range(60)]
    b = [(rnd.choice("xy"), s := rnd.randrange(3000), s + rnd.randrange(900)) for _ in range(60)]
    left = spark.createDataFrame([(i, *x) for i, x in enumerate(a)], "i int, k string, s long, e long")
    right = spark.createDataFrame([(j, *x) for j, x in enumerate(b)], "j int, k string, s2 long, e2 long")
    got = sorted((r["i"], r["j"]) for r in overlap_join(left, right, ["k"], ("s", "e"), ("s2", "e2"), width=100, slack=5).collect())
    want = sorted((i, j) for i, (k, s, e) in enumerate(a) for j, (k2, s2, e2) in enumerate(b) if k == k2 and s - 5 <= e2 and e + 5 >= s2)
    assert got == want


def test_components_match_union_find(spark):
    rnd = random.Random(9)
    edges = [(w, f"n{rnd.randrange(60):02d}", f"n{rnd.randrange(60):02d}") for w in (1, 2) for _ in range(45)] + [(3, f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    got = {(r["w"], r["node"]): r["component"] for r in connected_components(spark.createDataFrame(edges, "w int, a string, b string"), ["w"], "a", "b").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for w, a, b in edges:
        if a != b:
            x, y = find((w, a)), find((w, b))
            parent[max(x, y)] = min(x, y)
    assert got == {n: find(n)[1] for n in parent}


def test_islands_and_segments(spark):
    m = spark.createDataFrame([("g", x) for x in (0, 1, 2, 60, 61)], "c string, m long")
    assert [r["segment"] for r in number_segments(m, ["c"], "m", 10).orderBy("m").collect()] == [1, 1, 1, 2, 2]
    w = spark.createDataFrame([("g", 0, 100), ("g", 10, 20), ("g", 101, 120), ("g", 122, 130)], "c string, s long, e long")
    assert [r["island"] for r in number_islands(w, ["c"], "s", "e", 1).orderBy("s").collect()] == [1, 1, 1, 2]


def test_expressions(spark):
    r = spark.range(1).select(
        norm_cdf(F.lit(1.0)).alias("a"), norm_cdf(F.lit(-1.96)).alias("b"), order_tag(F.lit("ord-12sg")).alias("t"), order_tag(F.lit("plain")).alias("u"),
        top_abs(F.create_map(F.lit("x"), F.lit(-5.0), F.lit("y"), F.lit(1.0), F.lit("z"), F.lit(3.0)), 2).alias("m"),
    ).first()
    assert abs(r["a"] - 0.8413447) < 1e-6 and abs(r["b"] - 0.0249979) < 1e-6
    assert (r["t"], r["u"], r["m"]) == ("sg", "", {"x": -5.0, "z": 3.0})
