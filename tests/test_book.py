"""Best prices, depth and inversions of small random books against a replay tick by tick."""

import random

import pytest
from pyspark.sql import functions as F

from pitwarden.operators import book as bk
from tests.conftest import ORDER


def random_orders(seed, n=160, ticks=300, cross=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        side, start, q = rng.choice(["buy", "sell"]), rng.randrange(ticks), rng.randint(4, 30)
        price = 1000 + (-1 if side == "buy" else 1) * (0.5 + rng.randrange(12) / 2) + (rng.random() < 0.05) * cross * (4 if side == "buy" else -4)
        oid = f"o{i}{rng.choice(['s', 'l', '', 'g'])}"
        rows.append((oid, "gold", f"a{i % 4}", side, price, q, start, "placed"))
        left, at = q, start
        for _ in range(rng.randint(0, 2)):
            part = rng.randint(1, max(1, left // 2))
            at += rng.randrange(9)
            left -= part
            rows.append((oid, "gold", f"a{i % 4}", None, None, part, at, "partial_fill"))
        if rng.random() < 0.9:
            rows.append((oid, "gold", f"a{i % 4}", None, None, left, at + rng.randrange(60), rng.choice(["filled", "cancelled"])))
    return rows


def replay(rows, upto):
    """{order: (side, price, rest)} of what rests when all events of ticks <= upto are done."""
    book = {}
    for oid, _, _, side, price, q, t, kind in sorted(rows, key=lambda r: r[6]):
        if t <= upto and kind == "placed":
            book[oid] = [side, price, q]
    for oid, _, _, _, _, q, t, kind in rows:
        if t <= upto and kind == "partial_fill":
            book[oid][2] -= q
    for oid, *_, t, kind in rows:
        if t <= upto and kind in ("filled", "cancelled"):
            book.pop(oid, None)
    return book


def touch(book):
    bids, asks = ([p for s, p, _ in book.values() if s == side] for side in ("buy", "sell"))
    return max(bids, default=None), min(asks, default=None)


@pytest.mark.parametrize("bits", [3, 9])
def test_best_prices_equal_a_replay(spark, monkeypatch, bits):
    rows = random_orders(1)
    orders = spark.createDataFrame(rows, ORDER)
    monkeypatch.setattr(bk.live_extreme, "__defaults__", (bits,))
    points = spark.range(-3, 420).select(F.lit("gold").alias("commodity"), F.col("id").alias("tick"))
    got = {r["at"]: (r.bid, r.ask) for r in bk.best_prices(points, bk.resting_orders(orders)).collect()}
    assert got == {t: touch(replay(rows, t)) for t in range(-3, 420)}


@pytest.mark.parametrize("bits", [3, 9])
def test_depth_equals_a_replay(spark, monkeypatch, bits):
    rows = random_orders(2)
    monkeypatch.setattr(bk.sums_before, "__defaults__", (bits,))
    got = {(r.trader_id, r.side, r.tick): (r.mid, r.legs, r.placed, r.existing, r.share) for r in bk.near_touch_depth(spark.createDataFrame(rows, ORDER)).collect()}
    batches = {}
    for oid, _, who, side, price, q, t, kind in rows:
        if kind == "placed" and oid[-1] in "sl":
            batches.setdefault((who, side, t), []).append((price, q))
    expected = {}
    for (who, side, t), legs in batches.items():
        book = replay(rows, t - 1)
        bid, ask = touch(book)
        mid = (bid + ask) / 2 if bid is not None and ask is not None else None
        placed = sum(q for p, q in legs if mid and abs(p - mid) / mid <= 0.002)
        inside = [q for s, p, q in book.values() if mid and s == side and (p >= mid * 0.998 if side == "buy" else p <= mid * 1.002)]
        expected[who, side, t] = (mid, len(legs), placed, sum(inside), placed / (sum(inside) + placed) if mid and sum(inside) + placed else 0.0)
    assert got == expected and sum(x[4] > 0 for x in got.values()) > 10


def test_planted_inversions(spark):
    calm = [r for r in random_orders(3, cross=False)]
    crossed = [*calm, ("x1", "gold", "a9", "buy", 1020.0, 5, 100, "placed"), ("x1", "gold", "a9", None, None, 5, 104, "cancelled")]
    assert bk.inverted_book(spark.createDataFrame(calm, ORDER)).first().n_inverted == 0
    got = bk.inverted_book(spark.createDataFrame(crossed, ORDER)).first()
    ticks = {r[6] for r in crossed}
    assert got.first_inverted == 100 and got.n_inverted == len([t for t in ticks if 100 <= t < 104]) and got.n_ticks == len(ticks) and got.deepest > 0
    assert bk.inverted_book(spark.createDataFrame([], ORDER)).count() == 0


def test_depth_of_nothing(spark):
    assert bk.near_touch_depth(spark.createDataFrame([], ORDER)).count() == 0
