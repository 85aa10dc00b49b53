"""Fills are brought to the orders of a case only where one of them rested (F6, F7)."""

import random

import pytest

from test_case_spans import nodes

from pitwarden.operators import asof, evidence as ev


def test_points_near_spans_hold_all_inside(spark):
    rng = random.Random(1)
    points = spark.createDataFrame([(rng.choice("ab"), t) for t in range(-300, 3000, 3)], "k string, tick long")
    spans = [("a", -100, -70), ("a", 60, 70), ("b", 1000, 1200), ("b", 50, 40), ("c", 0, 500)]
    got = {(r.k, r.tick) for r in asof.near_points(points, spark.createDataFrame(spans, "k string, lo long, hi long"), ["k"], "lo", "hi").collect()}
    asked = {(r.k, r.tick) for r in points.collect()}
    inside = {p for p in asked if any(k == p[0] and lo <= p[1] <= hi for k, lo, hi in spans)}
    near = {p for p in asked if any(k == p[0] and lo // 64 <= p[1] // 64 <= hi // 64 for k, lo, hi in spans if lo <= hi)}
    assert inside <= got and got == near


@pytest.mark.parametrize(("facts", "persona"), [(ev.spoofing_facts, "spoofing"), (lambda *a: ev.layering_facts(*a, min_levels=2), "layering")])
def test_only_fills_near_resting_orders_are_summed(spark, make, monkeypatch, facts, persona):
    trades = make.trades([(t, 100, 5, "sp", f"m{t % 7}", "buy") for t in range(0, 6000, 10)])
    small = [(f"o{i}", "sp", "buy", 99, 10, 100 + i, "placed") for i in range(9)]
    orders = make.orders([*small, ("big", "sp", "sell", 101, 400, 110, "placed"), ("big2", "sp", "sell", 102, 400, 110, "placed"),
                          ("big", "sp", "sell", 101, 400, 121, "cancelled"), ("big2", "sp", "sell", 102, 400, 121, "cancelled")])
    cases = spark.createDataFrame([("c1", "gold", "sp", persona, 90, 300)], "case_id string, commodity string, trader_id string, persona string, start_tick long, end_tick long")
    seen, whole = [], ev.range_sums
    monkeypatch.setattr(ev, "range_sums", lambda q, p, *a, **k: seen.append(p.count()) or whole(q, p, *a, **k))
    r = facts(cases, trades, orders).first()
    assert seen and max(seen) <= 20  # of 600 fills of the account
    if persona == "spoofing":
        # Each rested over 110 and 120; the fills right after the cancel at 121 begin at 130.
        assert (r.large_orders_cancelled, r.large_orders_with_opposite_side_fill_while_resting, r.opposite_side_volume_filled) == (2, 2, 20)
    else:
        assert (r.multi_level_batches, r.batches_with_opposite_side_fill_while_resting) == (1, 1)


def test_pairs_of_single_baits_are_not_shuffled(spark, make):
    """F8: every pair of bait and partner was shuffled to be counted, also where a bait account had one bait in the step."""
    from pitwarden.config import FeatureConfig
    from pitwarden.operators import features as ft, linked

    cfg, n = FeatureConfig(), 40
    orders = [(f"n{i}", "n", "buy", 100, 10, i, "placed") for i in range(0, 300, 3)]
    orders += [r for i in range(n) for r in ((f"s{i}", f"A{i}", "buy", 99, 900, 200, "placed"), (f"s{i}", f"A{i}", "buy", 99, 900, 205, "cancelled"))]
    orders += [(f"t{j}", "A0", "buy", 99, 900, 201, e) for j, e in enumerate(("placed",))] + [("t0", "A0", "buy", 99, 900, 206, "cancelled")]
    orders += [(f"p{i}", f"P{i}", "sell", 101, 10, 200, "placed") for i in range(n)]
    t = ft.build_steps(make.trades([(202, 100, 10, "n", f"P{i}", "buy") for i in range(n)]), make.orders(orders), cfg)
    out = linked.linked_pair_steps(t.bait, t.legs, t.placed, cfg)
    got = {(r.trader_id, r.cpty): r.n_ev for r in out.collect()}
    assert got == {(f"A{i}", f"P{j}"): 2.0 if i == 0 else 1.0 for i in range(n) for j in range(n)}
    sent = [p.metrics().apply("shuffleRecordsWritten").value() for kind, p in nodes(out._jdf.queryExecution().executedPlan()) if kind == "ShuffleExchangeExec"]
    assert max(sent, default=0) <= 3 * n, sent
