"""Window stages that shuffle step rows once, against their definitions."""

import random

from pyspark.sql import functions as F

from pitwarden.config import FeatureConfig
from pitwarden.operators import features as ft, linked, rings, windows

CFG = FeatureConfig()
PAIR = "commodity string, step long, trader_id string, cpty string, v double, m double"


def random_steps(seed, n, last):
    rnd = random.Random(seed)
    return [("gold", rnd.randrange(last + 1), f"a{rnd.randrange(3)}", f"b{rnd.randrange(3)}", float(rnd.randrange(1, 9)), float(rnd.randrange(9))) for _ in range(n)]


def test_windows_of_both_forms_match_the_definition(spark):
    """Gaps, several rows of one step and windows beside the edges of blocks."""
    last = 130
    rows = random_steps(1, 160, last)
    df = spark.createDataFrame(rows, PAIR)
    bounds = spark.createDataFrame([("gold", 0, last)], "commodity string, first_step long, last_step long")
    want = {}
    for w in range(CFG.n_steps - 1, last + 1):
        for _, s, a, b, v, m in rows:
            if w - CFG.n_steps < s <= w:
                total, top = want.get((w, a, b), (0.0, 0.0))
                want[w, a, b] = total + v, max(top, m)
    for by in (None, ["trader_id"]):
        out = windows.to_windows(df, bounds, ["trader_id", "cpty"], ["v"], ["m"], CFG, by).collect()
        assert len(out) == len(want)
        assert {(r["win"], r["trader_id"], r["cpty"]): (r["v"], r["m"]) for r in out} == want


def test_rows_are_repeated_for_their_windows_after_the_shuffle(spark):
    df = spark.createDataFrame(random_steps(2, 50, 60), PAIR)
    bounds = F.broadcast(spark.createDataFrame([("gold", 0, 60)], "commodity string, first_step long, last_step long"))
    for by in (None, ["trader_id"]):
        out = windows.to_windows(df, bounds, ["trader_id", "cpty"], ["v"], [], CFG, by)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Generate") < plan.index("Exchange hashpartitioning"), plan
    pairs = windows.pair_windows(df.withColumnsRenamed({"v": "bought", "m": "sold"}), bounds, CFG)
    plan = windows.counterparty_summary(pairs, CFG)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_mutual_pairs_keep_only_accounts_with_a_mutual_partner(spark):
    rows = [("gold", 5, "x", "y", 90.0, 0.0), ("gold", 5, "y", "x", 0.0, 90.0), ("gold", 5, "x", "z", 5.0, 5.0), ("gold", 5, "z", "x", 5.0, 5.0)]
    pw = spark.createDataFrame(rows, "commodity string, win long, trader_id string, cpty string, bought double, sold double")
    base = spark.createDataFrame([("gold", 5, 10.0)], "commodity string, win long, size_baseline double")
    got = {(r["trader_id"], r["cpty"]): (round(r["share"], 3), r["mutual"]) for r in rings.mutual_pairs(pw, base, CFG).collect()}
    assert got == {("x", "y"): (0.9, True), ("x", "z"): (0.1, False), ("y", "x"): (1.0, True)}


def link_log(make):
    """Accounts that spoof over and over; partners fill on the other side."""
    rnd = random.Random(7)
    orders, prints = [(f"n{i}", "n", "buy", 100, 10, i, "placed") for i in range(0, 600, 3)], []
    for i in range(70):
        at, a, b = rnd.randrange(40, 580), rnd.choice("ABC"), rnd.choice("PQ")
        orders += [(f"s{i}", a, "buy", 99, 900, at, "placed"), (f"s{i}", a, "buy", 99, 900, at + rnd.randrange(9), "cancelled")]
        orders += [(f"p{i}", b, "sell", 101, 10, at + rnd.randrange(-1, 2), "placed")]
        prints += [(at + rnd.randrange(4), 100, 10, rnd.choice("nAB"), b, "buy")]
    return make.trades(prints), make.orders(orders)


def test_links_equal_those_from_all_pairs(make):
    trades, orders = link_log(make)
    t, k = ft.build_steps(trades, orders, CFG), ["commodity", "win"]
    events = windows.to_windows(linked.linked_pair_steps(t.bait, t.legs, t.placed, CFG), t.bounds, ["trader_id", "cpty"], ["n_ev"], [], CFG)
    rates = windows.to_windows(linked.rate_steps(t.bait, t.legs, t.placed, CFG), t.bounds, ["trader_id"], list(linked.RATE_COLUMNS), [], CFG)
    totals = events.groupBy(*k, "cpty").agg(F.sum("n_ev").alias("ev_b"))
    large = rates.groupBy(*k).agg(F.sum(F.col("lc_buy") + F.col("lc_sell")).alias("lc_all"))
    whole = linked.linked_features(events.filter(f"n_ev >= {ft.LINK_MIN_EVENTS}"), totals, large, rates, CFG)

    def values(df):
        return {(r["win"], r["trader_id"]): (round(r[2], 9), round(r[3], 9)) for r in df.select("win", "trader_id", "linked_spoof_signature", "linked_lift_log").collect()}

    got, want = values(ft.link_features(t, CFG)), values(whole)
    assert got == want and any(s > 0.1 for s, _ in want.values())


def test_fill_lookup_of_partners_does_not_grow_with_baits(make, monkeypatch):
    """The rows that ask for a partner's next fill are placements, however many baits stand beside one."""
    asked = []
    real = linked.asof_next
    monkeypatch.setattr(linked, "asof_next", lambda q, *a, **o: asked.append(q.count()) or real(q, *a, **o))
    counts = {}
    for n in (5, 50):
        orders = [(f"n{i}", "n", "buy", 100, 10, i, "placed") for i in range(0, 300, 3)]
        orders += [r for i in range(n) for r in ((f"s{i}", f"A{i}", "buy", 99, 900, 200, "placed"), (f"s{i}", f"A{i}", "buy", 99, 900, 205, "cancelled"))]
        orders += [("p", "P", "sell", 101, 10, 200, "placed")]
        t = ft.build_steps(make.trades([(202, 100, 10, "n", "P", "buy")]), make.orders(orders), CFG)
        got = linked.linked_pair_steps(t.bait, t.legs, t.placed, CFG).count()
        counts[n] = got, asked[-1]
    assert counts == {5: (5, 1), 50: (50, 1)}
