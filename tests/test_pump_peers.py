"""Peers of pump cases, counted without meeting every account, against their definition."""

import random

from pitwarden.operators import evidence as ev

CASE = "case_id string, commodity string, trader_id string, persona string, start_tick long, end_tick long"
FLAG = "commodity string, trader_id string, window_start long, window_end long, final_flag boolean, predicted_persona string"


def random_rows(seed):
    rnd = random.Random(seed)
    flags = []
    for _ in range(140):
        a = rnd.randrange(60) * 30
        flags.append((rnd.choice("xy"), f"a{rnd.randrange(9)}", a, a + rnd.choice((29, 59, 179)), rnd.random() < 0.8, rnd.choice(("pump_and_dump", "pump_and_dump", "spoofing"))))
    cases = []
    for i in range(80):
        a = rnd.randrange(60) * 30
        cases.append((f"c{i}", rnd.choice("xyz"), f"a{rnd.randrange(12)}", "pump_and_dump", a, a + rnd.choice((0, 29, 179, 900))))
    return cases, flags


def test_peers_match_their_definition(spark):
    """Several stretches of one account in a span, nested windows, own windows, markets without flags."""
    for seed in (1, 2):
        cases, flags = random_rows(seed)
        want = {}
        for c, market, who, _, s, e in cases:
            met = {t for m, t, a, z, final, p in flags if m == market and t != who and final and p == "pump_and_dump" and z >= s and a <= e}
            if met:
                want[c] = (len(met), min(met))
        got = ev.pump_peers(spark.createDataFrame(cases, CASE), spark.createDataFrame(flags, FLAG)).collect()
        assert {r["case_id"]: (r["peers"], r["first_peer"]) for r in got} == want
        assert len(got) == len(want)


def test_rows_follow_spans_not_pairs(spark):
    """A hundred cases and a hundred accounts of one window: no join may make their 9,900 pairs."""
    flags = [("x", f"a{i:03d}", 0, 179, True, "pump_and_dump") for i in range(100)]
    cases = [(f"c{i:03d}", "x", f"a{i:03d}", "pump_and_dump", 0, 179) for i in range(100)]
    out = ev.pump_peers(spark.createDataFrame(cases, CASE), spark.createDataFrame(flags, FLAG))
    assert {(r["peers"], r["first_peer"]) for r in out.collect()} == {(99, "a001"), (99, "a000")}

    def nodes(plan):
        # An adaptive plan shows its executed form only through executedPlan, and a stage's through plan.
        kind = plan.getClass().getSimpleName()
        inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        yield kind, plan
        for child in inner:
            yield from nodes(child)

    plan = out._jdf.queryExecution().executedPlan()
    rows = [p.metrics().apply("numOutputRows").value() for kind, p in nodes(plan) if "Join" in kind]
    assert rows and max(rows) <= 200, rows
