"""Evidence of cases from distinct spans and one shuffle a case, against plain definitions; how many rows the joins make."""

import random

from pitwarden.operators import cases as cs, evidence as ev
from pitwarden.operators.effect import tick_prices

CASE = "case_id string, commodity string, trader_id string, persona string, start_tick long, end_tick long"


def nodes(plan):
    # An adaptive plan shows its executed form only through executedPlan, and a stage's through plan.
    kind = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    yield kind, plan
    for child in inner:
        yield from nodes(child)


def test_price_range_rows_follow_spans(spark, make):
    """A hundred cases of one span over fifty ticks: no join may make their 5,000 pairs."""
    prices = tick_prices(make.trades([(t, 100 + t % 7, 1, "a", "b", "buy") for t in range(50)]))
    cases = spark.createDataFrame([(f"c{i}", "gold", f"a{i}", "spoofing", 10, 30) for i in range(100)], CASE)
    out = cs.case_price_range(cases, prices, pad=5)
    assert {(r["ticks"], r["low"], r["high"]) for r in out.collect()} == {(31, 100.0, 106.0)}
    rows = [p.metrics().apply("numOutputRows").value() for kind, p in nodes(out._jdf.queryExecution().executedPlan()) if "Join" in kind]
    assert rows and max(rows) <= 100, rows


def random_case(seed):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(300), 100 + rnd.randrange(9), rnd.randrange(1, 20), *rnd.choice((("me", "x"), ("x", "me"), ("me", "y"), ("y", "z"))), rnd.choice(("buy", "sell"))) for _ in range(60)]
    a = rnd.randrange(100)
    return rows, a, a + rnd.choice((20, 58, 59, 60, 150))


def burst(rows, a, z):
    """Largest aggressive buying of 60 whole ticks, tick by tick."""
    best = None
    for t in range(a + 59, z + 1):
        p = sum(q for k, _, q, b, _, side in rows if b == "me" and side == "buy" and t - 59 <= k <= t)
        if p > 0 and (best is None or p > best[1]):
            best = (t, p, sum(q for k, _, q, *_ in rows if t - 59 <= k <= t))
    return best


def test_burst_without_a_row_per_tick(spark, make):
    for seed in range(8):
        rows, a, z = random_case(seed)
        got = ev.pump_facts(spark.createDataFrame([("c", "gold", "me", "pump_and_dump", a, z)], CASE), make.trades(rows)).collect()
        want = burst(rows, a, z)
        if not got:
            assert not any(a <= t <= z and "me" in (b, s) for t, _, _, b, s, _ in rows)
            continue
        r = got[0]
        assert (r["burst_end_tick"], r["burst_aggressive_buy_volume"]) == (want[:2] if want else (None, None)), seed
        share = r["burst_share_of_market_volume_pct"]
        assert share is None if want is None else abs(share - 100 * want[1] / want[2]) <= 0.051


def test_span_length_adds_no_rows_to_pump_facts(spark, make, monkeypatch):
    """A case of 100,000 ticks with two trades: no stage table may hold a row per tick."""
    made = []
    real = ev.cut

    def counted(df):
        out = real(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(ev, "cut", counted)
    trades = make.trades([(10, 100, 5, "me", "x", "buy"), (90_000, 101, 5, "x", "me", "buy")])
    out = ev.pump_facts(spark.createDataFrame([("c", "gold", "me", "pump_and_dump", 0, 100_000)], CASE), trades)
    assert out.collect()[0]["burst_end_tick"] == 59
    kinds = [(kind, p) for kind, p in nodes(out._jdf.queryExecution().executedPlan())]
    assert max(made) <= 4 and not any("Generate" in kind for kind, _ in kinds)
    assert max(p.metrics().apply("numOutputRows").value() for kind, p in kinds if "Join" in kind) <= 4


def test_top_counterparty_of_wash_cases(spark, make):
    rows = [(1, 100, 5, "me", "x", "buy"), (2, 101, 5, "x", "me", "sell"), (2, 99, 7, "me", "y", "buy"), (3, 99, 3, "z", "y", "buy"), (60, 99, 90, "me", "y", "buy")]
    cases = [(f"c{i}", "gold", who, "wash_trading", 0, 9) for i, who in enumerate(("me", "x", "nobody"))]
    got = {r["case_id"]: r for r in ev.wash_facts(spark.createDataFrame(cases, CASE), make.trades(rows)).collect()}
    assert [got["c0"][c] for c in ("trades", "gross_volume", "net_position_change", "top_counterparty", "trades_with_top_counterparty", "bought_from_top_counterparty", "sold_to_top_counterparty")] == [3, 17, 7, "x", 2, 5, 5]
    assert got["c0"]["pair_share_of_market_volume_pct"] == 50.0 and got["c1"]["top_counterparty"] == "me"
    assert got["c2"]["trades"] == 0 and got["c2"]["top_counterparty"] is None
