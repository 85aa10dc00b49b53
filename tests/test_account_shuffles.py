"""What single account queries carry through their shuffles, and that they still return what all features return."""

import random

from pyspark.sql import functions as F

from pitwarden.config import FeatureConfig
from pitwarden.operators import features as ft, history, steps, windows

CFG = FeatureConfig()
WHO = ["commodity", "win", "trader_id"]


def busy_log(make):
    rnd = random.Random(11)
    orders, prints = [], []
    for i in range(160):
        at, who, price, size = rnd.randrange(900), rnd.choice("ABCn"), 100 + rnd.randrange(4), rnd.choice((5, 10, 200))
        side = rnd.choice(("buy", "sell"))
        orders.append((f"o{i}", who, side, price, size, at, "placed"))
        if rnd.random() < 0.5:
            orders.append((f"o{i}", who, side, price, size, at + rnd.randrange(30), "cancelled"))
    orders.append(("lost", "only_cancels", "buy", 99, 7, 400, "cancelled"))
    orders.append(("done", "only_filled", "buy", 99, 7, 400, "filled"))
    for _ in range(200):
        a, b = rnd.sample("ABCDE", 2)
        prints.append((rnd.randrange(900), 100 + rnd.randrange(5), rnd.randrange(1, 20), a, b, rnd.choice(("buy", "sell"))))
    prints.append((500, 100, 3, "mm_1", "A", "buy"))
    return make.trades(prints), make.orders(orders)


def rows(df, columns):
    return {tuple(r[c] for c in WHO): tuple(round(r[c], 9) for c in columns) for r in df.select(*WHO, *columns).collect()}


def test_traded_windows_equal_the_behaviour_rows(make):
    trades, orders = busy_log(make)
    whole, _, _ = ft.behaviour(ft.build_steps(trades, orders, CFG), CFG)
    got = windows.traded_windows(trades, orders, steps.step_bounds(trades, orders, CFG), CFG)
    want = rows(whole, ["net_qty", "exec_vol"])
    assert rows(got, ["net_qty", "exec_vol"]) == want
    assert any(w[2] == "only_cancels" for w in want) and not any(w[2] in ("only_filled", "mm_1") for w in want)


def test_position_history_shuffles_no_counterparties(spark):
    """One shuffle into blocks and one into accounts; counterparties and prices are in neither."""
    from pitwarden.plans.account import position_history

    plan = position_history(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "cpty" not in plan and "price" not in plan
    assert plan.count("Exchange hashpartitioning") == 2, plan


def test_own_behaviour_equals_the_behaviour_rows(make):
    trades, orders = busy_log(make)
    t = ft.build_steps(trades, orders, CFG)
    whole, _, _ = ft.behaviour(t, CFG)
    own = ft.own_behaviour(t, CFG)
    columns = [c for c in whole.columns if c in own.columns and c not in WHO]
    assert set(whole.columns) - set(own.columns) == {"n_large_cancels", "spoof_signature", "top_cpty_share", "reciprocal_ratio", "n_counterparties"}
    assert rows(own, columns) == rows(whole, columns)


def test_order_steps_shuffle_their_events_once(make):
    """Narrow events in one shuffle; a side that is missing is neither bought nor a replacement."""
    placed = make.orders([]).sparkSession.createDataFrame(
        [("gold", "A", 0, 3, "buy", 10.0, False, p, 1.0) for p in (99.0, 98.0, 97.0)],
        "commodity string, trader_id string, step long, tick long, side string, quantity double, is_large boolean, price double, dist_bp double")
    cancels = placed.sparkSession.createDataFrame(
        [("gold", "A", 0, 3, "buy", 10.0, False, 4.0), ("gold", "A", 0, 3, None, 5.0, False, 180.0)],
        "commodity string, trader_id string, step long, tick long, side string, quantity double, is_large boolean, lifetime double")
    out = steps.order_steps(placed, cancels, CFG)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    r = out.collect()[0]
    assert (r["n_placed"], r["placed_vol"], r["layer_vol"], r["n_cancel"], r["cancel_vol"], r["cancel_buy"]) == (3.0, 30.0, 30.0, 2.0, 15.0, 10.0)
    assert (r["n_replaced"], r["fast_cancel"], r["lifetime_sum"], r["placed_max"], r["dist_q"]) == (1.0, 10.0, 184.0, 10.0, 30.0)


def test_reciprocal_volume_equals_that_of_directed_pairs(make):
    """An account that trades with itself counts once, as in the directed pairs."""
    trades, orders = busy_log(make)
    trades = trades.union(make.trades([(410, 100, 4, "A", "A", "buy"), (420, 100, 6, "A", "A", "sell")]))
    t = ft.build_steps(trades, orders, CFG)
    pairs, _ = ft.pairs_and_baseline(t, CFG)
    want = rows(windows.counterparty_summary(pairs, CFG).filter("recip <> 0"), ["recip"])
    recip = windows.reciprocal_windows(trades, t.bounds, CFG)
    assert rows(recip, ["recip"]) == want and len(want) > 20
    whole, _, _ = ft.behaviour(t, CFG)
    columns = ["reciprocal_ratio", "aggressor_ratio", "exec_vol"]
    assert rows(ft.own_behaviour(t, CFG, recip), columns) == rows(whole, columns)


def test_own_history_shuffles_once_and_equals_its_parts(make):
    trades, orders = busy_log(make)
    f, _, _ = ft.behaviour(ft.build_steps(trades, orders, CFG), CFG)
    f = history.cut(f.withColumn("gross_volume_share", F.lit(0.1)))
    own = history.own_history(f, CFG)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(commodity#") - plan.count("Exchange hashpartitioning(commodity#", plan.index("HashAggregate")) == 1, plan
    scores = history.history_scores(f, CFG)
    position = history.position_history(f, CFG)
    columns = [c for c in own.columns if c not in (*WHO, "exec_side_imbalance")]
    assert rows(own, columns) == rows(scores.join(position.select(*WHO, "prev_net_ratio", "long_net_ratio"), WHO), columns)


def test_trimming_levels_share_their_history_until_they_part():
    """every level learnt and judged on its own, also while all had kept the same windows."""
    import random

    rng = random.Random(7)
    n = len(history.SELF_Z_COLUMNS)
    rows = [(w, [float("nan") if rng.random() < 0.05 else rng.gauss(0, 60 if w > 60 and rng.random() < 0.1 else 1) for _ in range(n)]) for w in range(160)]
    swept, got, kinds = history.TrimmedDeviation(3), [], []
    for w, v in rows:
        got.append(swept.advance(w, v))
        kinds.append(len({id(level) for level in swept.levels}))
    assert kinds[12] == 1 < kinds[-1]

    def quantile(past, q):
        at = (len(past) - 1) * q
        low = int(at)
        return past[low] + (past[min(low + 1, len(past) - 1)] - past[low]) * (at - low)

    def judge(kept, w, v):
        z = []
        for i, c in enumerate(history.SELF_Z_COLUMNS):
            past = sorted(x[i] for u, x in kept if u <= w - 3 and x[i] == x[i])
            if len(past) < history.SELF_Z_MIN_HISTORY or v[i] != v[i]:
                z.append(0.0)
                continue
            width = max((quantile(past, 0.75) - quantile(past, 0.25)) / 1.349, history.SELF_Z_SCALE_FLOOR[c])
            z.append(min(20.0, max(-20.0, (v[i] - quantile(past, 0.5)) / width)))
        return z

    kept = rows
    for _ in range(history.TRIM_PASSES):
        kept = [(w, v) for w, v in rows if all(abs(z) < history.SELF_Z_TRIM for z in judge(kept, w, v))]
    at = history.SELF_Z_COLUMNS.index("n_orders")
    for (w, v), mine in zip(rows, got, strict=True):
        weight = v[at] / (v[at] + history.SELF_Z_EVIDENCE) if v[at] == v[at] else 0.0
        assert mine == [z if i == at else z * weight for i, z in enumerate(judge(kept, w, v))]
