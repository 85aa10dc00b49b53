import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwarden.config import FeatureConfig
from pitwarden.operators import features as ft, history, linked, rings, steps, windows

CFG = FeatureConfig(window=60, step=30)
SPOOFY = [
    ("n1", "noise", "buy", 100, 10, 1, "placed"), ("n2", "noise", "sell", 101, 10, 2, "placed"), ("n3", "noise", "buy", 100, 10, 40, "placed"),
    ("s1", "spoofy", "buy", 99, 500, 10, "placed"), ("g1", "spoofy", "sell", 101, 10, 10, "placed"), ("s1", "spoofy", "buy", 99, 500, 15, "cancelled"),
    ("m1", "mm_0", "buy", 99, 10, 5, "placed"), ("n4", "noise", "buy", 100, 10, 75, "placed"),
]
PRINTS = [
    (5, 100, 10, "noise", "mm_0", "buy"), (12, 101, 10, "noise", "spoofy", "buy"), (20, 100, 50, "washA", "washB", "buy"),
    (25, 100, 50, "washB", "washA", "sell"), (70, 100, 10, "noise", "mm_0", "buy"),
]


@pytest.fixture(scope="module")
def tiny(make):
    rows = ft.account_features(make.trades(PRINTS), make.orders(SPOOFY), CFG).collect()
    return {(r["window_start"], r["trader_id"]): r for r in rows}


def test_known_shapes(tiny):
    s, w = tiny[(0, "spoofy")], tiny[(0, "washA")]
    assert s["spoof_signature"] == 1.0 and s["fast_cancel_ratio"] > 0.9 and s["large_cancel_ratio"] > 0.95
    assert w["top_cpty_share"] == w["reciprocal_ratio"] == w["net_flatness"] == 1.0
    assert not any(t == "mm_0" for _, t in tiny)
    assert all(v is not None for r in tiny.values() for v in r)


def test_future_rows_change_nothing_earlier(make, tiny):
    late = SPOOFY + [(f"x{i}", "noise", "buy", 100, 900, 300, "placed") for i in range(20)]
    rows = ft.account_features(make.trades(PRINTS), make.orders(late), CFG).filter("window_start <= 0").collect()
    for r in rows:
        before = tiny[(r["window_start"], r["trader_id"])]
        assert all(np.isclose(r[c], before[c], atol=1e-10) for c in ft.FEATURE_COLUMNS)


def test_short_run_is_empty(make):
    t, o = make.trades([(1, 100, 1, "a", "b", "buy")]), make.orders([("o", "a", "buy", 100, 1, 1, "placed")])
    assert ft.account_features(t, o).count() == 0
    assert ft.market_features(t, o, FeatureConfig()).count() == 0


def test_opposite_fills_match_brute_force(spark):
    rnd = random.Random(3)
    bait = [(f"a{rnd.randrange(5)}", rnd.choice(["buy", "sell"]), p := rnd.randrange(5000), p + rnd.randrange(60)) for _ in range(150)]
    fills = [(f"a{rnd.randrange(5)}", rnd.choice(["buy", "sell"]), rnd.randrange(5000)) for _ in range(400)]
    b = spark.createDataFrame([("gold", *x, x[3] // 30, 1.0, i) for i, x in enumerate(bait)], "commodity string, trader_id string, side string, placed_tick long, tick long, step long, n double, id int")
    f = spark.createDataFrame([("gold", *x) for x in fills], "commodity string, trader_id string, side string, tick long")
    got = {r["id"]: r["opp_fill"] for r in steps.opposite_fill_flags(b, f, CFG).collect()}
    for i, (who, side, lo, hi) in enumerate(bait):
        assert got[i] == float(any(w == who and s != side and lo <= t <= hi for w, s, t in fills))


def test_linked_pairs_match_brute_force(spark):
    rnd = random.Random(5)
    who = [f"a{i}" for i in range(5)]
    bait = list({(rnd.choice(who), rnd.choice(["buy", "sell"]), p := rnd.randrange(300), p + rnd.randrange(25)) for _ in range(60)})
    spots = list({(rnd.choice(who), rnd.choice(["buy", "sell"]), rnd.randrange(300)) for _ in range(250)})
    fills = list({(rnd.choice(who), rnd.choice(who), rnd.choice(["buy", "sell"]), rnd.randrange(300)) for _ in range(250)})
    b = spark.createDataFrame([("gold", *x, x[3] // 30, 1.0) for x in bait], "commodity string, trader_id string, side string, placed_tick long, tick long, step long, n double")
    p = spark.createDataFrame([("gold", *x) for x in spots], "commodity string, trader_id string, side string, tick long")
    f = spark.createDataFrame([("gold", *x) for x in fills], "commodity string, trader_id string, cpty string, side string, tick long")
    want = {}
    for a, side, lo, hi in bait:
        for c in who:
            placed = any(w == c and s != side and abs(t - lo) <= 1 for w, s, t in spots)
            filled = any(w == c and o != a and s != side and lo <= t <= hi for w, o, s, t in fills)
            if c != a and placed and filled:
                want[(hi // 30, a, c)] = want.get((hi // 30, a, c), 0) + 1
    got = {(r["step"], r["trader_id"], r["cpty"]): r["n_ev"] for r in linked.linked_pair_steps(b, f, p, CFG).collect()}
    assert got == want and want


def test_ring_of_six(spark):
    ring = [f"r{i}" for i in range(6)]
    rows = []
    for i, a in enumerate(ring):
        nxt = ring[(i + 1) % 6]
        rows += [("gold", 5, a, nxt, 100.0, 0.0), ("gold", 5, nxt, a, 0.0, 100.0)]
    rows += [("gold", 5, "hft", f"n{i}", 10.0, 10.0) for i in range(14)] + [("gold", 5, f"n{i}", "hft", 10.0, 10.0) for i in range(14)]
    pw = spark.createDataFrame(rows, "commodity string, win long, trader_id string, cpty string, bought double, sold double")
    base = spark.createDataFrame([("gold", 5, 10.0)], "commodity string, win long, size_baseline double")
    got = {r["trader_id"]: r for r in rings.ring_features(rings.mutual_pairs(pw, base, CFG), CFG).collect()}
    assert all(got[a]["ring_size"] == 6 and got[a]["ring_volume_share"] > 0.99 for a in ring)
    assert "hft" not in got


def test_window_replication_keeps_complete_windows_only(spark):
    df = spark.createDataFrame([("gold", s, "a", 1.0) for s in range(10)], "commodity string, step long, trader_id string, v double")
    bounds = spark.createDataFrame([("gold", 0, 9)], "commodity string, first_step long, last_step long")
    got = {r["win"]: r["v"] for r in windows.to_windows(df, bounds, ["trader_id"], ["v"], [], FeatureConfig()).collect()}
    assert got == {w: 6.0 for w in range(5, 10)}


def frame(spark, values):
    from pitwarden.config import SELF_Z_COLUMNS

    cols = ", ".join(f"{c} double" for c in ("exec_vol", *SELF_Z_COLUMNS))
    return spark.createDataFrame([("gold", "a", w, *v) for w, v in enumerate(values)], f"commodity string, trader_id string, win long, {cols}")


def test_self_history(spark):
    rng = np.random.default_rng(1)
    calm = [(5.0, 1 + rng.normal(0, 0.1), 1.0, 0.1, 0.2, 0.1, 20.0, 0.01, 0.0) for _ in range(40)]
    wild = [(5.0, 1.0, 30.0, 1.0, 1.0, 1.0, 20.0, 0.01, 0.0) for _ in range(60)]
    rows = history.history_scores(frame(spark, calm + wild + calm), FeatureConfig()).orderBy("win").collect()
    z = np.array([[abs(r[f"self_z_{c}"]) for c in ("max_order_size_rel", "large_order_share")] for r in rows])
    assert z[:10].max() == 0 and z[40:].max() > 5
    assert z[80:100].mean() > 4, "a long burst does not become its own baseline"
    assert z[100:].max() < 1


def test_activity_baseline_survives_a_burst(spark):
    quiet = [(10.0, 1, 1, 0, 0, 0, 10.0, 0, 0)]
    values = [tuple(map(float, v)) for v in quiet * 20 + [(300.0, 1, 1, 0, 0, 0, 0.0, 0, 0)] * 30 + quiet * 20]
    rows = history.history_scores(frame(spark, values), FeatureConfig()).orderBy("win").collect()
    assert abs(rows[-1]["activity_vs_history"]) < 0.5 and rows[25]["activity_vs_history"] > 2


def test_history_against_the_definition(spark):
    """Every pass recomputed for every window from the whole past, with gaps and a second account."""
    from pitwarden.config import ACTIVITY_TRIM_LOG, SELF_Z_COLUMNS, SELF_Z_EVIDENCE, SELF_Z_MIN_HISTORY, SELF_Z_SCALE_FLOOR, SELF_Z_TRIM, TRIM_PASSES

    rng = np.random.default_rng(5)
    need = list(dict.fromkeys(["exec_vol", *SELF_Z_COLUMNS]))
    rows = []
    for trader in ("a", "b"):
        wins = np.sort(rng.choice(np.arange(3, 160), 90, replace=False))
        for w in wins:
            scale = 40.0 if rng.random() < 0.1 else 1.0
            rows.append(("m", trader, int(w), *[float(np.round(scale * rng.gamma(2.0), 2)) for _ in need]))
    df = spark.createDataFrame(rows, ["commodity", "trader_id", "win", *need])
    cfg = FeatureConfig()
    lag, first = cfg.n_steps, min(r[2] for r in rows)
    got = {(r["trader_id"], r["win"]): r for r in history.history_scores(df, cfg).collect()}
    assert len(got) == len(rows)
    for trader in ("a", "b"):
        mine = {r[2]: dict(zip(need, r[3:])) for r in rows if r[1] == trader}
        grid = range(first, max(mine) + 1)
        act = {w: mine[w]["exec_vol"] + mine[w]["n_orders"] if w in mine else 0.0 for w in grid}
        keep, base = set(grid), {}
        for _ in range(TRIM_PASSES):
            base = {w: np.median(past) if (past := [act[v] for v in keep if v <= w - lag]) else None for w in grid}
            keep = {w for w in grid if base[w] is None or abs(np.log1p(act[w]) - np.log1p(base[w])) <= ACTIVITY_TRIM_LOG}
        keep_z = set(mine)
        for _ in range(TRIM_PASSES + 1):
            z = {}
            for w in mine:
                past = [mine[v] for v in keep_z if v <= w - lag]
                for c in SELF_Z_COLUMNS:
                    q = np.quantile([p[c] for p in past], [0.25, 0.5, 0.75]) if len(past) >= SELF_Z_MIN_HISTORY else None
                    z[w, c] = 0.0 if q is None else float(np.clip((mine[w][c] - q[1]) / max((q[2] - q[0]) / 1.349, SELF_Z_SCALE_FLOOR[c]), -20, 20))
            keep_z = {w for w in mine if all(abs(z[w, c]) < SELF_Z_TRIM for c in SELF_Z_COLUMNS)}
        for w, m in mine.items():
            r = got[trader, w]
            assert abs(r["activity_vs_history"] - (np.log1p(act[w]) - np.log1p(base[w] or 0.0))) < 1e-9
            weight = m["n_orders"] / (m["n_orders"] + SELF_Z_EVIDENCE)
            for c in SELF_Z_COLUMNS:
                assert abs(r[f"self_z_{c}"] - z[w, c] * (1.0 if c == "n_orders" else weight)) < 1e-9
