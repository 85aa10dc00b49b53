import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitwarden.config import PERSONAS
from pitwarden.models import thresholds as th
from pitwarden.operators import bar_features as bf, bars as bo, cases as cs, labels as lb, mechanism as me


def test_minute_bars_and_labels(make):
    b = bo.minute_bars(make.trades([(0, 10, 1, "a", "b", "buy"), (30, 11, 2, "a", "b", "buy"), (59, 9, 3, "a", "b", "sell"), (180, 12, 1, "a", "b", "buy"), (200, 13, 1, "a", "b", "buy")]))
    rows = {r["minute"]: r for r in b.collect()}
    assert sorted(rows) == [0, 1, 2, 3]
    assert tuple(rows[0])[2:7] == (10.0, 11.0, 9.0, 9.0, 6.0) and tuple(rows[1])[2:7] == (9.0, 9.0, 9.0, 9.0, 0.0)
    y = lb.minute_labels(b, make.events([("e", "spoofing", 80, 170, ["a"])])).orderBy("minute").collect()
    assert [r["spoofing"] for r in y] == [0, 1, 1, 0]


def wave(spark, price=1.0, volume=1.0):
    import math
    rows = []
    for m in range(150):
        p = 100 + math.sin(m / 5.0) + (m % 7) * 0.05
        q = 100 + math.sin((m + 1) / 5.0) + ((m + 1) % 7) * 0.05
        rows.append(("gold", m, p * price, max(p, q) * 1.001 * price, min(p, q) * 0.999 * price, q * price, (50 + (m * 13) % 40) * volume, 0))
    return spark.createDataFrame(rows, "commodity string, minute long, open double, high double, low double, close double, volume double, segment int")


def test_features_do_not_depend_on_units(spark):
    a = {r["minute"]: r for r in bf.bar_features(wave(spark)).collect()}
    b = {r["minute"]: r for r in bf.bar_features(wave(spark, 37.0, 9.0)).collect()}
    logs = {"vol_z", "vol_per_move", "vol_ratio_5", "vol_ratio_15", "vol_resid", "vol_resid_c5", "vol_resid_c9"}
    for m, r in a.items():
        for c in bf.FEATURES:
            assert r[c] is not None and r[c] == r[c]
            if c not in logs:
                assert r[c] == pytest.approx(b[m][c], abs=1e-6)


def test_minute_cases(spark):
    rows = [("gold", 1, m, True, p, 0.1, *[0.5] * 4) for m, p in ((1, "spoofing"), (2, "spoofing"), (4, "wash_trading"), (20, "wash_trading"), (21, "wash_trading"))]
    s = spark.createDataFrame(rows, "commodity string, segment int, minute long, flag boolean, predicted_persona string, margin double, " + ", ".join(f"prob_{p} double" for p in PERSONAS))
    assert {(r["start_minute"], r["end_minute"], r["model_persona"]) for r in cs.minute_cases(s, PERSONAS).collect()} == {(1, 4, "spoofing"), (20, 21, "wash_trading")}


def test_calendar(spark):
    at = 1791988320  # Wednesday 2026-10-14 14:32 UTC
    w = spark.createDataFrame([("wed_oil", "crude_oil_wti", at, at + 240), ("wed_gold", "gold", at, at + 240), ("tue_oil", "crude_oil_wti", at - 86400, at - 86160)], "window_id string, commodity string, start_utc long, end_utc long")
    sectors = spark.createDataFrame([("crude_oil_wti", "energy"), ("gold", "metals")], "commodity string, sector string")
    hits = me.scheduled_events(w, me.calendar(spark), sectors).filter(F.col("event").contains("petroleum")).collect()
    assert [r["window_id"] for r in hits] == ["wed_oil"]


def test_planted_pump_and_volume_burst(spark):
    rows, price = [], 100.0
    for m in range(140):
        drift = 0.004 if 70 <= m < 80 else -0.004 if 80 <= m < 92 else 0.0002 * (-1) ** m
        new = price * (1 + drift)
        vol = 500.0 if 70 <= m < 92 else 100.0
        rows.append(("gold", m, price, max(price, new), min(price, new), new, vol))
        price = new
    for m in range(140):
        rows.append(("corn", m, 50.0, 50.01, 50.0, 50.0 + 0.01 * (m % 2), 1000.0 if 70 <= m < 80 else 100.0))
    b = spark.createDataFrame(rows, "commodity string, minute long, open double, high double, low double, close double, volume double")
    w = spark.createDataFrame([("p", "gold", 70, 79), ("v", "corn", 70, 79)], "window_id string, commodity string, start long, end long")
    sectors = spark.createDataFrame([("gold", "metals"), ("corn", "grains")], "commodity string, sector string")
    r = {x["window_id"]: x for x in me.mechanism_checks(w, b, sectors).collect()}
    assert r["p"]["verdict_pump_and_dump"] == "consistent"
    assert r["v"]["verdict_wash_trading"] == "consistent (unverifiable)"


def test_moves_with_holes_match_the_definition(spark):
    rng = np.random.default_rng(5)
    at = {c: np.sort(rng.choice(400, 230, replace=False)) for c in ("gold", "corn", "oil")}
    rows = [(c, int(m), float(p), float(p) * 1.01, float(p) * 0.99, float(p) + 0.1, 10.0) for c, ms in at.items() for m, p in zip(ms, 50 + rng.random(230))]
    cols = ["commodity", "minute", "open", "high", "low", "close", "volume"]
    spans = [(f"w{i}", c, int(s), int(s + n)) for i, (c, s, n) in enumerate(zip(rng.choice(list(at), 40), rng.integers(-80, 460, 40), rng.integers(0, 130, 40)))]
    w = spark.createDataFrame(spans, "window_id string, commodity string, start long, end long")
    got = {(r["window_id"], r["commodity"]): r for r in me.moves(w, spark.createDataFrame(rows, "commodity string, minute long, open double, high double, low double, close double, volume double")).collect()}
    frame, wanted = pd.DataFrame(rows, columns=cols).set_index("minute"), {}
    for wid, _, s, e in spans:
        for c in at:
            b = frame[frame["commodity"] == c]
            pre, win = b.loc[s - 60:s - 1], b.loc[s:e]
            if len(win):
                ret = [(np.log(x["close"]).diff().dropna() * 1e4) for x in (pre, win)]
                sd = ret[0].std() if len(ret[0]) > 5 else ret[1].std()
                ref = pre["close"].iloc[-1] if len(pre) else win["open"].iloc[0]
                move = float(np.log(win["close"].iloc[-1] / ref) * 1e4)
                wanted[wid, c] = (len(win), len(pre), move, None if np.isnan(sd) else move / (max(sd, 0.5) * np.sqrt(len(win))))
    assert set(got) == set(wanted) and len(got) > 60
    for k, (n, n_pre, move, z) in wanted.items():
        r = got[k]
        assert (r["n"], r["pre_bars"]) == (n, n_pre) and r["move_bp"] == pytest.approx(move)
        assert r["move_z"] is None if z is None else r["move_z"] == pytest.approx(z)


def test_verdicts_know_the_calendar_and_missing_bars(spark):
    at = 1791988320  # Wednesday 2026-10-14 14:32 UTC, inside the weekly petroleum report
    rows = [("crude_oil_wti", m, 50.0, 50.0, 50.0, 50.0 + (0.5 if 70 <= m < 75 else 0.01 * (m % 2)), 100.0) for m in range(140)]
    b = spark.createDataFrame(rows, "commodity string, minute long, open double, high double, low double, close double, volume double")
    w = spark.createDataFrame([("bars", "crude_oil_wti", 70, 74, at, at + 240), ("none", "crude_oil_wti", 500, 505, at, at + 240), ("stranger", "tin", 70, 74, at, at)],
                              "window_id string, commodity string, start long, end long, start_utc long, end_utc long")
    sectors = spark.createDataFrame([("crude_oil_wti", "energy")], "commodity string, sector string")
    events = me.scheduled_events(w.select("window_id", "commodity", "start_utc", "end_utc"), me.calendar(spark), sectors)
    got = {r["window_id"]: r for r in me.mechanism_checks(w, b, sectors, events).collect()}
    plain = {r["window_id"]: r for r in me.mechanism_checks(w, b, sectors).collect()}
    assert got["bars"]["hard_benign"] and "scheduled event" in got["bars"]["benign"] and not plain["bars"]["hard_benign"]
    for k in ("none", "stranger"):
        assert not got[k]["available"] and got[k]["best_match"] is None
        assert {got[k][f"verdict_{p}"] for p in PERSONAS} == {"insufficient data"} and got[k]["confidence_spoofing"] == 0.0


def test_threshold_takes_the_plateau(spark):
    curve = [0.3] * 5 + [0.9] + [0.3] * 4 + [0.8] * 9 + [0.2] * 8
    step = 0.65 / 26
    s = spark.createDataFrame([(i, 0.25 + i * step, f) for i, f in enumerate(curve)], "i int, threshold double, f1 double")
    assert th.pick_threshold(s).first()["threshold"] == pytest.approx(0.25 + 14 * step)
    assert th.keep_previous(0.6, 0.8, 0.795, 0.5, 0) == (0.5, 1) and th.keep_previous(0.6, 0.8, 0.795, 0.5, 2) == (0.6, 0)


def test_alert_budget(spark):
    s = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("p"), (F.col("id") % 50 == 0).cast("int").alias("y"))
    t = th.budget_threshold(s, "p", "y", 0.02).first()["threshold"]
    assert s.filter(F.col("p") >= t).count() / 5000 <= 0.022


def test_negative_subsample(spark):
    s = spark.range(20000).select("id", (F.col("id") % 100 == 0).cast("int").alias("y"), F.lit("t").alias("trader_id"))
    k = th.subsample_negatives(s, "y", ["id"], 0.25).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("w")).collect()
    got = {r["y"]: (r["n"], r["w"]) for r in k}
    assert got[1] == (200, 1.0) and got[0][1] == 4.0 and abs(got[0][0] - 4950) < 300
