import pytest
from pyspark.sql import functions as F

from pitwarden.config import DetectorConfig
from pitwarden.operators import cases as cs, detection as dt, effect as ef, ensemble as en, labels as lb

W = "commodity string, window_start long, trader_id string, window_end long"


def test_span_labels(spark, make):
    w = spark.createDataFrame([("gold", 0, "washA", 59), ("gold", 0, "washB", 59), ("gold", 0, "noise", 59), ("gold", 50, "washA", 109)], W)
    got = {(r["window_start"], r["trader_id"]): r["wash_trading"] for r in lb.span_labels(w, make.events([("e", "wash_trading", 0, 59, ["washA", "washB"])])).collect()}
    assert got == {(0, "washA"): 1, (0, "washB"): 1, (0, "noise"): 0, (50, "washA"): 0}


def test_activity_labels(spark, make):
    w = spark.createDataFrame([("gold", s, "p", s + 179) for s in (0, 200, 400, 600, 800)], W)
    tags = [(10, "d"), (210, "a"), (410, "i"), (610, "d"), (810, "u")]
    o = make.orders([(f"ord-{i}{t}", "p", "buy", 1, 1, tick, "placed") for i, (tick, t) in enumerate(tags)])
    got = [r["pump_and_dump"] for r in lb.activity_labels(w, make.events([("e", "pump_and_dump", 0, 1000, ["p"])]), o).orderBy("window_start").collect()]
    assert got == [0, 0, 1, 0, 1]


def test_ensemble_tiers(spark):
    cols = "id int, iso_score double, n_dev int, prob_spoofing double, prob_wash_trading double, prob_pump_and_dump double, prob_layering double"
    s = spark.createDataFrame([(0, 0.995, 0, 0.5, 0.0, 0.0, 0.0), (1, 0.995, 0, 0.0, 0.0, 0.0, 0.0), (2, 0.2, 0, 0.0, 0.0, 0.0, 0.0), (3, 0.995, 2, 0.0, 0.0, 0.0, 0.0), (4, 0.995, 3, 0.0, 0.0, 0.0, 0.0)], cols)
    thr = {p: 0.8 for p in ("spoofing", "wash_trading", "pump_and_dump", "layering")}
    got = {r["id"]: (r["alert_tier"], r["predicted_persona"]) for r in en.combine(s, thr, DetectorConfig(families={})).collect()}
    assert got == {0: ("alert", "anomaly"), 1: ("review", None), 2: ("none", None), 3: ("review", None), 4: ("alert", "anomaly")}


def test_cases_and_matches(spark, make):
    f = spark.createDataFrame(
        [("gold", 0, "a", 179, True, 0.9, 0.1, "spoofing", ["x"]), ("gold", 180, "a", 359, True, 0.95, 0.2, "spoofing", ["y"]), ("gold", 600, "a", 779, True, 0.8, 0.3, "spoofing", ["x"]), ("gold", 0, "b", 179, False, 0.1, 0.1, None, [])],
        W + ", final_flag boolean, final_score double, iso_score double, predicted_persona string, triggered_by array<string>")
    c = cs.build_cases(f)
    rows = {r["start_tick"]: r for r in c.collect()}
    assert rows[0]["end_tick"] == 359 and rows[0]["n_windows"] == 2 and rows[0]["score"] == 0.95 and rows[0]["triggered_by"] == ["x", "y"] and rows[0]["iso_score"] == 0.2
    ev = make.events([("e1", "spoofing", 100, 150, ["a"]), ("e2", "spoofing", 700, 720, ["a"]), ("e3", "layering", 2000, 2100, ["a"])])
    m = cs.match_cases(c, ev)
    assert {r["start_tick"]: (r["status"], r["tier"]) for r in m.collect()} == {0: ("confirmed", "case"), 600: ("confirmed", "brief")}
    assert {r["event_id"]: r["brief_only"] for r in cs.missed_episodes(m, ev).collect()} == {"e2": True, "e3": False}


def test_event_metrics(spark, make):
    flags = ", ".join(f"flag_{p} boolean" for p in ("spoofing", "wash_trading", "pump_and_dump", "layering"))
    res = spark.createDataFrame([("gold", 0, "a", 59, True, True, False, False, False), ("gold", 0, "b", 59, False, False, False, False, False)], f"{W}, final_flag boolean, {flags}")
    ev = make.events([("e1", "spoofing", 10, 60, ["a"]), ("e2", "spoofing", 10, 60, ["b"])])
    r = {x["persona"]: x for x in dt.round_metrics(res, lb.span_labels(res, ev), ev).collect()}["spoofing"]
    assert (r["events_total"], r["events_detected"], r["detection_latency_ticks"]) == (2, 1, 49.0)
    assert (r["episode_coverage"], r["precision"], r["recall"], r["caught_weak_share"]) == (0.5, 1.0, 0.5, 0.5)


def test_account_pnl(make):
    t = make.trades([(1, 100, 10, "a", "b", "buy"), (2, 100, 10, "a", "x", "buy"), (3, 110, 1, "y", "z", "buy")])
    r = ef.account_pnl(make.events([("e", "wash_trading", 0, 10, ["a", "b"])]), t).first()
    assert r["pnl_bp"] == pytest.approx(1000.0) and r["profitable"]


def test_mutation_score(spark):
    cols = "id int, caught_coverage double, episode_coverage double, recall double, events_total long, events_detected long, caught_events_detected long, caught_weak_share double, caught_latency_ticks double, detection_latency_ticks double, effect_ratio double"
    m = spark.createDataFrame([(0, None, 0.4, None, 10, 8, None, None, None, 150.0, 0.7), (1, None, 0.4, None, 10, 8, None, None, None, 150.0, 2.0), (2, None, 0.4, None, 10, 8, None, None, None, 150.0, 0.3),
                               (3, 1.0, 0.0, 0.0, 1, 0, 1, 0.0, 180.0, None, 1.0)], cols)
    got = {r["id"]: r["mutation_score"] for r in ef.evasion(m).collect()}
    full = 0.5 * 0.6 + 0.3 * 0.2 + 0.2 * 0.5
    assert got == {0: pytest.approx(full * 0.7, abs=1e-4), 1: pytest.approx(full, abs=1e-4), 2: 0.0, 3: pytest.approx(0.2 * 180 / 300, abs=1e-4)}


def test_empty_ground_truth(spark, make):
    w = spark.createDataFrame([("gold", 0, "a", 179)], W)
    assert lb.span_labels(w, make.events([]).limit(0)).first()["spoofing"] == 0


def test_detector_query_trains_the_default_configuration_on_account_features(spark, monkeypatch):
    from pitwarden.config import PERSONAS, DetectorConfig
    from pitwarden.operators.features import FEATURE_COLUMNS
    from pitwarden.plans import learning

    class Seen(Exception):
        pass

    def train(features, labels, cols, cfg=None):
        assert cfg is None or cfg == DetectorConfig()
        assert sorted(cols) == sorted(FEATURE_COLUMNS) and set(PERSONAS) <= set(labels.columns)
        assert features.join(labels, learning.KEYS).count() == features.count() > 0
        raise Seen

    def fit_forest(df, cols, keys):
        assert sorted(cols) == sorted(c for c in FEATURE_COLUMNS if not c.startswith("mkt_"))
        raise Seen

    monkeypatch.setattr(learning.dm, "train", train)
    monkeypatch.setattr(learning.fo, "fit_forest", fit_forest)
    for query in (learning.detector_alerts, learning.forest_scores):
        with pytest.raises(Seen):
            query(spark, "/root/testdata/sf0.001")


def test_account_profiles_and_caught_features(spark, make):
    schema = "commodity string, trader_id string, window_start long, window_end long, final_flag boolean, predicted_persona string, final_score double, triggered_by array<string>, iso_score double, top_shap_features map<string,double>"
    rows = [
        ("gold", "a", 0, 10, True, "spoofing", 0.9, ["x"], 0.1, {"wash": -0.4, "cancel": 0.1}),
        ("gold", "a", 5, 15, True, "spoofing", 0.8, ["x"], 0.1, {"wash": 0.2, "depth": 0.3}),
        ("gold", "a", 5000, 5010, True, "spoofing", 0.7, ["x"], 0.1, {"cancel": 0.2, "late": None}),
        ("gold", "a", 9000, 9010, True, "spoofing", 0.7, ["x"], 0.1, {}),
        ("gold", "b", 9000, 9010, True, "anomaly", 0.6, ["x"], 0.1, None),
        ("gold", "a", 9000, 9100, False, "spoofing", 0.1, ["x"], 0.1, {"unseen": 9.0}),
    ]
    flags = spark.createDataFrame(rows, schema)
    events = make.events([("e1", "spoofing", 0, 20, ["a"]), ("e2", "layering", 5000, 5005, ["a"])])
    m = cs.match_cases(cs.build_cases(flags), events)
    got = {r["trader_id"]: r for r in cs.account_profiles(m, flags).collect()}
    assert list(got["a"]["top_features"]) == ["wash", "cancel", "depth"]
    assert got["a"]["top_features"] == pytest.approx({"wash": -0.1, "cancel": 0.15, "depth": 0.3})
    assert got["a"]["other_truth"] == "layering" and got["a"]["cases"] == 3 and got["b"]["top_features"] is None
    lone = {r["trader_id"]: r["only_status"] for r in cs.account_profiles(m, flags, status="no_episode").collect()}
    assert lone == {"a": False, "b": True}
    assert cs.account_profiles(m, flags, status="near_episode").count() == 0
    shares = {(r["persona"], r["feature"]): r["share"] for r in cs.caught_features(flags, events).collect()}
    assert shares == {("spoofing", "wash"): 0.6, ("spoofing", "depth"): 0.3, ("spoofing", "cancel"): 0.1, ("layering", "cancel"): 1.0}
