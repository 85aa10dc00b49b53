"""Bar model, exact percentiles and running medians."""

import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwarden.models import bar_model as bm, thresholds as th
from pitwarden.models.trees import TreeConfig
from pitwarden.operators.quantiles import exact_percentiles, running_medians

FAST = bm.BarModelConfig(trees=TreeConfig(rounds=60, depth=3, rate=0.15, min_gain=0.0, l1=0.0, min_child=2.0), smooth_minutes=1)
COLS = ["vol_per_move", "ret_z_1", "pos_30"]


def market(spark, seed, n=900):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    rows = [("gold", 0, i, *map(float, v), int(v[0] > 1.6), 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "commodity string, segment int, minute long, vol_per_move double, ret_z_1 double, pos_30 double, wash_trading int, layering int")


def test_a_planted_signal_is_learnt_across_markets(spark):
    rows = bm.stack_markets([market(spark, s) for s in (1, 2, 3)])
    assert sorted(r.segment for r in rows.select("segment").distinct().collect()) == [0, 1_000_000, 2_000_000]
    model = bm.fit_bar_model(rows, FAST, COLS)
    assert list(model.models) == ["wash_trading"]
    skill = {r.persona: r for r in model.skill.collect()}
    assert skill["wash_trading"].auc > 0.9 and skill["wash_trading"].flag_rate <= 0.022 + 0.002
    held = bm.evaluate(market(spark, 9), model).first()
    assert held.precision > 0.5 and held.auc > 0.9
    scored = bm.score_bars(market(spark, 9), model).collect()
    assert all(r.flag == (r.margin >= 0) and r.predicted_persona == ("wash_trading" if r.flag else None) for r in scored) and any(r.flag for r in scored)


def test_one_market_or_no_positives(spark):
    alone = bm.fit_bar_model(bm.stack_markets([market(spark, 1)]), FAST, COLS)
    assert alone.thresholds == {"wash_trading": 0.5} and alone.skill is None
    none = bm.fit_bar_model(bm.stack_markets([market(spark, 1).withColumn("wash_trading", F.lit(0))]), FAST, COLS)
    assert none.models == {} and bm.score_bars(market(spark, 1), none).filter("flag").count() == 0


def test_smoothing_stays_inside_one_market(spark):
    rows = bm.stack_markets([spark.createDataFrame([("gold", 0, m, float(k)) for m in range(4)], "commodity string, segment int, minute long, p double") for k in (0, 9)])
    got = th.smooth_probabilities(rows, ["p"], 5)
    assert {r.p for r in got.collect()} == {0.0, 9.0}


def test_budget_bounds_the_flags_of_a_weak_score(spark):
    rng = np.random.default_rng(0)
    y = (rng.random(5000) < 0.05).astype(int)
    p = np.clip(0.3 + 0.1 * y + rng.normal(0, 0.15, 5000), 0, 1)
    df = spark.createDataFrame(list(zip(map(float, p), map(int, y))), "p double, y int").repartition(4)
    t = th.budget_threshold(df, "p", "y").first()["threshold"]
    assert (p >= t).mean() <= 0.022


@pytest.mark.parametrize("n", [1, 2, 7, 4000, 60_000])
def test_percentiles_are_exact(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice("ab"), rng.choice([None, rng.gauss(0, 1)]), float(rng.randrange(3)), rng.lognormvariate(0, 3)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(5)
    probs = [0.0, 0.005, 0.1, 0.5, 0.9, 1.0]
    got = {(r.column, r.prob): r.value for r in exact_percentiles(df, ["x", "y", "z"], probs).collect()}
    for c in "xyz":
        expected = df.agg(F.percentile(c, F.array(*map(F.lit, probs)))).first()[0]
        assert expected is None and not any(k[0] == c for k in got) or [got[c, p] for p in probs] == pytest.approx(expected, abs=0, rel=1e-15)
    by = {(r.g, r.prob): r.value for r in exact_percentiles(df, ["z"], probs, ["g"]).collect()}
    for r in df.groupBy("g").agg(F.percentile("z", F.array(*map(F.lit, probs))).alias("q")).collect():
        assert [by[r.g, p] for p in probs] == pytest.approx(r.q, rel=1e-15)
    assert exact_percentiles(df.limit(0), ["x"], [0.5]).count() == 0


def test_running_medians_equal_their_definition(spark):
    rng = random.Random(5)
    rows = [(k, s, rng.choice([None, float(rng.randrange(9)), rng.random()])) for k in "abc" for s in range(200)]
    got = {(r.k, r.s): (r.before, r.now) for r in running_medians(spark.createDataFrame(rows, "k string, s long, v double").repartition(4), ["k"], "s", "v", "before", "now").collect()}
    middle = lambda vs: statistics.median(vs) if vs else None
    for k in "abc":
        seen = []
        for _, s, v in (r for r in rows if r[0] == k):
            before = middle(seen)
            seen += [v] if v is not None else []
            assert got[k, s] == (before, middle(seen))


def test_running_medians_are_not_quadratic(spark):
    def took(n):
        df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("s"), (F.col("id") * 7919 % 10007).cast("double").alias("v"))
        t = time.perf_counter()
        running_medians(df, ["k"], "s", "v", "b", "c").write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    took(1000)
    assert took(40_000) < 8 * took(10_000) + 2
