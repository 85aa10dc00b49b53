"""Reports over the history of training rounds.

``metrics`` holds one row per (round, persona, phase); ``params`` one map of knob values per
(round, persona).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pitwarden.functions.exprs import rnd
from pitwarden.operators.effect import EFFECT_AT_RISK, EFFECT_FLOOR, EFFECT_SURPLUS

BREAKTHROUGH_COVERAGE = 0.5


def tidy_summary(rounds: DataFrame, phases: tuple[tuple[str, str], ...]) -> DataFrame:
    """Nested round documents (one struct column per phase, keyed by persona) as tidy rows."""
    parts = F.array(*[F.struct(F.lit(p).alias("phase"), F.col(c).alias("m")) for p, c in phases])
    one = rounds.select("round", F.explode(parts).alias("x")).select("round", "x.phase", F.explode("x.m").alias("persona", "v"))
    return one.select("round", "persona", "phase", "v.*")


def contract_rows(metrics: DataFrame, commodity: str) -> DataFrame:
    """Rows of the stored round_metrics table: frozen and retrained phases only."""
    return metrics.filter(F.col("phase").isin("pre", "post")).select(
        F.col("round").cast("long").alias("round_num"), F.lit(commodity).alias("commodity"), "persona", "precision", "recall", "f1", "fpr",
        "detection_latency_ticks", (F.col("phase") == "post").alias("is_post_retrain"),
    )


def headline(metrics: DataFrame) -> DataFrame:
    """Largest relative recall drop of a frozen detector below round 0, and the recall after retraining."""
    post = metrics.filter("phase = 'post'").select("round", "persona", F.col("recall").alias("recovered"))
    base = metrics.filter("phase = 'post' AND round = 0 AND recall > 0").select("persona", F.col("recall").alias("base"))
    pre = metrics.filter("phase = 'pre' AND recall IS NOT NULL").select("round", "persona", "recall")
    j = pre.join(base, "persona").join(post, ["round", "persona"], "left").withColumn("drop", (F.col("base") - F.col("recall")) / F.col("base"))
    return j.agg(F.max(F.struct("drop", "round", "persona", "recall", "recovered")).alias("x")).select("x.*").filter("round IS NOT NULL")


def f1_matrix(metrics: DataFrame) -> DataFrame:
    """F1 of every persona in every retrained round, in long form: no list of rounds is fixed."""
    return metrics.filter("phase = 'post'").groupBy("persona", "round").agg(F.max("f1").alias("f1"))


def baseline_vs_latest(metrics: DataFrame) -> DataFrame:
    """Average of each score in the first and in the latest retrained round."""
    p = metrics.filter("phase = 'post'")
    last = p.agg(F.min("round").alias("a"), F.max("round").alias("z"))
    j = p.crossJoin(F.broadcast(last))
    cols = []
    for c in ("precision", "recall", "f1", "fpr"):
        cols += [F.avg(F.when(F.col("round") == F.col("a"), F.col(c))).alias(f"{c}_baseline"), F.avg(F.when(F.col("round") == F.col("z"), F.col(c))).alias(f"{c}_latest")]
    return j.agg(*cols)


def run_overview(metrics: DataFrame) -> DataFrame:
    """Per persona: mean frozen recall, worst round and rank of difficulty (1 = hardest)."""
    pre = metrics.filter("phase = 'pre'")
    g = pre.groupBy("persona").agg(
        F.avg("recall").alias("mean_recall"), F.avg("mutation_score").alias("mean_score"),
        F.min_by("round", F.when(F.col("recall").isNotNull(), F.struct("recall", "round"))).alias("worst_round"), F.min("recall").alias("worst_recall"),
    )
    order = Window.orderBy(F.asc_nulls_last("mean_recall"), "persona")
    return g.withColumn("difficulty", F.row_number().over(order))


def track_record(metrics: DataFrame, last: int | None = 8) -> DataFrame:
    """The last rounds of every persona (all of them without ``last``), oldest first: frozen coverage, recalls, effect and score."""
    pre = metrics.filter("phase = 'pre'").select("round", "persona", F.col("coverage").alias("frozen_coverage"), F.col("recall").alias("frozen_recall"), "effect_ratio", "mutation_score")
    post = metrics.filter("phase = 'post'").select("round", "persona", F.col("recall").alias("retrained_recall"))
    j = pre.join(post, ["round", "persona"], "left")
    w = Window.partitionBy("persona").orderBy(F.desc("round"))
    aged = j.withColumn("age", F.row_number().over(w))
    return aged if last is None else aged.filter(F.col("age") <= last)


def effect_status(metrics: DataFrame) -> DataFrame:
    """Latest effect of each persona and the anchor round: best score that kept its effect, latest on ties."""
    pre = metrics.filter("phase = 'pre'")
    kept = F.col("effect_ratio") >= EFFECT_FLOOR
    g = pre.groupBy("persona").agg(
        F.max("round").alias("round"), F.max_by("effect_ratio", "round").alias("effect_ratio"),
        F.max_by("round", F.when(kept & F.col("mutation_score").isNotNull(), F.struct("mutation_score", "round"))).alias("anchor_round"),
    )
    e = F.col("effect_ratio")
    status = F.when(e < EFFECT_FLOOR, "failed").when(e < EFFECT_AT_RISK, "at_risk").when(e > EFFECT_SURPLUS, "surplus").otherwise("ok")
    return g.withColumn("status", F.when(e.isNotNull(), status))


def params_long(params: DataFrame) -> DataFrame:
    return params.select("round", "persona", F.explode("params").alias("knob", "value"))


def params_history(params: DataFrame) -> DataFrame:
    """Every knob value with a mark where it differs from the round before."""
    w = Window.partitionBy("persona", "knob").orderBy("round")
    before = F.lag("value").over(w)
    first = F.row_number().over(w) == 1
    return params_long(params).withColumn("changed", ~first & ~F.col("value").eqNullSafe(before))


def knob_usage(params: DataFrame, bounds: DataFrame) -> DataFrame:
    """Knobs never changed, and knobs whose latest value sits on a bound (persona, knob, lo, hi)."""
    h = params_history(params).groupBy("persona", "knob").agg(
        F.count_if("changed").alias("changes"), F.max_by("value", "round").alias("latest")
    ).join(bounds, ["persona", "knob"], "left")
    at = F.when(F.col("latest") <= F.col("lo"), "low").when(F.col("latest") >= F.col("hi"), "high")
    return h.select("persona", "knob", "changes", "latest", (F.col("changes") == 0).alias("never_changed"), at.alias("at_bound"))


def breakthroughs(metrics: DataFrame, params: DataFrame, coverage: float = BREAKTHROUGH_COVERAGE) -> DataFrame:
    """Rounds that evaded the frozen detector, with the knobs changed for them."""
    w = Window.partitionBy("persona").orderBy("round")
    steps = params.withColumn("before", F.lag("params").over(w)).filter("before IS NOT NULL")
    changed = F.map_filter("params", lambda k, v: ~v.eqNullSafe(F.col("before")[k]))
    pre = metrics.filter("phase = 'pre'").filter(F.col("coverage") <= coverage).select("round", "persona", "coverage", "effect_ratio")
    out = steps.withColumn("changes", changed).filter(F.size("changes") > 0).join(pre, ["round", "persona"])
    return out.select("round", "persona", F.array_sort(F.map_keys("changes")).alias("knobs"), "coverage", "effect_ratio")


def knob_evidence(metrics: DataFrame, params: DataFrame) -> DataFrame:
    """Per knob: rounds that changed it, those that lost the effect, best coverage of the rest."""
    j = params_history(params).filter("changed").join(metrics.filter("phase = 'pre'").select("round", "persona", "coverage", "effect_ratio"), ["round", "persona"])
    lost = F.coalesce(F.col("effect_ratio") < EFFECT_FLOOR, F.lit(False))
    return j.groupBy("persona", "knob").agg(F.count(F.lit(1)).alias("tries"), F.count_if(lost).alias("failures"), F.min(F.when(~lost, F.col("coverage"))).alias("best_coverage"))


def mutation_history(metrics: DataFrame, params: DataFrame) -> DataFrame:
    """Per round and persona: knobs changed beside frozen and retrained recall, effect and score."""
    changed = params_history(params).filter("changed").groupBy("round", "persona").agg(F.array_join(F.array_sort(F.collect_set("knob")), ",").alias("knobs"))
    return track_record(metrics, None).filter("round >= 1").drop("age").join(changed, ["round", "persona"], "left")


def run_summary(metrics: DataFrame) -> DataFrame:
    """Average retrained F1 per round with the change since the round before."""
    t = metrics.filter("phase = 'post'").groupBy("round").agg(F.avg("f1").alias("avg_f1"), F.count("f1").alias("personas"))
    w = Window.orderBy("round")
    return t.withColumn("change", F.col("avg_f1") - F.lag("avg_f1").over(w))


def top_flags(flags: DataFrame, n: int = 10, persona: str | None = None, trader: str | None = None) -> DataFrame:
    """Highest scored alerts with the total number that matched."""
    f = flags.filter("final_flag")
    if persona:
        f = f.filter(F.col("predicted_persona") == persona)
    if trader:
        f = f.filter(F.col("trader_id") == trader)
    total = f.agg(F.count(F.lit(1)).alias("total_matches"))
    order = [F.desc("final_score"), "commodity", "window_start", "trader_id"]
    return f.orderBy(*order).limit(n).crossJoin(F.broadcast(total))
