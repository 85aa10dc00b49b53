"""Scoring of replayed cases: one market and one known episode each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pitwarden.config import FAKE_DEPTH, LABEL_MIN_OVERLAP
from pitwarden.functions.exprs import rnd


def window_outcomes(windows: DataFrame, cases: DataFrame) -> DataFrame:
    """Outcome of each scored window of a replayed market.

    ``windows`` carry market; ``cases`` one row per market: case, label, trader_ids, span.
    """
    c = cases.select("market", "case", F.col("persona").alias("label"), "start_tick", "end_tick", "trader_ids")
    j = windows.filter(~F.col("trader_id").startswith("mm_")).join(c, "market")
    overlap = F.least("window_end", "end_tick") - F.greatest("window_start", "start_tick")
    own = F.array_contains("trader_ids", F.col("trader_id"))
    flag, right = F.col("final_flag"), F.coalesce(F.col("predicted_persona") == F.col("label"), F.lit(False))
    j = j.withColumns({"is_case": own, "in_episode": own & (overlap >= LABEL_MIN_OVERLAP), "right_label": right})
    inside = F.col("in_episode")
    outcome = (
        F.when(inside & flag & right, "TP right label").when(inside & flag, "TP wrong label").when(inside, "FN missed")
        .when(flag & F.col("is_case"), "FP case account outside episode").when(flag, "FP legitimate account").otherwise("TN")
    )
    return j.withColumn("outcome", outcome)


def _prf(tp, fp, fn, suffix: str = "") -> list:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    return [rnd(v, 4).alias(f"{n}{suffix}") for n, v in (("precision", p), ("recall", r), ("f1", f1))]


def score_markets(outcomes: DataFrame) -> DataFrame:
    """One row per market: caught, recognised, label share, first alert and false-alarm rate."""
    k = ["market", "case", "label"]
    hit = F.col("in_episode") & F.col("final_flag")
    fam = F.when(F.col("label").isin(*FAKE_DEPTH), F.col("predicted_persona").isin(*FAKE_DEPTH)).otherwise(F.col("right_label"))
    fam = hit & F.coalesce(fam, F.lit(False))
    legit = F.col("final_flag") & ~F.col("is_case")
    g = outcomes.groupBy(*k).agg(
        F.count_if("in_episode").alias("episode_windows"), F.count_if(hit).alias("tp"), F.count_if(F.col("in_episode") & ~F.col("final_flag")).alias("fn"),
        F.count_if(~F.col("in_episode") & F.col("final_flag")).alias("fp"), F.count_if(hit & F.col("right_label")).alias("tp_right_label"), F.count_if(fam).alias("tp_family"),
        F.min(F.when(hit, F.col("window_end") - F.col("start_tick"))).alias("first_alert"), F.count_if(legit).alias("legit"),
        ((F.max("window_end") - F.min("window_start")) / 3600.0).alias("hours"),
    )
    tp, fp, fn, tr = (F.col(c) for c in ("tp", "fp", "fn", "tp_right_label"))
    return g.select(
        *k, "episode_windows", "tp", "fp", "fn", "tp_right_label", (tp > 0).alias("caught"), (tr > 0).alias("recognised"), (F.col("tp_family") > 0).alias("recognised_family"),
        F.when(tp > 0, rnd(F.col("tp_family") / tp, 4)).otherwise(0.0).alias("label_share"), rnd(tp / F.greatest("episode_windows", F.lit(1)), 4).alias("window_recall"),
        F.col("first_alert").alias("first_alert_s"), rnd(F.col("legit") / F.greatest("hours", F.lit(1e-9)), 2).alias("legit_alerts_h"),
        *_prf(tp, fp, fn), *_prf(tr, fp + tp - tr, fn + tp - tr, "_right_label"),
    )


def summarise(scores: DataFrame, by: list[str]) -> DataFrame:
    """Means and medians over the markets of a case and round."""
    def share(c):
        return rnd(F.avg(F.col(c).cast("double")), 4).alias(c)

    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("markets"), share("caught"), share("recognised"), share("recognised_family"), share("label_share"), share("window_recall"),
        F.median("first_alert_s").alias("first_alert_s"), share("legit_alerts_h"),
    )


def pooled(scores: DataFrame, by: list[str]) -> DataFrame:
    """Window metrics from summed counts."""
    g = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("markets"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tp_right_label")])
    tp, fp, fn, tr = (F.col(c) for c in ("tp", "fp", "fn", "tp_right_label"))
    return g.select(*by, "markets", "tp", "fp", "fn", "tp_right_label", *_prf(tp, fp, fn), *_prf(tr, fp + tp - tr, fn + tp - tr, "_right_label"))


def forgetting(by_round: DataFrame, limit: float = 0.25) -> DataFrame:
    """Cases recognised clearly less often than in the round checked before."""
    w = Window.partitionBy("case").orderBy("round")
    before = F.lag("recognised_family").over(w)
    return by_round.withColumn("before", before).withColumn("forgotten", F.coalesce(F.col("recognised_family") < F.col("before") - limit, F.lit(False)))


def heldout_rates(episode_metrics: DataFrame) -> DataFrame:
    """Share of held-out episodes detected, per persona."""
    return episode_metrics.select("persona", F.when(F.col("events_total") > 0, rnd(F.col("events_detected") / F.col("events_total"), 4)).alias("detection_rate"))
