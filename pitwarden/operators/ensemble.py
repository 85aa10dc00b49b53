"""Combining forest and classifier scores into alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pitwarden.config import DetectorConfig
from pitwarden.functions.exprs import argmax_name, clip, rnd


def _limit(thresholds: dict[str, float], name: str, default: float) -> float:
    return max(thresholds.get(name, default), 1e-6)


def deviating_columns(cfg: DetectorConfig, self_z: list[str]) -> Column:
    """How many self z-scores are beyond the corroboration limit."""
    out = F.lit(0)
    for c in self_z:
        out = out + (F.abs(F.col(c)) >= cfg.min_self_z).cast("int")
    return out


def persona_flags(scores: DataFrame, thresholds: dict[str, float], cfg: DetectorConfig) -> DataFrame:
    """flag_<persona>, with a family flag handed to the member closest to its own threshold."""
    flags = {p: F.col(f"prob_{p}") >= thresholds.get(p, cfg.supervised_threshold) for p in cfg.personas}
    extra = {}
    for fam, members in cfg.families.items():
        if f"prob_{fam}" not in scores.columns:
            continue
        pick = argmax_name([(m, F.col(f"prob_{m}") / _limit(thresholds, m, 1.0)) for m in members])
        hit = F.col(f"prob_{fam}") >= thresholds.get(fam, cfg.supervised_threshold)
        extra[f"_pick_{fam}"], extra[f"_hit_{fam}"] = pick, hit
        for m in members:
            flags[m] = flags[m] | (F.col(f"_hit_{fam}") & (F.col(f"_pick_{fam}") == m))
    return scores.withColumns(extra).withColumns({f"flag_{p}": f for p, f in flags.items()})


def combine(scores: DataFrame, thresholds: dict[str, float], cfg: DetectorConfig | None = None) -> DataFrame:
    """Alerts from scores.

    Needs prob_<persona>, optional prob_<family>, iso_score and n_dev (self z-scores beyond
    the corroboration limit).  Rules: 'or', 'or_corroborated', 'weighted'.
    """
    cfg = cfg or DetectorConfig()
    df = persona_flags(scores, thresholds, cfg).withColumn("iso_flag", F.col("iso_score") >= 1.0 - cfg.contamination)
    probs = [F.col(f"prob_{p}") for p in cfg.personas]
    any_flag = F.lit(False)
    for p in cfg.personas:
        any_flag = any_flag | F.col(f"flag_{p}")
    margins = [(p, F.col(f"prob_{p}") - thresholds.get(p, 1.0)) for p in cfg.personas]
    ratio = F.greatest(*[F.col(f"prob_{p}") / _limit(thresholds, p, 1.0) for p in cfg.personas])
    corroborated = (ratio >= cfg.min_prob_ratio) | (F.col("n_dev") >= cfg.min_self_z_cols)
    best_prob = F.greatest(*probs)
    df = df.withColumn("sup_flag", any_flag)
    name = F.when(F.col("sup_flag"), argmax_name(margins)).when(F.col("iso_flag"), "anomaly")
    for fam in cfg.families:
        if f"_hit_{fam}" in df.columns:
            only_family = F.col(f"_hit_{fam}") & (F.greatest(*[m for _, m in margins]) < 0)
            name = F.when(only_family, F.col(f"_pick_{fam}")).otherwise(name)
    if cfg.rule == "weighted":
        score = clip(cfg.iso_weight * F.col("iso_score") + cfg.supervised_weight * best_prob, 0.0, 1.0)
        final = F.col("sup_flag") | (score > 0.5)
    else:
        iso_alert = F.col("iso_flag") & (corroborated if cfg.rule == "or_corroborated" else F.lit(True))
        score = clip(F.greatest(best_prob, F.when(iso_alert, F.col("iso_score")).otherwise(0.0)), 0.0, 1.0)
        final = F.col("sup_flag") | iso_alert
    df = df.withColumns({"final_score": score, "final_flag": final})
    df = df.withColumn("alert_tier", F.when(F.col("final_flag"), "alert").when(F.col("iso_flag"), "review").otherwise("none"))
    triggers = [F.when(F.col(f"flag_{p}"), F.lit(f"{p}_classifier")) for p in cfg.personas]
    return df.withColumns({
        "predicted_persona": F.when(F.col("alert_tier") != "review", name),
        "triggered_by": F.array_compact(F.array(*triggers, F.when(F.col("iso_flag"), F.lit("isolation_forest")))),
    }).drop(*[c for c in df.columns if c.startswith(("_pick_", "_hit_"))])


def flags_table(alerts: DataFrame, cfg: DetectorConfig | None = None, top: str | None = None) -> DataFrame:
    """The published flags table; ``top`` names a map column of attributions."""
    cfg = cfg or DetectorConfig()
    scores = F.map_from_arrays(
        F.array(*[F.lit(p) for p in cfg.personas]), F.array(*[rnd(f"prob_{p}", 4) for p in cfg.personas])
    )
    empty = F.create_map().cast("map<string,double>")
    return alerts.select(
        "commodity", F.col("window_start").cast("long"), "trader_id", F.col("window_end").cast("long"), "final_flag", "final_score",
        "iso_score", "predicted_persona", "triggered_by", (F.col(top) if top else empty).alias("top_shap_features"),
        scores.alias("persona_scores"), "alert_tier",
    )


def rebuild_flags(flags: DataFrame, thresholds: dict[str, float], cfg: DetectorConfig | None = None) -> DataFrame:
    """prob_/flag_<persona> columns again from a stored flags table and its thresholds."""
    cfg = cfg or DetectorConfig()
    probs = {f"prob_{p}": F.coalesce(F.element_at("persona_scores", p), F.lit(0.0)) for p in cfg.personas}
    return flags.withColumns(probs).withColumns({f"flag_{p}": F.col(f"prob_{p}") >= thresholds.get(p, 1.0) for p in cfg.personas})
