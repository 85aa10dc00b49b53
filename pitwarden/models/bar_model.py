"""Per-persona classifiers on bar features over several markets, with thresholds under an alert budget.

Markets are stacked with their number, and their segments are renumbered so that smoothing never crosses from one market
to another. Held-out scores (markets in folds) choose each persona's threshold; all fits are tasks of one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pitwarden.config import PERSONAS
from pitwarden.functions.exprs import argmax_name, rnd
from pitwarden.models import thresholds as th
from pitwarden.models.trees import Boosted, TreeConfig, fit_many, packed, with_probabilities
from pitwarden.operators.bar_features import FEATURES
from pitwarden.operators.lineage import cut

SEGMENT_STEP = 1_000_000  # between the segment numbers of two markets
KEYS = ["market", "commodity", "segment", "minute"]


@dataclass(frozen=True)
class BarModelConfig:
    personas: tuple[str, ...] = PERSONAS
    trees: TreeConfig = TreeConfig(rounds=250, depth=3, min_gain=0.0, l1=0.0, min_child=2.0)
    min_positives: int = 10
    max_class_weight: float = 50.0
    folds: int = 3
    smooth_minutes: int = 5
    alert_budget: float = 0.02
    default_threshold: float = 0.5
    max_training_rows: int = 200_000  # of one fit; beyond it a hash thins all rows alike


@dataclass(frozen=True)
class BarModel:
    models: dict[str, Boosted]
    thresholds: dict[str, float]
    skill: DataFrame | None  # held-out, one row per persona
    cfg: BarModelConfig


def stack_markets(markets: list[DataFrame]) -> DataFrame:
    """Labelled bar features of several markets as one table: ``market`` is the place in the list, segments are unique."""
    out = None
    for i, m in enumerate(markets):
        part = m.withColumns({"market": F.lit(i), "segment": F.col("segment").cast("long") + SEGMENT_STEP * i})
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no market to stack")
    return out


def _fits(counts: dict[str, tuple[int, int]], cfg: BarModelConfig) -> Column:
    """Per row its fits: one for each persona and fold it is not held out in (fold ``cfg.folds``: none is)."""
    out = []
    for i, (name, (n, positives)) in enumerate(counts.items()):
        label = (F.col(name) == 1).cast("int")
        lift = min(cfg.max_class_weight, (n - positives) / max(1, positives))
        drawn = F.pmod(F.xxhash64(F.lit(cfg.trees.seed), *KEYS), F.lit(1 << 30)) < int(min(1.0, cfg.max_training_rows / n) * (1 << 30))
        weight = F.when(label == 1, max(1.0, lift)).otherwise(1.0)
        out += [F.when(drawn & (F.col("fold") != k), F.struct(F.lit(i * (cfg.folds + 1) + k).alias("fit"), label.alias("label"), weight.alias("weight"))) for k in range(cfg.folds + 1)]
    return F.filter(F.array(*out), lambda s: s.isNotNull())


def fit_bar_model(rows: DataFrame, cfg: BarModelConfig | None = None, columns: list[str] | None = None) -> BarModel:
    """``rows``: market, commodity, segment, minute, the feature columns and a 0/1 column per persona."""
    cfg, columns = cfg or BarModelConfig(), columns or list(FEATURES)
    names = [p for p in cfg.personas if p in rows.columns]
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("market").alias("markets"), *[F.count_if(F.col(p) == 1).alias(p) for p in names]).first()
    counts = {p: (got["n"], got[p]) for p in names if cfg.min_positives <= got[p] < got["n"]}
    if not counts:
        return BarModel({}, {}, None, cfg)
    folded = cut(th.group_folds(rows, "market", min(cfg.folds, max(1, got["markets"]))))
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in KEYS]).alias("key")
    asked = folded.select(key, packed(columns).cast("array<float>").alias("x"), F.explode(_fits(counts, cfg)).alias("f")).select("f.fit", "key", "f.label", "f.weight", "x")
    fitted = fit_many(asked, columns, len(counts) * (cfg.folds + 1), cfg.trees)
    of = lambda i, k: fitted.get(i * (cfg.folds + 1) + k)
    models = {p: of(i, cfg.folds) for i, p in enumerate(counts)}
    if got["markets"] < 2:
        return BarModel(models, dict.fromkeys(models, cfg.default_threshold), None, cfg)
    held = None
    for k in range(min(cfg.folds, got["markets"])):
        part = folded.filter(F.col("fold") == k)
        own = {p: of(i, k) for i, p in enumerate(counts) if of(i, k) is not None}
        part = with_probabilities(part, own) if own else part
        # Without a positive in the other markets a persona scores 0 here.
        part = part.withColumns({f"prob_{p}": F.lit(0.0) for p in counts if p not in own}).select(*KEYS, *counts, *[f"prob_{p}" for p in counts])
        held = part if held is None else held.unionByName(part)
    held = cut(th.smooth_probabilities(held, [f"prob_{p}" for p in counts], cfg.smooth_minutes, ("market", "commodity", "segment")))
    chosen = {p: th.budget_threshold(held, f"prob_{p}", p, cfg.alert_budget).first()["threshold"] for p in counts}
    return BarModel(models, chosen, skill_table(held, chosen), cfg)


def skill_table(scored: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """One row of skill measures per persona of ``scored`` (prob_<persona> and <persona>)."""
    out = None
    for p, t in thresholds.items():
        part = th.skill(scored.withColumn("persona", F.lit(p)), f"prob_{p}", p, t, ["persona"])
        out = part if out is None else out.unionByName(part)
    return out


def judge(scored: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """``scored`` with rounded probabilities, margin, flag and predicted persona: the largest margin over its threshold."""
    margins = [(p, F.col(f"prob_{p}") - F.lit(t)) for p, t in thresholds.items()]
    best = F.greatest(*[m for _, m in margins]) if len(margins) > 1 else margins[0][1]
    out = scored.withColumns({"margin": rnd(best, 4) + 0.0, "_name": argmax_name(margins) if len(margins) > 1 else F.lit(margins[0][0])})
    out = out.withColumn("flag", F.col("margin") >= 0).withColumn("predicted_persona", F.when(F.col("flag"), F.col("_name")))
    return out.withColumns({f"prob_{p}": rnd(f"prob_{p}", 4) + 0.0 for p in thresholds}).drop("_name")


def score_bars(features: DataFrame, model: BarModel, keys: tuple[str, ...] = ("commodity", "segment")) -> DataFrame:
    """Every minute with its smoothed probabilities and the model's judgement; without classifiers nothing is flagged."""
    if not model.models:
        return features.withColumns({"flag": F.lit(False), "predicted_persona": F.lit(None).cast("string"), "margin": F.lit(0.0)})
    scored = with_probabilities(features, model.models)
    return judge(th.smooth_probabilities(scored, [f"prob_{p}" for p in model.models], model.cfg.smooth_minutes, keys), model.thresholds)


def evaluate(rows: DataFrame, model: BarModel) -> DataFrame:
    """Skill on labelled bars of other markets."""
    scored = th.smooth_probabilities(with_probabilities(rows, model.models), [f"prob_{p}" for p in model.models], model.cfg.smooth_minutes)
    return skill_table(cut(scored), model.thresholds)
