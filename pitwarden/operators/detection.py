"""Detection quality: window, episode and family metrics per persona."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pitwarden.config import FAKE_DEPTH, PERSONAS
from pitwarden.functions.exprs import rnd, safe_div
from pitwarden.operators.labels import episode_accounts
from pitwarden.operators.ranges import overlap_join

KEYS = ("commodity", "window_start", "trader_id")
WEAK_COVERAGE = 0.2


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def long_results(results: DataFrame, labels: DataFrame, personas=PERSONAS) -> DataFrame:
    """One row per (window, persona): truth, own flag, family flag and any alert."""
    joined = results.join(labels.drop("window_end"), list(KEYS))

    def part(p: str) -> Column:
        fam = F.lit(False)
        for m in (FAKE_DEPTH if p in FAKE_DEPTH else (p,)):
            fam = fam | F.col(f"flag_{m}")
        return F.struct(F.lit(p).alias("persona"), (F.col(p) > 0).alias("truth"), F.col(f"flag_{p}").alias("own"), fam.alias("family"))

    extra = [c for c in ("market", "round") if c in results.columns]
    return joined.select(*extra, *KEYS, "window_end", "final_flag", F.explode(F.array(*[part(p) for p in personas])).alias("x")).select(
        *extra, *KEYS, "window_end", "final_flag", "x.*"
    )


def confusion(truth: Column, pred: Column) -> dict[str, Column]:
    return {"tp": F.count_if(truth & pred), "fp": F.count_if(~truth & pred), "fn": F.count_if(truth & ~pred), "tn": F.count_if(~truth & ~pred)}


def prf(tp: Column, fp: Column, fn: Column, digits: int = 4) -> dict[str, Column]:
    """Precision, recall and F1; all missing when there is no positive row."""
    some = (tp + fn) > 0
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    return {n: F.when(some, rnd(v, digits)) for n, v in (("precision", p), ("recall", r), ("f1", f1))}


def row_metrics(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Window-level precision, recall, F1, FPR and support per persona."""
    g = [*(by or []), "persona"]
    counts = long.groupBy(*g).agg(*[c.alias(n) for n, c in confusion(F.col("truth"), F.col("own")).items()])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(*g, *[v.alias(n) for n, v in prf(tp, fp, fn).items()], rnd(_ratio(fp, fp + tn), 4).alias("fpr"), (tp + fn).alias("support"))


def row_metrics_by_market(long: DataFrame, market: str = "commodity") -> DataFrame:
    """The same per market and pooled, in one pass over grouping sets; pooled rows have no market."""
    sets = [["persona"], [market, "persona"]]
    counts = long.groupingSets(sets, "persona", market).agg(
        F.grouping(market).alias("_pooled"), *[c.alias(n) for n, c in confusion(F.col("truth"), F.col("own")).items()]
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    scope = F.when(F.col("_pooled") == 1, "pooled").otherwise(F.col(market)).alias("scope")
    return counts.select(scope, "persona", *[v.alias(n) for n, v in prf(tp, fp, fn).items()], rnd(_ratio(fp, fp + tn), 4).alias("fpr"), (tp + fn).alias("support"))


def episode_hits(long: DataFrame, events: DataFrame) -> DataFrame:
    """Per episode of each persona: flagged windows, labelled windows, first detection, for every flag kind."""
    acc = episode_accounts(events)
    touch = overlap_join(long, acc, ["commodity", "trader_id", "persona"], ("window_start", "window_end"), ("start_tick", "end_tick"))
    kinds = {"own": "own", "family": "family", "caught": "final_flag"}
    late = F.greatest(F.col("window_end") - F.col("start_tick"), F.lit(0))
    aggs = [F.count_if("truth").alias("labelled")]
    for name, flag in kinds.items():
        aggs += [F.count_if(F.col("truth") & F.col(flag)).alias(f"{name}_labelled"), F.min(F.when(F.col(flag), late)).alias(f"{name}_latency")]
    hits = touch.groupBy("event_id").agg(*aggs)
    return events.select("event_id", "commodity", "persona").join(hits, "event_id", "left").fillna(
        0, ["labelled", *[f"{n}_labelled" for n in kinds]]
    )


def episode_metrics(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Detected episodes, latency and coverage per persona, own label / family / any alert."""
    g = [*(by or []), "persona"]
    some = F.col("labelled") > 0

    def share(n: str) -> Column:
        return F.when(some, F.col(f"{n}_labelled") / F.col("labelled"))

    return hits.groupBy(*g).agg(
        F.count(F.lit(1)).alias("events_total"),
        F.count("own_latency").alias("events_detected"),
        rnd(F.avg("own_latency"), 1).alias("detection_latency_ticks"),
        rnd(F.avg(share("own")), 4).alias("episode_coverage"),
        rnd(F.avg(share("family")), 4).alias("family_coverage"),
        rnd(F.avg(share("caught")), 4).alias("caught_coverage"),
        rnd(F.avg(F.when(share("caught") < WEAK_COVERAGE, 1.0).when(some, 0.0)), 4).alias("caught_weak_share"),
        F.count("caught_latency").alias("caught_events_detected"),
        rnd(F.avg("caught_latency"), 1).alias("caught_latency_ticks"),
    )


def family_metrics(results: DataFrame, labels: DataFrame, family=FAKE_DEPTH) -> DataFrame:
    """Family as one class: truth is any member label, prediction an alert named as any member."""
    j = results.join(labels.drop("window_end"), list(KEYS))
    truth = F.greatest(*[F.col(m) for m in family]) > 0
    pred = F.col("final_flag") & F.coalesce(F.col("predicted_persona").isin(*family), F.lit(False))
    c = j.agg(*[v.alias(n) for n, v in confusion(truth, pred).items()])
    tp, fp, fn = (F.col(x) for x in ("tp", "fp", "fn"))
    return c.select(*[v.alias(f"family_{n}") for n, v in prf(tp, fp, fn).items()])


def unsupervised_metrics(results: DataFrame, labels: DataFrame, personas=PERSONAS) -> DataFrame:
    """Forest flag against any manipulation."""
    j = results.join(labels.drop("window_end"), list(KEYS))
    truth = F.greatest(*[F.col(p) for p in personas]) > 0
    c = j.agg(*[v.alias(n) for n, v in confusion(truth, F.col("iso_flag")).items()])
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        rnd(_ratio(tp, tp + fp), 4).alias("precision"), rnd(_ratio(tp, tp + fn), 4).alias("recall"),
        rnd(_ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1"), rnd(_ratio(fp, fp + tn), 4).alias("fpr"), (tp + fn).alias("support"),
    )


def round_metrics(results: DataFrame, labels: DataFrame, events: DataFrame, personas=PERSONAS) -> DataFrame:
    """Window and episode metrics of one scored test set, one row per persona."""
    long = long_results(results, labels, personas)
    return row_metrics(long).join(episode_metrics(episode_hits(long, events)), "persona", "left").fillna(
        0, ["events_total", "events_detected", "caught_events_detected"]
    )
