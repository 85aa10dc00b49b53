"""Alert cases: merged windows, their match with known episodes, counters and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pitwarden.config import FAKE_DEPTH, DetectorConfig
from pitwarden.functions.exprs import rnd
from pitwarden.operators.islands import number_islands
from pitwarden.operators.labels import episode_accounts
from pitwarden.operators.ranges import overlap_join

CASE_KEYS = ("commodity", "trader_id", "persona")


def build_cases(flags: DataFrame) -> DataFrame:
    """Touching or overlapping alerted windows of one account and persona become one case.

    Score, attribution and persona scores come from the first window with the top score.
    """
    alerted = flags.filter("final_flag AND predicted_persona IS NOT NULL").withColumnRenamed("predicted_persona", "persona")
    numbered = number_islands(alerted, list(CASE_KEYS), "window_start", "window_end", slack=1)
    extra = [c for c in ("top_shap_features", "persona_scores", "iso_score") if c in flags.columns]
    best = F.max_by(F.struct("final_score", *extra), F.struct("final_score", -F.col("window_start")))
    cases = numbered.groupBy(*CASE_KEYS, "island").agg(
        F.min("window_start").alias("start_tick"), F.max("window_end").alias("end_tick"),
        F.count(F.lit(1)).alias("n_windows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("triggered_by")))).alias("triggered_by"),
        best.alias("_best"),
    )
    case_id = F.concat_ws("~", *CASE_KEYS, F.col("start_tick").cast("string"), F.col("end_tick").cast("string"))
    return cases.select(
        case_id.alias("case_id"), *CASE_KEYS, "start_tick", "end_tick", F.col("_best.final_score").alias("score"),
        "n_windows", "triggered_by", *[F.col(f"_best.{c}").alias(c) for c in extra],
    )


def parse_case_id(df: DataFrame, col: str = "case_id") -> DataFrame:
    """Split 'commodity~trader~persona~start~end' back into typed columns."""
    p = F.split(col, "~")
    return df.select(
        col, p[0].alias("commodity"), p[1].alias("trader_id"), p[2].alias("persona"),
        p[3].cast("long").alias("start_tick"), p[4].cast("long").alias("end_tick"),
    )


def match_cases(cases: DataFrame, events: DataFrame, cfg: DetectorConfig | None = None) -> DataFrame:
    """Attach the first overlapping episode (by event id), else the first one within the edge margin."""
    cfg = cfg or DetectorConfig()
    spans = cases.select("case_id", "commodity", "trader_id", "start_tick", "end_tick").withColumnsRenamed(
        {"start_tick": "case_start", "end_tick": "case_end"}
    )
    near = overlap_join(
        spans, episode_accounts(events), ["commodity", "trader_id"], ("case_start", "case_end"), ("start_tick", "end_tick"), slack=cfg.edge_ticks
    )
    touching = (F.col("case_end") >= F.col("start_tick")) & (F.col("case_start") <= F.col("end_tick"))
    best = near.groupBy("case_id").agg(
        F.min(F.when(touching, F.struct("event_id", F.col("persona").alias("gt_persona")))).alias("hit"),
        F.min("event_id").alias("near_event"),
    )
    joined = cases.join(best, "case_id", "left").withColumns({
        "gt_event": F.col("hit.event_id"), "gt_persona": F.col("hit.gt_persona"),
        "near_event": F.when(F.col("hit").isNull(), F.col("near_event")),
        "tier": F.when(F.col("n_windows") >= cfg.min_case_windows, "case").otherwise("brief"),
    })
    status = (
        F.when(F.col("near_event").isNotNull(), "near_episode").when(F.col("gt_event").isNull(), "no_episode")
        .when(F.col("gt_persona") == F.col("persona"), "confirmed").otherwise("other_persona")
    )
    return joined.withColumn("status", status).drop("hit")


def missed_episodes(matched: DataFrame, events: DataFrame) -> DataFrame:
    """Episodes no full case of the right persona caught; brief_only when a brief alert did."""
    right = matched.filter("status = 'confirmed'")
    caught = right.filter("tier = 'case'").select(F.col("gt_event").alias("event_id")).distinct()
    brief = right.filter("tier = 'brief'").select(F.col("gt_event").alias("event_id"), F.lit(True).alias("brief_only")).distinct()
    return (
        events.join(caught, "event_id", "left_anti").join(brief, "event_id", "left")
        .select("event_id", "persona", "commodity", "start_tick", "end_tick", F.coalesce("brief_only", F.lit(False)).alias("brief_only"))
    )


def case_counters(matched: DataFrame, missed: DataFrame, flags: DataFrame, cfg: DetectorConfig | None = None) -> DataFrame:
    """One row of case counters."""
    cfg = cfg or DetectorConfig()
    named, full = F.col("persona") != "anomaly", F.col("tier") == "case"

    def n(cond, name):
        return F.count_if(cond).alias(name)

    def st(s):
        return F.col("status") == s

    sibling = F.col("gt_persona").isin(*FAKE_DEPTH) & F.col("persona").isin(*FAKE_DEPTH) & (F.col("gt_persona") != F.col("persona"))
    a = matched.agg(
        n(named & full, "persona_cases"), n(named & full & st("confirmed"), "confirmed"), n(named & full & st("no_episode"), "no_episode"),
        n(named & full & st("other_persona"), "other_persona"), n(named & full & st("near_episode"), "near_episode"),
        n(named & ~full, "brief"), n(named & ~full & st("confirmed"), "brief_confirmed"), n(named & ~full & st("no_episode"), "brief_no_episode"),
        n(~named & full, "anomalies"), n(~named & full & F.col("gt_event").isNotNull(), "anomalies_on_episode"),
        n(named & full & F.coalesce(sibling, F.lit(False)), "sibling_label"),
    )
    b = missed.agg(F.count(F.lit(1)).alias("missed"), n(F.col("brief_only"), "missed_brief"))
    c = flags.agg(n(F.col("alert_tier") == "review", "review_windows"), F.count(F.lit(1)).alias("windows"), n(F.col("final_flag"), "alert_windows"))
    rows = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))
    return rows.withColumn("min_case_windows", F.lit(cfg.min_case_windows))


def account_rollup(matched: DataFrame) -> DataFrame:
    """One row per flagged account, persona and market: case statuses, span and top score."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("confirmed", "other_persona", "near_episode", "no_episode")]
    return matched.groupBy("commodity", "trader_id", "persona").agg(
        F.count(F.lit(1)).alias("cases"), F.sum("n_windows").alias("windows"), F.max("score").alias("max_score"),
        F.min("start_tick").alias("first_tick"), F.max("end_tick").alias("last_tick"), *counts,
    )


def account_profiles(matched: DataFrame, flags: DataFrame, status: str | None = None, k: int = 3, top: str = "top_shap_features") -> DataFrame:
    """The roll-up with what drove each account's alerts and which other persona its episodes had.

    ``other_truth`` is the persona of its latest case on an episode of another persona, else missing. ``top_features`` maps
    the ``k`` features of largest summed absolute attribution to their mean over the account's alerted windows; windows
    without an attribution of a feature do not count for it. ``status`` keeps accounts with at least one such case;
    ``only_status`` says whether all their cases have it (missing without a filter).
    """
    keys = list(CASE_KEYS)
    other = F.when(F.col("gt_event").isNotNull() & (F.col("gt_persona") != F.col("persona")), F.col("gt_persona"))
    truth = matched.groupBy(*keys).agg(F.max_by(other, F.when(other.isNotNull(), F.col("start_tick"))).alias("other_truth"))
    rows = account_rollup(matched).join(truth, keys)
    if status:
        rows = rows.filter(F.col(status) > 0).withColumn("only_status", F.col(status) == F.col("cases"))
    else:
        rows = rows.withColumn("only_status", F.lit(None).cast("boolean"))
    alerted = flags.filter("final_flag AND predicted_persona IS NOT NULL").withColumnRenamed("predicted_persona", "persona")
    per = alerted.select(*keys, F.explode(top).alias("feature", "value")).filter("value IS NOT NULL").groupBy(*keys, "feature").agg(
        rnd(F.sum(F.abs("value")), 6).alias("weight"), F.avg("value").alias("mean"))
    # One entry per feature column, so the list is as short as the list of columns.
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "feature", "mean"))), 1, k)
    best = per.groupBy(*keys).agg(F.map_from_entries(F.transform(ranked, lambda x: F.struct(x["feature"], x["mean"]))).alias("top_features"))
    return rows.join(best, keys, "left")


def account_status_counts(rollup: DataFrame) -> DataFrame:
    """Confirmed, other-persona-only and false-alarm-only accounts, and those with any false alarm."""
    conf, other = F.col("confirmed") > 0, F.col("other_persona") > 0
    return rollup.agg(
        F.count_if(conf).alias("accounts_confirmed"), F.count_if(~conf & other).alias("accounts_other_persona_only"),
        F.count_if(~conf & ~other).alias("accounts_only_false_alerts"), F.count_if(F.col("no_episode") > 0).alias("accounts_with_any_false_alert"),
    )


def confidence_band(margin):
    """Named band of a score's distance above its threshold."""
    m = F.col(margin) if isinstance(margin, str) else margin
    return F.when(m >= 0.4, "very high").when(m >= 0.2, "high").when(m >= 0.05, "moderate").otherwise("borderline")


def case_prices(cases: DataFrame, tick_prices: DataFrame, pad: int = 120) -> DataFrame:
    """Last price of every tick of the market inside each padded case span."""
    spans = cases.select("case_id", "commodity", "start_tick", "end_tick")
    return overlap_join(spans, tick_prices, ["commodity"], ("start_tick", "end_tick"), ("tick", "tick"), slack=pad)


def case_price_range(cases: DataFrame, tick_prices: DataFrame, pad: int = 120) -> DataFrame:
    """(case_id, ticks, low, high): ticks that traded, lowest and highest last price of the market inside each padded case span.

    All cases of a market with the same span see the same prices, so only distinct spans meet them.
    """
    span = ["commodity", "start_tick", "end_tick"]
    hit = overlap_join(cases.select(*span).distinct(), tick_prices, ["commodity"], ("start_tick", "end_tick"), ("tick", "tick"), slack=pad)
    seen = hit.groupBy(*span).agg(F.count(F.lit(1)).alias("ticks"), F.min("price").alias("low"), F.max("price").alias("high"))
    return cases.select("case_id", *span).join(seen, span).drop(*span)


def case_fills(cases: DataFrame, trades: DataFrame, pad: int = 120) -> DataFrame:
    """The account's own buys and sells inside each padded case span."""
    side = F.explode(F.array(
        F.struct(F.col("buyer_trader_id").alias("trader_id"), F.lit("buy").alias("side")),
        F.struct(F.col("seller_trader_id").alias("trader_id"), F.lit("sell").alias("side")),
    ))
    own = trades.select("commodity", "tick", "price", "quantity", side.alias("x")).select("commodity", "tick", "price", "quantity", "x.*")
    spans = cases.select("case_id", "commodity", "trader_id", "start_tick", "end_tick")
    return overlap_join(spans, own, ["commodity", "trader_id"], ("start_tick", "end_tick"), ("tick", "tick"), slack=pad)


def minute_cases(scores: DataFrame, personas: tuple[str, ...], gap: int = 2) -> DataFrame:
    """Flagged minutes at most ``gap`` apart become one window; its persona by vote."""
    flagged = scores.filter("flag")
    numbered = number_islands(flagged, ["commodity", "segment"], "minute", "minute", slack=gap)
    votes = numbered.groupBy("commodity", "segment", "island", "predicted_persona").agg(
        F.count(F.lit(1)).alias("votes"), F.min("minute").alias("first_vote")
    )
    pick = votes.groupBy("commodity", "segment", "island").agg(
        F.max_by("predicted_persona", F.struct("votes", -F.col("first_vote"))).alias("model_persona")
    )
    body = numbered.groupBy("commodity", "segment", "island").agg(
        F.min("minute").alias("start_minute"), F.max("minute").alias("end_minute"), F.count(F.lit(1)).alias("flagged_minutes"),
        F.max("margin").alias("model_margin"), *[F.max(f"prob_{p}").alias(f"_max_{p}") for p in personas],
    )
    prob = F.lit(None).cast("double")
    for p in personas:
        prob = F.when(F.col("model_persona") == p, F.col(f"_max_{p}")).otherwise(prob)
    return body.join(pick, ["commodity", "segment", "island"]).select(
        "commodity", "segment", "start_minute", "end_minute", (F.col("end_minute") - F.col("start_minute") + 1).alias("minutes"),
        "flagged_minutes", "model_persona", rnd(prob, 4).alias("model_probability"), rnd("model_margin", 4).alias("model_margin"),
    )


def caught_by(flags: DataFrame, events: DataFrame) -> DataFrame:
    """Per persona: windows of its episodes' accounts, caught share and label mix of the catches."""
    keys = ("commodity", "window_start", "trader_id")
    f = flags.select(*keys, "window_end", "final_flag", "predicted_persona")
    touch = overlap_join(f, episode_accounts(events), ["commodity", "trader_id"], ("window_start", "window_end"), ("start_tick", "end_tick"))
    rows = touch.groupBy(*keys, "persona").agg(F.first("final_flag").alias("final_flag"), F.first("predicted_persona").alias("label"))
    own = F.col("final_flag") & F.coalesce(F.col("label") == F.col("persona"), F.lit(False))
    anomaly = F.col("final_flag") & F.coalesce(F.col("label") == "anomaly", F.lit(False))
    caught = F.count_if(F.col("final_flag"))
    return rows.groupBy("persona").agg(
        F.count(F.lit(1)).alias("windows"), rnd(caught / F.count(F.lit(1)), 3).alias("caught_share"),
        F.count_if(own).alias("own_label"), F.count_if(anomaly).alias("anomaly"),
        F.count_if(F.col("final_flag") & ~own & ~anomaly).alias("other_persona"),
    )


def caught_features(flags: DataFrame, events: DataFrame, k: int = 5, top: str = "top_shap_features") -> DataFrame:
    """(persona, feature, share): the ``k`` largest shares of absolute attribution over the caught windows of its episodes' accounts."""
    keys = ("commodity", "window_start", "trader_id")
    caught = flags.filter("final_flag").select(*keys, "window_end", top)
    touch = overlap_join(caught, episode_accounts(events), ["commodity", "trader_id"], ("window_start", "window_end"), ("start_tick", "end_tick"))
    rows = touch.groupBy(*keys, "persona").agg(F.first(top).alias("top"))
    weights = rows.select("persona", F.explode("top").alias("feature", "value")).filter("value IS NOT NULL")
    weights = weights.groupBy("persona", "feature").agg(F.sum(F.abs("value")).alias("weight"))
    # From here on one row per persona and feature column.
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("persona"))
    place = F.row_number().over(Window.partitionBy("persona").orderBy(F.desc("rounded"), "feature"))
    shares = weights.withColumn("share", share).withColumn("rounded", rnd("share", 6))
    return shares.withColumn("place", place).filter(F.col("place") <= k).select("persona", "feature", rnd("share", 3).alias("share"))


def attribution_mix(flags: DataFrame, top: str = "top_shap_features") -> DataFrame:
    """Share of the summed absolute attribution per feature over alerted windows."""
    weights = flags.filter("final_flag").select(F.explode(top).alias("feature", "value")).groupBy("feature").agg(
        F.sum(F.abs("value")).alias("weight")
    )
    total = weights.agg(F.sum("weight").alias("total"))
    return weights.crossJoin(F.broadcast(total)).select("feature", (F.col("weight") / F.col("total")).alias("share"))


def case_rows(cases: DataFrame, orders: DataFrame, limit: int = 500) -> DataFrame:
    """First rows of the account's own order events in each case span, with the total count.

    The limit is the page size of the report; ``total`` counts every row.
    """
    spans = cases.select("case_id", "commodity", "trader_id", "start_tick", "end_tick")
    rows = overlap_join(spans, orders, ["commodity", "trader_id"], ("start_tick", "end_tick"), ("tick", "tick"))
    total = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy("case_id").orderBy("tick", "order_id", "event_type")
    return rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).join(total, "case_id")
