"""Ensemble, alert-case and case-match queries."""

from pyspark.sql import functions as F

from pitwarden.config import PERSONAS, DetectorConfig
from pitwarden.operators import cases as cs, ensemble as en
from pitwarden.operators.effect import tick_prices
from pitwarden.operators.lineage import cut
from pitwarden.plans.labelling import episodes, scored
from pitwarden.plans.registry import query
from pitwarden.plans.shaping import rounded
from pitwarden.plans.sql import EPISODES, LAST_PRICE, SCORED, TRADES, with_ctes
from pitwarden.sources import derived

THR = derived.THRESHOLDS
CFG = DetectorConfig(contamination=0.05)


def _names(exprs: list[tuple[str, str]]) -> str:
    best = "greatest(" + ", ".join(e for _, e in exprs) + ")"
    return "CASE " + " ".join(f"WHEN {e} = {best} THEN '{n}'" for n, e in exprs) + " END"


_ratios = [(m, f"prob_{m} / {THR[m]}::DOUBLE") for m in ("spoofing", "layering")]
_margins = [(p, f"prob_{p} - {THR[p]}::DOUBLE") for p in PERSONAS]
_max_ratio = "greatest(" + ", ".join(f"prob_{p} / {THR[p]}::DOUBLE" for p in PERSONAS) + ")"
_probs = ", ".join(f"prob_{p}" for p in PERSONAS)


def ensemble_sql(rule: str) -> str:
    own = ", ".join(
        f"prob_{p} >= {THR[p]}" + (f" OR (fam AND pick = '{p}')" if p in ("spoofing", "layering") else "") + f" AS flag_{p}" for p in PERSONAS)
    iso = {"or": "iso_flag", "or_corroborated": f"iso_flag AND ({_max_ratio} >= 0.5 OR n_dev >= 3)", "weighted": "false"}[rule]
    if rule == "weighted":
        score = f"least(0.4::DOUBLE * iso_score + 0.6::DOUBLE * greatest({_probs}), 1.0)"
        final = f"sup_flag OR {score} > 0.5"
    else:
        score = f"least(greatest({_probs}, CASE WHEN {iso} THEN iso_score ELSE 0.0 END), 1.0)"
        final = f"sup_flag OR ({iso})"
    trig = ", ".join(f"CASE WHEN flag_{p} THEN '{p}_classifier' END" for p in PERSONAS)
    return f"""e0 AS (SELECT *, prob_fake_depth >= {THR['fake_depth']} AS fam, {_names(_ratios)} AS pick, iso_score >= 1.0 - 0.05::DOUBLE AS iso_flag FROM scored),
e1 AS (SELECT *, {own} FROM e0),
e2 AS (SELECT *, {' OR '.join(f'flag_{p}' for p in PERSONAS)} AS sup_flag FROM e1),
e3 AS (SELECT *, {score} AS final_score, {final} AS final_flag,
  CASE WHEN fam AND greatest({', '.join(e for _, e in _margins)}) < 0 THEN pick WHEN sup_flag THEN {_names(_margins)} WHEN iso_flag THEN 'anomaly' END AS named FROM e2),
results AS (SELECT * EXCLUDE (named, fam, pick), CASE WHEN final_flag THEN 'alert' WHEN iso_flag THEN 'review' ELSE 'none' END AS alert_tier,
  CASE WHEN final_flag OR NOT iso_flag THEN named END AS predicted_persona,
  list_filter([{trig}, CASE WHEN iso_flag THEN 'isolation_forest' END], lambda x: x IS NOT NULL) AS triggered_by FROM e3)"""


RESULT_CTES = [TRADES, SCORED, ensemble_sql("or_corroborated")]
OUT = ["commodity", "window_start", "trader_id", "window_end", *[f"flag_{p}" for p in PERSONAS], "iso_flag", "sup_flag", "final_flag",
       "final_score", "alert_tier", "predicted_persona"]


def results(spark, sf_dir, rule="or_corroborated"):
    return en.combine(scored(spark, sf_dir), THR, DetectorConfig(contamination=0.05, rule=rule))


def _ensemble_query(rule: str):
    def plan(spark, sf_dir):
        df = results(spark, sf_dir, rule).withColumn("triggers", F.array_join("triggered_by", ","))
        return rounded(df.select(*OUT, "triggers"))

    cols = ", ".join(c if c != "final_score" else "floor(final_score * 1e6 + 0.5) / 1e6 AS final_score" for c in OUT)
    sql = with_ctes(TRADES, SCORED, ensemble_sql(rule)) + f"SELECT {cols}, array_to_string(triggered_by, ',') AS triggers FROM results"
    query(f"ensemble_{rule}", sql, "M1 M2 M3 M4 M5")(plan)


for _rule in ("or", "or_corroborated", "weighted"):
    _ensemble_query(_rule)


@query("flags_table", with_ctes(*RESULT_CTES) + """SELECT commodity, window_start, trader_id, window_end, final_flag, final_score, iso_score, predicted_persona, alert_tier,
  array_to_string(triggered_by, ',') AS triggers, prob_spoofing AS s_spoofing, prob_layering AS s_layering FROM results""", "M6 F3")
def flags_table(spark, sf_dir):
    f = en.flags_table(results(spark, sf_dir), CFG)
    return f.select(
        "commodity", "window_start", "trader_id", "window_end", "final_flag", "final_score", "iso_score", "predicted_persona", "alert_tier",
        F.array_join("triggered_by", ",").alias("triggers"), F.element_at("persona_scores", "spoofing").alias("s_spoofing"),
        F.element_at("persona_scores", "layering").alias("s_layering"),
    )


@query("rebuilt_flags", with_ctes(*RESULT_CTES) + "SELECT commodity, window_start, trader_id, "
       + ", ".join(f"prob_{p} >= {THR[p]} AS flag_{p}" for p in PERSONAS) + " FROM results", "M15 M1")
def rebuilt_flags(spark, sf_dir):
    f = en.rebuild_flags(en.flags_table(results(spark, sf_dir), CFG), THR)
    return f.select("commodity", "window_start", "trader_id", *[f"flag_{p}" for p in PERSONAS])


CASES = """c0 AS (SELECT *, CASE WHEN window_start <= max(window_end) OVER (PARTITION BY commodity, trader_id, predicted_persona ORDER BY window_start
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS opens FROM results WHERE final_flag AND predicted_persona IS NOT NULL),
c1 AS (SELECT *, sum(opens) OVER (PARTITION BY commodity, trader_id, predicted_persona ORDER BY window_start ROWS UNBOUNDED PRECEDING) AS island FROM c0),
c2 AS (SELECT commodity, trader_id, predicted_persona AS persona, min(window_start) AS start_tick, max(window_end) AS end_tick, count(*) AS n_windows,
    max(final_score) AS score, arg_max(iso_score, {'s': final_score, 'w': -window_start}) AS iso_score,
    list_sort(list_distinct(flatten(list(triggered_by)))) AS triggered_by FROM c1 GROUP BY commodity, trader_id, predicted_persona, island),
cases AS (SELECT commodity || '~' || trader_id || '~' || persona || '~' || start_tick || '~' || end_tick AS case_id, * FROM c2)"""
CASE_CTES = [*RESULT_CTES, CASES]


def alert_cases(spark, sf_dir):
    return cs.build_cases(en.flags_table(results(spark, sf_dir), CFG))


CASE_COLS = "case_id, commodity, trader_id, persona, start_tick, end_tick, score, n_windows, iso_score"


@query("alert_cases", with_ctes(*CASE_CTES) + f"SELECT {CASE_COLS}, array_to_string(triggered_by, ',') AS triggers FROM cases", "M7 E12 D8")
def alert_cases_query(spark, sf_dir):
    c = alert_cases(spark, sf_dir).withColumn("triggers", F.array_join("triggered_by", ","))
    return c.select(*CASE_COLS.split(", "), "triggers")


@query("parsed_case_ids", with_ctes(*CASE_CTES) + "SELECT case_id, commodity, trader_id, persona, start_tick, end_tick FROM cases", "M7")
def parsed_case_ids(spark, sf_dir):
    return cs.parse_case_id(alert_cases(spark, sf_dir).select("case_id"))


MATCH = """m0 AS (
  SELECT c.case_id, min({'e': e.event_id, 'p': e.persona}) FILTER (WHERE c.end_tick >= e.start_tick AND c.start_tick <= e.end_tick) AS hit,
    min(e.event_id) AS near FROM cases c JOIN episode_accounts e ON e.commodity = c.commodity AND e.trader_id = c.trader_id
    AND c.start_tick - 120 <= e.end_tick AND c.end_tick + 120 >= e.start_tick GROUP BY 1),
m1 AS (SELECT c.*, hit.e AS gt_event, hit.p AS gt_persona, CASE WHEN hit IS NULL THEN near END AS near_event,
    CASE WHEN n_windows >= 2 THEN 'case' ELSE 'brief' END AS tier FROM cases c LEFT JOIN m0 USING (case_id)),
matched AS (SELECT *, CASE WHEN near_event IS NOT NULL THEN 'near_episode' WHEN gt_event IS NULL THEN 'no_episode'
    WHEN gt_persona = persona THEN 'confirmed' ELSE 'other_persona' END AS status FROM m1),
missed AS (SELECT event_id, persona, commodity, start_tick, end_tick,
    EXISTS (SELECT 1 FROM matched b WHERE b.gt_event = e.event_id AND status = 'confirmed' AND tier = 'brief') AS brief_only
  FROM episodes e WHERE NOT EXISTS (SELECT 1 FROM matched b WHERE b.gt_event = e.event_id AND status = 'confirmed' AND tier = 'case'))"""
MATCH_CTES = [*CASE_CTES, EPISODES, MATCH]


def matched(spark, sf_dir):
    return cut(cs.match_cases(cut(alert_cases(spark, sf_dir)), episodes(spark, sf_dir), CFG))


@query("case_matches", with_ctes(*MATCH_CTES) + "SELECT case_id, n_windows, gt_event, gt_persona, near_event, tier, status FROM matched", "M8 C14")
def case_matches(spark, sf_dir):
    return matched(spark, sf_dir).select("case_id", "n_windows", "gt_event", "gt_persona", "near_event", "tier", "status")


@query("missed_episodes", with_ctes(*MATCH_CTES) + "SELECT * FROM missed", "M9 C17 G4")
def missed_episodes(spark, sf_dir):
    return cs.missed_episodes(matched(spark, sf_dir), episodes(spark, sf_dir))


def _n(cond: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {cond}) AS {name}"


_full, _brief, _anom = "persona <> 'anomaly' AND tier = 'case'", "persona <> 'anomaly' AND tier = 'brief'", "persona = 'anomaly' AND tier = 'case'"
_counters = ", ".join([
    _n(_full, "persona_cases"), _n(_full + " AND status = 'confirmed'", "confirmed"), _n(_full + " AND status = 'no_episode'", "no_episode"),
    _n(_full + " AND status = 'other_persona'", "other_persona"), _n(_full + " AND status = 'near_episode'", "near_episode"), _n(_brief, "brief"),
    _n(_brief + " AND status = 'confirmed'", "brief_confirmed"), _n(_brief + " AND status = 'no_episode'", "brief_no_episode"), _n(_anom, "anomalies"),
    _n(_anom + " AND gt_event IS NOT NULL", "anomalies_on_episode"),
    _n(_full + " AND gt_persona IN ('spoofing','layering') AND persona IN ('spoofing','layering') AND gt_persona <> persona", "sibling_label"),
])


@query("case_counters", with_ctes(*MATCH_CTES) + f"""SELECT * FROM (SELECT {_counters} FROM matched),
  (SELECT count(*) AS missed, {_n('brief_only', 'missed_brief')} FROM missed),
  (SELECT {_n("alert_tier = 'review'", 'review_windows')}, count(*) AS windows, {_n('final_flag', 'alert_windows')} FROM results), (SELECT 2 AS min_case_windows)""", "M10")
def case_counters(spark, sf_dir):
    m = matched(spark, sf_dir)
    return cs.case_counters(m, cs.missed_episodes(m, episodes(spark, sf_dir)), results(spark, sf_dir), CFG)


ROLLUP = "rollup AS (SELECT commodity, trader_id, persona, count(*) AS cases, CAST(sum(n_windows) AS BIGINT) AS windows, max(score) AS max_score, min(start_tick) AS first_tick, max(end_tick) AS last_tick, " + ", ".join(
    _n(f"status = '{s}'", s) for s in ("confirmed", "other_persona", "near_episode", "no_episode")) + " FROM matched GROUP BY 1, 2, 3)"


@query("account_rollup", with_ctes(*MATCH_CTES, ROLLUP) + "SELECT * FROM rollup", "M12 F4")
def account_rollup(spark, sf_dir):
    return cs.account_rollup(matched(spark, sf_dir))


@query("account_status_counts", with_ctes(*MATCH_CTES, ROLLUP) + "SELECT " + ", ".join([
    _n("confirmed > 0", "accounts_confirmed"), _n("confirmed = 0 AND other_persona > 0", "accounts_other_persona_only"),
    _n("confirmed = 0 AND other_persona = 0", "accounts_only_false_alerts"), _n("no_episode > 0", "accounts_with_any_false_alert")]) + " FROM rollup", "M12")
def account_status_counts(spark, sf_dir):
    return cs.account_status_counts(cs.account_rollup(matched(spark, sf_dir)))


@query("confidence_bands", with_ctes(*CASE_CTES) + """SELECT CASE WHEN score - 0.9 >= 0.4 THEN 'very high' WHEN score - 0.9 >= 0.2 THEN 'high' WHEN score - 0.9::DOUBLE >= 0.05 THEN 'moderate'
  ELSE 'borderline' END AS band, count(*) AS n FROM cases GROUP BY 1""", "M13")
def confidence_bands(spark, sf_dir):
    return alert_cases(spark, sf_dir).groupBy(cs.confidence_band(F.col("score") - 0.9).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("case_price_context", with_ctes(*CASE_CTES) + f""", px AS (SELECT commodity, tick, {LAST_PRICE} AS price FROM trades GROUP BY 1, 2),
p AS (SELECT c.case_id, count(*) AS ticks, min(price) AS low, max(price) AS high FROM cases c JOIN px ON px.commodity = c.commodity AND px.tick BETWEEN c.start_tick - 120 AND c.end_tick + 120 GROUP BY 1),
o AS (SELECT c.case_id, count(*) FILTER (WHERE buyer_trader_id = c.trader_id) AS own_buys, count(*) FILTER (WHERE seller_trader_id = c.trader_id) AS own_sells FROM cases c JOIN trades t
  ON t.commodity = c.commodity AND (buyer_trader_id = c.trader_id OR seller_trader_id = c.trader_id) AND t.tick BETWEEN c.start_tick - 120 AND c.end_tick + 120 GROUP BY 1)
SELECT * FROM p JOIN o USING (case_id)""", "M11 B3")
def case_price_context(spark, sf_dir):
    c, t = cut(alert_cases(spark, sf_dir)), derived.staged(spark, sf_dir, "trade_log")
    p = cs.case_price_range(c, tick_prices(t))
    o = cs.case_fills(c, t).groupBy("case_id").agg(F.count_if(F.col("side") == "buy").alias("own_buys"), F.count_if(F.col("side") == "sell").alias("own_sells"))
    return p.join(o, "case_id")


@query("caught_by", with_ctes(*RESULT_CTES, EPISODES) + """, rows AS (
  SELECT DISTINCT r.commodity, r.window_start, r.trader_id, e.persona, final_flag, predicted_persona AS label FROM results r JOIN episode_accounts e
  ON e.commodity = r.commodity AND e.trader_id = r.trader_id AND r.window_end >= e.start_tick AND r.window_start <= e.end_tick)
SELECT persona, count(*) AS windows, round(count(*) FILTER (WHERE final_flag) / count(*), 3) AS caught_share,
  count(*) FILTER (WHERE final_flag AND label = persona) AS own_label, count(*) FILTER (WHERE final_flag AND label = 'anomaly') AS anomaly,
  count(*) FILTER (WHERE final_flag AND coalesce(label NOT IN (persona, 'anomaly'), true)) AS other_persona FROM rows GROUP BY 1""", "M16 D8")
def caught_by(spark, sf_dir):
    return cs.caught_by(results(spark, sf_dir), episodes(spark, sf_dir))
