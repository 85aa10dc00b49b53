"""Replay-scoring queries: 500 ticks of one commodity stand for a replayed market, its first episode for the case."""

from pyspark.sql import functions as F

from pitwarden.operators import detection as dt, replay as rp
from pitwarden.plans.alerts import RESULT_CTES, results
from pitwarden.plans.detection import EPI, HITS, LONG_CTES, long
from pitwarden.plans.labelling import episodes
from pitwarden.plans.registry import query
from pitwarden.plans.sql import EPISODES, with_ctes

CASES = """re AS (SELECT *, commodity || '~' || (start_tick // 500) AS market FROM episodes),
rc AS (SELECT market, 'case_' || (CAST(right(event_id, 9) AS BIGINT) % 7) AS name, persona AS label, start_tick, end_tick, trader_ids FROM re QUALIFY row_number() OVER (PARTITION BY market ORDER BY event_id) = 1),
rw0 AS (SELECT rc.*, r.commodity, r.window_start, r.trader_id, r.window_end, r.final_flag, r.predicted_persona, list_contains(trader_ids, r.trader_id) AS is_case
  FROM rc JOIN results r ON rc.market = r.commodity || '~' || (r.window_start // 500)),
rw1 AS (SELECT *, is_case AND least(window_end, end_tick) - greatest(window_start, start_tick) >= 15 AS ins, coalesce(predicted_persona = label, false) AS rl FROM rw0),
oc AS (SELECT *, CASE WHEN ins AND final_flag AND rl THEN 'TP right label' WHEN ins AND final_flag THEN 'TP wrong label' WHEN ins THEN 'FN missed' WHEN final_flag AND is_case THEN 'FP case account outside episode'
  WHEN final_flag THEN 'FP legitimate account' ELSE 'TN' END AS outcome FROM rw1),
ms AS (SELECT market, name, label, count(*) FILTER (WHERE ins) AS ew, count(*) FILTER (WHERE ins AND final_flag) AS tp, count(*) FILTER (WHERE ins AND NOT final_flag) AS fn, count(*) FILTER (WHERE NOT ins AND final_flag) AS fp,
  count(*) FILTER (WHERE ins AND final_flag AND rl) AS tr, count(*) FILTER (WHERE ins AND final_flag AND CASE WHEN label IN ('spoofing', 'layering') THEN predicted_persona IN ('spoofing', 'layering') ELSE rl END) AS tf,
  min(window_end - start_tick) FILTER (WHERE ins AND final_flag) AS fa, count(*) FILTER (WHERE final_flag AND NOT is_case) AS lg, (max(window_end) - min(window_start)) / 3600.0::DOUBLE AS hrs FROM oc GROUP BY 1, 2, 3)"""
R_CTES = [*RESULT_CTES, EPISODES, CASES]


def _prf(tp: str, fp: str, fn: str, s: str = "") -> str:
    return (f"CASE WHEN {tp} + {fp} > 0 THEN round({tp} / ({tp} + {fp}), 4) ELSE 0.0 END AS precision{s}, CASE WHEN {tp} + {fn} > 0 THEN round({tp} / ({tp} + {fn}), 4) ELSE 0.0 END AS recall{s}, "
            f"CASE WHEN {tp} > 0 THEN round(2 * {tp} / (2 * {tp} + {fp} + {fn}), 4) ELSE 0.0 END AS f1{s}")


BOTH = _prf("tp", "fp", "fn") + ", " + _prf("tr", "(fp + tp - tr)", "(fn + tp - tr)", "_right_label")
SCORES = f"""sc AS (SELECT market, name AS "case", label, ew AS episode_windows, tp, fp, fn, tr AS tp_right_label, tp > 0 AS caught, tr > 0 AS recognised, tf > 0 AS recognised_family,
  CASE WHEN tp > 0 THEN round(tf / tp, 4) ELSE 0.0 END AS label_share, round(tp / greatest(ew, 1), 4) AS window_recall, fa AS first_alert_s, round(lg / greatest(hrs, 1e-9), 2) AS legit_alerts_h, {BOTH} FROM ms)"""


def outcomes(spark, sf_dir):
    def market(tick: str):
        return F.concat_ws("~", "commodity", F.expr(f"{tick} div 500").cast("string"))

    ev = episodes(spark, sf_dir).withColumn("market", market("start_tick"))
    first = ev.groupBy("market").agg(F.min(F.struct("event_id", "persona", "start_tick", "end_tick", "trader_ids")).alias("x")).select("market", "x.*")
    name = F.concat(F.lit("case_"), (F.substring("event_id", 4, 9).cast("long") % 7).cast("string"))
    windows = results(spark, sf_dir).withColumn("market", market("window_start"))
    windows = windows.select("market", "commodity", "window_start", "trader_id", "window_end", "final_flag", "predicted_persona")
    return rp.window_outcomes(windows, first.withColumn("case", name))


@query("replay_outcomes", with_ctes(*R_CTES) + 'SELECT name AS "case", outcome, count(*) AS n FROM oc GROUP BY 1, 2', "U3 B7")
def replay_outcomes(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("case", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("replay_scores", with_ctes(*R_CTES, SCORES) + "SELECT * FROM sc", "U1 U3")
def replay_scores(spark, sf_dir):
    return rp.score_markets(outcomes(spark, sf_dir))


_m = "round(avg({c}::INT), 4) AS {c}"
SUMMARY = ('sm AS (SELECT "case", count(*) AS markets, ' + ", ".join(_m.format(c=c) for c in ("caught", "recognised", "recognised_family")) + ", "
           + ", ".join(f"round(avg({c}), 4) AS {c}" for c in ("label_share", "window_recall")) + ', median(first_alert_s) AS first_alert_s, round(avg(legit_alerts_h), 4) AS legit_alerts_h FROM sc GROUP BY 1)')


@query("replay_summary", with_ctes(*R_CTES, SCORES, SUMMARY) + "SELECT * FROM sm", "U2")
def replay_summary(spark, sf_dir):
    return rp.summarise(rp.score_markets(outcomes(spark, sf_dir)), ["case"])


@query("replay_pooled", with_ctes(*R_CTES) + f"""SELECT label, markets, tp, fp, fn, tr AS tp_right_label, {BOTH} FROM (SELECT label, count(*) AS markets, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tr) AS BIGINT) AS tr
  FROM ms GROUP BY 1)""", "U4")
def replay_pooled(spark, sf_dir):
    return rp.pooled(rp.score_markets(outcomes(spark, sf_dir)), ["label"])


@query("replay_forgetting", with_ctes(*R_CTES, SCORES) + """, br AS (SELECT "case", CAST(split_part(market, '~', 2) AS BIGINT) AS round, round(avg(recognised_family::INT), 4) AS recognised_family FROM sc GROUP BY 1, 2)
SELECT *, lag(recognised_family) OVER w AS before, coalesce(recognised_family < lag(recognised_family) OVER w - 0.25::DOUBLE, false) AS forgotten FROM br WINDOW w AS (PARTITION BY "case" ORDER BY round)""", "U5")
def replay_forgetting(spark, sf_dir):
    s = rp.score_markets(outcomes(spark, sf_dir)).withColumn("round", F.split("market", "~")[1].cast("long"))
    return rp.forgetting(rp.summarise(s, ["case", "round"]).select("case", "round", "recognised_family"))


@query("heldout_rates", with_ctes(*LONG_CTES, HITS, EPI) + "SELECT persona, CASE WHEN events_total > 0 THEN round(events_detected / events_total, 4) END AS detection_rate FROM epi", "U6")
def heldout_rates(spark, sf_dir):
    return rp.heldout_rates(dt.episode_metrics(dt.episode_hits(long(spark, sf_dir), episodes(spark, sf_dir))))
