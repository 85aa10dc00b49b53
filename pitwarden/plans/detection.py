"""Detection-metric queries."""

from pyspark.sql import functions as F

from pitwarden.config import PERSONAS
from pitwarden.operators import detection as dt, labels as lb
from pitwarden.operators.lineage import cut
from pitwarden.plans.alerts import RESULT_CTES, results
from pitwarden.plans.labelling import SPAN, episodes, scored, span_labels
from pitwarden.plans.registry import query
from pitwarden.plans.sql import EPISODES, with_ctes

LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT commodity, window_start, trader_id, r.window_end, final_flag, iso_flag, '{p}' AS persona, {p} > 0 AS truth, flag_{p} AS own, "
    + ("flag_spoofing OR flag_layering" if p in ("spoofing", "layering") else f"flag_{p}")
    + " AS family FROM results r JOIN labels USING (commodity, window_start, trader_id)" for p in PERSONAS) + ")"
LONG_CTES = [*RESULT_CTES, EPISODES, SPAN, LONG]
PRF = """CASE WHEN tp + fn > 0 THEN round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) END AS precision,
  CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS recall,
  CASE WHEN tp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 4) END AS f1"""
CONF = """count(*) FILTER (WHERE truth AND {f}) AS tp, count(*) FILTER (WHERE NOT truth AND {f}) AS fp,
  count(*) FILTER (WHERE truth AND NOT {f}) AS fn, count(*) FILTER (WHERE NOT truth AND NOT {f}) AS tn"""
ROWS = "rowm AS (SELECT persona, " + PRF + ", round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 4) AS fpr, tp + fn AS support FROM (SELECT persona, " + CONF.format(f="own") + " FROM long GROUP BY 1))"


def long(spark, sf_dir):
    return dt.long_results(results(spark, sf_dir), span_labels(spark, sf_dir))


@query("row_metrics", with_ctes(*LONG_CTES, ROWS) + "SELECT * FROM rowm", "N1 C16")
def row_metrics(spark, sf_dir):
    return dt.row_metrics(long(spark, sf_dir))


@query("metrics_by_market", with_ctes(*LONG_CTES) + f"""SELECT scope, persona, {PRF}, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 4) AS fpr, tp + fn AS support FROM (
  SELECT coalesce(commodity, 'pooled') AS scope, persona, {CONF.format(f='own')} FROM long GROUP BY GROUPING SETS ((persona), (commodity, persona)))""", "N9")
def metrics_by_market(spark, sf_dir):
    return dt.row_metrics_by_market(long(spark, sf_dir))


HITS = """hits AS (
  SELECT e.event_id, e.persona, count(*) FILTER (WHERE truth) AS labelled, count(*) FILTER (WHERE truth AND own) AS own_l,
    count(*) FILTER (WHERE truth AND family) AS fam_l, count(*) FILTER (WHERE truth AND final_flag) AS any_l,
    min(greatest(l.window_end - e.start_tick, 0)) FILTER (WHERE own) AS own_lat, min(greatest(l.window_end - e.start_tick, 0)) FILTER (WHERE final_flag) AS any_lat
  FROM (SELECT event_id, persona, start_tick FROM episodes) e LEFT JOIN (
    SELECT a.event_id, g.* EXCLUDE (commodity, persona) FROM episode_accounts a JOIN long g ON g.commodity = a.commodity AND g.trader_id = a.trader_id
      AND g.persona = a.persona AND g.window_end >= a.start_tick AND g.window_start <= a.end_tick) l USING (event_id)
  GROUP BY 1, 2)"""
EPI = """epi AS (
  SELECT persona, count(*) AS events_total, count(own_lat) AS events_detected, round(avg(own_lat), 1) AS detection_latency_ticks,
    round(avg(CASE WHEN labelled > 0 THEN own_l / labelled END), 4) AS episode_coverage, round(avg(CASE WHEN labelled > 0 THEN fam_l / labelled END), 4) AS family_coverage,
    round(avg(CASE WHEN labelled > 0 THEN any_l / labelled END), 4) AS caught_coverage,
    round(avg(CASE WHEN labelled > 0 THEN CASE WHEN any_l / labelled < 0.2 THEN 1.0 ELSE 0.0 END END), 4) AS caught_weak_share,
    count(any_lat) AS caught_events_detected, round(avg(any_lat), 1) AS caught_latency_ticks FROM hits GROUP BY 1)"""


@query("episode_metrics", with_ctes(*LONG_CTES, HITS, EPI) + "SELECT * FROM epi", "N2 N3 N4 N5")
def episode_metrics(spark, sf_dir):
    return dt.episode_metrics(dt.episode_hits(long(spark, sf_dir), episodes(spark, sf_dir)))


@query("round_metrics", with_ctes(*LONG_CTES, ROWS, HITS, EPI) + "SELECT * FROM rowm JOIN epi USING (persona)", "N1 N2 N3 N4 N5 N7")
def round_metrics(spark, sf_dir):
    labels = cut(span_labels(spark, sf_dir))
    return dt.round_metrics(cut(results(spark, sf_dir)), labels, episodes(spark, sf_dir))


@query("family_metrics", with_ctes(*RESULT_CTES, EPISODES, SPAN) + f"""SELECT precision AS family_precision, recall AS family_recall, f1 AS family_f1 FROM (SELECT {PRF} FROM (
  SELECT {CONF.format(f='pred')} FROM (SELECT greatest(spoofing, layering) > 0 AS truth, final_flag AND coalesce(predicted_persona IN ('spoofing', 'layering'), false) AS pred
  FROM results JOIN labels USING (commodity, window_start, trader_id))))""", "N5")
def family_metrics(spark, sf_dir):
    return dt.family_metrics(results(spark, sf_dir), span_labels(spark, sf_dir))


@query("unsupervised_metrics", with_ctes(*RESULT_CTES, EPISODES, SPAN) + f"""SELECT {PRF}, round(fp / (fp + tn), 4) AS fpr, tp + fn AS support FROM (
  SELECT {CONF.format(f='iso_flag')} FROM (SELECT iso_flag, greatest({', '.join(PERSONAS)}) > 0 AS truth FROM results JOIN labels USING (commodity, window_start, trader_id)))""", "N6")
def unsupervised_metrics(spark, sf_dir):
    return dt.unsupervised_metrics(results(spark, sf_dir), span_labels(spark, sf_dir))
