"""Round-history queries; a round is a 500-tick stretch of the scored windows."""

from pyspark.sql import functions as F

from pitwarden.config import PERSONAS
from pitwarden.operators import detection as dt, rounds as rd
from pitwarden.operators.lineage import cut
from pitwarden.plans.alerts import RESULT_CTES, results
from pitwarden.plans.detection import LONG_CTES, PRF, long
from pitwarden.plans.effects import orders
from pitwarden.plans.registry import query
from pitwarden.plans.shaping import r, rounded
from pitwarden.plans.sql import ORDERS, with_ctes

_conf = "count(*) FILTER (WHERE truth AND {f}) AS tp, count(*) FILTER (WHERE NOT truth AND {f}) AS fp, count(*) FILTER (WHERE truth AND NOT {f}) AS fn, count(*) FILTER (WHERE NOT truth AND NOT {f}) AS tn"
HISTORY = "counts AS (" + " UNION ALL ".join(
    f"SELECT CAST(window_start // 500 AS BIGINT) AS round, persona, '{ph}' AS phase, {_conf.format(f=f)} FROM long GROUP BY 1, 2" for ph, f in (("post", "final_flag"), ("pre", "family"))
) + f"""), metrics AS (SELECT round, persona, phase, {PRF}, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 4) AS fpr, tp + fn AS support,
  CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS coverage, ((tp + fn) % 17 + 3) / 10.0::DOUBLE AS effect_ratio, ((tp * 7 + fp) % 100) / 100.0::DOUBLE AS mutation_score FROM counts)"""
H_CTES = [*LONG_CTES, HISTORY]


def metrics(spark, sf_dir):
    rows = cut(long(spark, sf_dir)).withColumn("round", F.expr("window_start div 500"))
    out = None
    for phase, flag in (("post", "final_flag"), ("pre", "family")):
        c = rows.groupBy("round", "persona").agg(*[v.alias(n) for n, v in dt.confusion(F.col("truth"), F.col(flag)).items()]).withColumn("phase", F.lit(phase))
        out = c if out is None else out.unionByName(c)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p = {n: v for n, v in dt.prf(tp, fp, fn).items()}
    fpr = dt.rnd(F.when(fp + tn > 0, fp / (fp + tn)).otherwise(0.0), 4)
    return out.select(
        "round", "persona", "phase", *[v.alias(n) for n, v in p.items()], fpr.alias("fpr"), (tp + fn).alias("support"), p["recall"].alias("coverage"),
        (((tp + fn) % 17 + 3) / F.lit(10.0)).alias("effect_ratio"), ((tp * 7 + fp) % 100 / F.lit(100.0)).alias("mutation_score"),
    )


PARAMS = """params AS (SELECT tick // 500 AS round, persona, knob, CAST(value AS DOUBLE) AS value FROM (
  SELECT tick // 500 * 500 AS tick, CASE right(order_id, 1) WHEN 's' THEN 'spoofing' WHEN 'w' THEN 'wash_trading' WHEN 'i' THEN 'pump_and_dump' ELSE 'layering' END AS persona,
    unnest(['orders', 'largest', 'size']) AS knob, unnest([count(*) // 50, max(quantity), CAST(sum(quantity) AS BIGINT) // count(*) // 4]) AS value
  FROM order_events WHERE event_type = 'placed' AND right(order_id, 1) IN ('s', 'w', 'i', 'l') GROUP BY 1, 2)),
hist AS (SELECT *, coalesce(value <> lag(value) OVER w, false) AS changed FROM params WINDOW w AS (PARTITION BY persona, knob ORDER BY round))"""
P_CTES = [*H_CTES, ORDERS, PARAMS]


def params(spark, sf_dir):
    mark = F.substring("order_id", -1, 1)
    o = orders(spark, sf_dir).filter("event_type = 'placed'").filter(mark.isin("s", "w", "i", "l"))
    persona = F.when(mark == "s", "spoofing").when(mark == "w", "wash_trading").when(mark == "i", "pump_and_dump").otherwise("layering")
    g = o.groupBy(F.expr("tick div 500").alias("round"), persona.alias("persona")).agg(F.count(F.lit(1)).alias("n"), F.max("quantity").alias("mx"), F.sum("quantity").alias("q"))
    return g.select("round", "persona", F.map_from_arrays(F.array(*[F.lit(k) for k in ("orders", "largest", "size")]), F.array(
        F.expr("n div 50").cast("double"), F.col("mx").cast("double"), F.expr("q div n div 4").cast("double"))).alias("params"))


M_COLS = "round, persona, phase, precision, recall, f1, fpr, support"


@query("cumulative_metrics", with_ctes(*H_CTES) + f"SELECT {M_COLS} FROM metrics", "N13 N7")
def cumulative_metrics(spark, sf_dir):
    return metrics(spark, sf_dir).select(*M_COLS.split(", "))


@query("tidy_summary", with_ctes(*H_CTES) + "SELECT round, persona, phase, f1, support FROM metrics", "N7")
def tidy_summary(spark, sf_dir):
    m = metrics(spark, sf_dir)
    docs = m.groupBy("round").agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col("phase") == p, F.struct("persona", F.struct("f1", "support"))))).alias(p) for p in ("post", "pre")
    ])
    return rd.tidy_summary(docs, (("post", "post"), ("pre", "pre")))


@query("round_contract_rows", with_ctes(*H_CTES) + "SELECT round AS round_num, 'all' AS commodity, persona, precision, recall, f1, fpr, CAST(NULL AS DOUBLE) AS detection_latency_ticks, phase = 'post' AS is_post_retrain FROM metrics", "N8")
def round_contract_rows(spark, sf_dir):
    return rd.contract_rows(metrics(spark, sf_dir).withColumn("detection_latency_ticks", F.lit(None).cast("double")), "all")


@query("headline", with_ctes(*H_CTES) + """, j AS (SELECT (b.recall - p.recall) / b.recall AS drop, p.round, p.persona, p.recall, q.recall AS recovered FROM metrics p JOIN metrics b ON b.persona = p.persona AND b.phase = 'post' AND b.round = 0 AND b.recall > 0
  LEFT JOIN metrics q ON q.phase = 'post' AND q.round = p.round AND q.persona = p.persona WHERE p.phase = 'pre' AND p.recall IS NOT NULL),
t AS (SELECT * FROM j ORDER BY drop DESC, round DESC, persona DESC LIMIT 1)
SELECT * FROM t""", "N10")
def headline(spark, sf_dir):
    return rd.headline(cut(metrics(spark, sf_dir)))


@query("f1_matrix", with_ctes(*H_CTES) + "SELECT persona, round, max(f1) AS f1 FROM metrics WHERE phase = 'post' GROUP BY 1, 2", "N14")
def f1_matrix(spark, sf_dir):
    return rd.f1_matrix(metrics(spark, sf_dir))


_BL = ", ".join(f"{r(f'avg({c}) FILTER (WHERE round = a)')} AS {c}_baseline, {r(f'avg({c}) FILTER (WHERE round = z)')} AS {c}_latest" for c in ("precision", "recall", "f1", "fpr"))


@query("baseline_vs_latest", with_ctes(*H_CTES) + f"SELECT {_BL} FROM metrics, (SELECT min(round) AS a, max(round) AS z FROM metrics WHERE phase = 'post') WHERE phase = 'post'", "N14")
def baseline_vs_latest(spark, sf_dir):
    return rounded(rd.baseline_vs_latest(cut(metrics(spark, sf_dir))))


@query("run_overview", with_ctes(*H_CTES) + f"""SELECT persona, {r('mr')} AS mean_recall, {r('ms')} AS mean_score, worst_round, worst_recall, CAST(row_number() OVER (ORDER BY mr NULLS LAST, persona) AS INTEGER) AS difficulty FROM (
  SELECT persona, avg(recall) AS mr, avg(mutation_score) AS ms, arg_min(round, {{'r': recall, 'n': round}}) FILTER (WHERE recall IS NOT NULL) AS worst_round, min(recall) AS worst_recall FROM metrics WHERE phase = 'pre' GROUP BY 1)""", "S3")
def run_overview(spark, sf_dir):
    return rounded(rd.run_overview(metrics(spark, sf_dir)))


TRACK = """track AS (SELECT p.round, p.persona, p.coverage AS frozen_coverage, p.recall AS frozen_recall, p.effect_ratio, p.mutation_score, q.recall AS retrained_recall,
  CAST(row_number() OVER (PARTITION BY p.persona ORDER BY p.round DESC) AS INTEGER) AS age FROM metrics p LEFT JOIN metrics q ON q.round = p.round AND q.persona = p.persona AND q.phase = 'post' WHERE p.phase = 'pre')"""


@query("track_record", with_ctes(*H_CTES, TRACK) + "SELECT * FROM track WHERE age <= 3", "S4 E13")
def track_record(spark, sf_dir):
    return rd.track_record(cut(metrics(spark, sf_dir)), 3)


@query("effect_status", with_ctes(*H_CTES) + """SELECT *, CASE WHEN effect_ratio < 0.5 THEN 'failed' WHEN effect_ratio < 0.65 THEN 'at_risk' WHEN effect_ratio > 1.5 THEN 'surplus' WHEN effect_ratio IS NOT NULL THEN 'ok' END AS status FROM (
  SELECT persona, max(round) AS round, arg_max(effect_ratio, round) AS effect_ratio, arg_max(round, {'s': mutation_score, 'r': round}) FILTER (WHERE effect_ratio >= 0.5) AS anchor_round FROM metrics WHERE phase = 'pre' GROUP BY 1)""", "S5")
def effect_status(spark, sf_dir):
    return rd.effect_status(metrics(spark, sf_dir))


@query("effect_series", with_ctes(*H_CTES) + "SELECT round, persona, effect_ratio AS ratio, mutation_score AS score FROM metrics WHERE phase = 'pre'", "S10")
def effect_series(spark, sf_dir):
    return metrics(spark, sf_dir).filter("phase = 'pre'").select("round", "persona", F.col("effect_ratio").alias("ratio"), F.col("mutation_score").alias("score"))


@query("params_history", with_ctes(ORDERS, PARAMS) + "SELECT * FROM hist", "N12 E4")
def params_history(spark, sf_dir):
    return rd.params_history(params(spark, sf_dir))


@query("knob_usage", with_ctes(ORDERS, PARAMS) + """SELECT persona, knob, changes, latest, changes = 0 AS never_changed, CASE WHEN latest <= 5 THEN 'low' WHEN latest >= 400 THEN 'high' END AS at_bound
  FROM (SELECT persona, knob, count(*) FILTER (WHERE changed) AS changes, arg_max(value, round) AS latest FROM hist GROUP BY 1, 2)""", "S6")
def knob_usage(spark, sf_dir):
    p = params(spark, sf_dir)
    bounds = rd.params_long(p).select("persona", "knob").distinct().withColumns({"lo": F.lit(5.0), "hi": F.lit(400.0)})
    return rd.knob_usage(p, bounds)


@query("breakthroughs", with_ctes(*P_CTES) + """SELECT m.round, m.persona, string_agg(knob, ',' ORDER BY knob) AS knobs, any_value(coverage) AS coverage, any_value(effect_ratio) AS effect_ratio FROM metrics m JOIN hist h ON h.round = m.round AND h.persona = m.persona AND changed
  WHERE phase = 'pre' AND coverage <= 0.5 GROUP BY 1, 2""", "S7")
def breakthroughs(spark, sf_dir):
    b = rd.breakthroughs(metrics(spark, sf_dir), params(spark, sf_dir))
    return b.withColumn("knobs", F.array_join("knobs", ","))


@query("knob_evidence", with_ctes(*P_CTES) + """SELECT m.persona, knob, count(*) AS tries, count(*) FILTER (WHERE effect_ratio < 0.5) AS failures, min(coverage) FILTER (WHERE effect_ratio >= 0.5) AS best_coverage
  FROM metrics m JOIN hist h ON h.round = m.round AND h.persona = m.persona AND changed WHERE phase = 'pre' GROUP BY 1, 2""", "S8")
def knob_evidence(spark, sf_dir):
    return rd.knob_evidence(metrics(spark, sf_dir), params(spark, sf_dir))


@query("mutation_history", with_ctes(*P_CTES, TRACK) + """SELECT t.* EXCLUDE (age), knobs FROM track t LEFT JOIN (SELECT round, persona, string_agg(knob, ',' ORDER BY knob) AS knobs FROM hist WHERE changed GROUP BY 1, 2) USING (round, persona) WHERE round >= 1""", "S9")
def mutation_history(spark, sf_dir):
    return rd.mutation_history(cut(metrics(spark, sf_dir)), params(spark, sf_dir))


@query("run_summary", with_ctes(*H_CTES) + f"SELECT round, {r('m')} AS avg_f1, personas, {r('m - lag(m) OVER (ORDER BY round)')} AS change FROM (SELECT round, avg(f1) AS m, count(f1) AS personas FROM metrics WHERE phase = 'post' GROUP BY 1)", "N11")
def run_summary(spark, sf_dir):
    return rounded(rd.run_summary(metrics(spark, sf_dir)))


@query("rounds_listed", with_ctes(*RESULT_CTES) + "SELECT window_start // 500 AS round, count(*) AS windows, count(*) FILTER (WHERE final_flag) AS alerts FROM results GROUP BY 1", "S1")
def rounds_listed(spark, sf_dir):
    return results(spark, sf_dir).groupBy(F.expr("window_start div 500").alias("round")).agg(F.count(F.lit(1)).alias("windows"), F.count_if("final_flag").alias("alerts"))


@query("top_flags", with_ctes(*RESULT_CTES) + """SELECT commodity, window_start, trader_id, final_score, predicted_persona, total_matches FROM (SELECT *, count(*) OVER () AS total_matches FROM results WHERE final_flag AND predicted_persona = 'spoofing')
  ORDER BY final_score DESC, commodity, window_start, trader_id LIMIT 25""", "S2 F1 A8 A9")
def top_flags(spark, sf_dir):
    return rd.top_flags(results(spark, sf_dir), 25, persona="spoofing").select("commodity", "window_start", "trader_id", "final_score", "predicted_persona", "total_matches")
