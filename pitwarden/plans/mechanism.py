"""Minute-score, window and mechanism-check queries."""

from pyspark.sql import functions as F

from pitwarden.config import PERSONAS
from pitwarden.operators import cases as cs, mechanism as me
from pitwarden.operators.lineage import cut
from pitwarden.plans import bar_sql as bs
from pitwarden.plans.bars import brand_bars
from pitwarden.plans.registry import query
from pitwarden.plans.sql import with_ctes

MIX = {"spoofing": (7, 0), "wash_trading": (13, 250), "pump_and_dump": (29, 500), "layering": (43, 750)}
LIMIT = 0.99
HASH = "(minute * 37 + CAST(volume AS BIGINT) * 11) % 1000"
SCORES = "ms0 AS (SELECT commodity, segment, minute, " + ", ".join(
    f"(({HASH}) * {a} + {b}) % 1000 / 1000.0::DOUBLE AS prob_{p}" for p, (a, b) in MIX.items()
) + f""" FROM bars),
ms1 AS (SELECT *, greatest({', '.join(f'prob_{p}' for p in MIX)}) - {LIMIT}::DOUBLE AS margin FROM ms0),
minute_scores AS (SELECT *, margin >= 0 AS flag, CASE WHEN margin >= 0 THEN CASE {' '.join(f"WHEN prob_{p} - {LIMIT}::DOUBLE = margin THEN '{p}'" for p in MIX)} END END AS predicted_persona FROM ms1)"""


def minute_scores(spark, sf_dir):
    b = cut(brand_bars(spark, sf_dir))
    h = F.expr("(minute * 37 + cast(volume as bigint) * 11) % 1000")
    s = b.withColumns({f"prob_{p}": (h * m + a) % 1000 / F.lit(1000.0) for p, (m, a) in MIX.items()})
    margin = F.greatest(*[F.col(f"prob_{p}") for p in MIX]) - LIMIT
    s = s.withColumn("margin", margin).withColumn("flag", F.col("margin") >= 0)
    name = F.coalesce(*[F.when(F.col(f"prob_{p}") - LIMIT == F.col("margin"), F.lit(p)) for p in MIX])
    return b, s.withColumn("predicted_persona", F.when(F.col("flag"), name))


CASES = """mc0 AS (SELECT *, CASE WHEN minute - lag(minute) OVER w <= 2 THEN 0 ELSE 1 END AS opens FROM minute_scores WHERE flag WINDOW w AS (PARTITION BY commodity, segment ORDER BY minute)),
mc1 AS (SELECT *, sum(opens) OVER (PARTITION BY commodity, segment ORDER BY minute ROWS UNBOUNDED PRECEDING) AS island FROM mc0),
votes AS (SELECT commodity, segment, island, predicted_persona AS model_persona FROM mc1 GROUP BY 1, 2, 3, 4
  QUALIFY row_number() OVER (PARTITION BY commodity, segment, island ORDER BY count(*) DESC, min(minute)) = 1),
mcases AS (SELECT c.commodity, c.segment, min(minute) AS start_minute, max(minute) AS end_minute, max(minute) - min(minute) + 1 AS minutes, count(*) AS flagged_minutes, any_value(model_persona) AS model_persona,
  round(max(CASE model_persona WHEN 'spoofing' THEN prob_spoofing WHEN 'wash_trading' THEN prob_wash_trading WHEN 'pump_and_dump' THEN prob_pump_and_dump ELSE prob_layering END), 4) AS model_probability,
  round(max(margin), 4) AS model_margin FROM mc1 c JOIN votes v ON v.commodity = c.commodity AND v.segment = c.segment AND v.island = c.island GROUP BY c.commodity, c.segment, c.island)"""
CASE_CTES = [*bs.BARS, SCORES, CASES]


@query("minute_cases", with_ctes(*CASE_CTES) + "SELECT * FROM mcases", "M14 E12 D4")
def minute_cases(spark, sf_dir):
    return cs.minute_cases(minute_scores(spark, sf_dir)[1], PERSONAS)


@query("prediction_summary", with_ctes(*bs.BARS, SCORES) + "SELECT count(*) AS minutes_scored, count(*) FILTER (WHERE flag) AS minutes_flagged, round(avg(flag::INT), 4) AS flag_rate, "
       + ", ".join(f"count(*) FILTER (WHERE predicted_persona = '{p}') AS {p}" for p in PERSONAS) + " FROM minute_scores", "Q7")
def prediction_summary(spark, sf_dir):
    return me.prediction_summary(minute_scores(spark, sf_dir)[1], PERSONAS)


FLAGGED = "wins AS (SELECT commodity || '~' || start_minute AS window_id, commodity AS home, start_minute AS s, end_minute AS e FROM mcases)"
MEASURES = """b1 AS (SELECT *, lag(minute) OVER w AS prev, (ln(close) - ln(lag(close) OVER w)) * 1e4 AS r FROM bars WINDOW w AS (PARTITION BY commodity ORDER BY minute)),
wr AS (SELECT w.*, b.*, CASE WHEN minute < s THEN 'pre' WHEN minute <= e THEN 'win' ELSE 'post' END AS zone FROM wins w JOIN b1 b ON b.minute BETWEEN s - 60 AND e + 30),
mv0 AS (SELECT window_id, home, s, e, commodity, count(*) FILTER (WHERE zone = 'win') AS n, count(*) FILTER (WHERE zone = 'pre') AS pre_bars,
  arg_max(close, minute) FILTER (WHERE zone = 'pre') AS pc, arg_min(open, minute) FILTER (WHERE zone = 'win') AS wo, arg_max(close, minute) FILTER (WHERE zone = 'win') AS win_close,
  count(r) FILTER (WHERE zone = 'pre' AND prev >= s - 60) AS np, stddev_samp(r) FILTER (WHERE zone = 'pre' AND prev >= s - 60) AS sp, stddev_samp(r) FILTER (WHERE zone = 'win' AND prev >= s) AS sw
  FROM wr WHERE zone <> 'post' GROUP BY 1, 2, 3, 4, 5 HAVING count(*) FILTER (WHERE zone = 'win') > 0),
mv1 AS (SELECT *, coalesce(pc, wo) AS ref, CASE WHEN (CASE WHEN np > 5 THEN sp ELSE sw END) IS NOT NULL THEN greatest(CASE WHEN np > 5 THEN sp ELSE sw END, 0.5) END AS sigma FROM mv0),
mv2 AS (SELECT *, ln(win_close / ref) * 1e4 AS move_bp, ln(win_close / ref) * 1e4 / (sigma * sqrt(n)) AS move_z FROM mv1),
own AS (SELECT * FROM mv2 WHERE commodity = home),
peer AS (SELECT o.window_id, count(*) FILTER (WHERE abs(p.move_z) >= 2 AND sign(p.move_z) = sign(o.move_z)) AS n_comoving,
  count(*) FILTER (WHERE abs(p.move_z) >= 2 AND sign(p.move_z) = sign(o.move_z) AND length(p.commodity) = length(p.home)) AS n_comoving_same_sector
  FROM own o JOIN mv2 p ON p.window_id = o.window_id AND p.commodity <> p.home GROUP BY 1),
er AS (SELECT r.*, o.ref, o.sigma, o.n, o.pre_bars, o.move_bp, o.move_z, o.win_close, ln(close / ref) * 1e4 AS path, row_number() OVER (PARTITION BY r.window_id, zone ORDER BY minute) - 1 AS k,
  (high - low) / close * 1e4 AS rng, CASE WHEN high > low THEN 1 - abs(close - open) / (high - low) ELSE 0.0 END AS wick FROM wr r JOIN own o ON o.window_id = r.window_id WHERE r.commodity = r.home),
ev0 AS (SELECT window_id, sigma, n, pre_bars, move_bp, move_z, win_close, arg_max({'p': path, 'k': k}, {'a': abs(path), 'k': -k}) FILTER (WHERE zone = 'win') AS pk, max(path) FILTER (WHERE zone = 'win') AS top,
  count(*) FILTER (WHERE zone = 'post') AS post_bars, arg_max(close, minute) FILTER (WHERE zone = 'post') AS pcl, arg_max(close, minute) FILTER (WHERE zone = 'post' AND minute <= e + 5) AS scl,
  avg(volume) FILTER (WHERE zone = 'win') AS vw, avg(volume) FILTER (WHERE zone = 'post') AS vp, median(volume) FILTER (WHERE zone = 'pre') AS v0, median(volume) FILTER (WHERE zone = 'win') AS vm,
  avg(rng) FILTER (WHERE zone = 'win') AS rw, median(rng) FILTER (WHERE zone = 'pre') AS r0, median(rng) FILTER (WHERE zone = 'win') AS rm, avg(wick) FILTER (WHERE zone = 'win') AS wk,
  avg((volume <= 0)::INT) FILTER (WHERE zone = 'win') AS zw, avg((volume <= 0)::INT) FILTER (WHERE zone = 'pre') AS zp FROM er GROUP BY 1, 2, 3, 4, 5, 6, 7),
ev1 AS (SELECT *, pk.p / (sigma * sqrt(pk.k + 1)) AS pz, ln(pcl / win_close) * 1e4 AS pm, move_bp + coalesce(ln(scl / win_close) * 1e4, 0.0) AS fin, greatest(coalesce(v0, vm), 1.0) AS vb, greatest(coalesce(r0, rm), 0.1) AS rb FROM ev0),
ev AS (SELECT ev1.window_id, n AS minutes, pre_bars, post_bars, round(sigma, 2) AS sigma_1min_bp, round(move_bp, 2) AS move_bp, round(move_z, 2) AS move_z, round(pk.p, 2) AS peak_excursion_bp, round(pz, 2) AS peak_excursion_z,
  pk.k AS peak_minute_offset, round(greatest(top, 0.0) / (sigma * sqrt(n)), 2) AS max_run_up_z, round(greatest(least(CASE WHEN abs(pz) >= 1 THEN 1.0 - fin * sign(pk.p) / abs(pk.p) END, 1.0), CASE WHEN abs(pz) >= 1 THEN -1.0 END) * 100, 0) AS retrace0,
  CASE WHEN abs(pz) >= 1 THEN round(greatest(least(1.0 - fin * sign(pk.p) / abs(pk.p), 1.0), -1.0) * 100, 0) END AS retrace_pct_by_5min_after, round(pm, 2) AS post_30min_move_bp,
  CASE WHEN abs(move_z) >= 1 AND pm IS NOT NULL THEN round(greatest(least(-pm / move_bp, 3.0), -3.0) * 100, 0) END AS giveback_pct, round(vw / vb, 2) AS volume_ratio, round(vp / vb, 2) AS volume_ratio_after, round(rw / rb, 2) AS range_ratio,
  round(wk, 2) AS wick_share, round(zw, 2) AS zero_volume_share, round(zp, 2) AS zero_volume_share_before, coalesce(n_comoving, 0) AS n_comoving, coalesce(n_comoving_same_sector, 0) AS n_comoving_same_sector
  FROM ev1 LEFT JOIN peer USING (window_id))"""
EV_CTES = [*CASE_CTES, FLAGGED, MEASURES]


def windows_and_bars(spark, sf_dir):
    bars, scores = minute_scores(spark, sf_dir)
    c = cs.minute_cases(scores, PERSONAS)
    w = c.select(F.concat_ws("~", "commodity", F.col("start_minute").cast("string")).alias("window_id"), "commodity",
                 F.col("start_minute").alias("start"), F.col("end_minute").alias("end"))
    sectors = bars.select("commodity").distinct().withColumn("sector", F.length("commodity").cast("string"))
    return cut(w), bars, sectors


@query("window_evidence", with_ctes(*EV_CTES) + "SELECT * EXCLUDE (retrace0) FROM ev", "Q1 Q2 Q3 C19")
def window_evidence(spark, sf_dir):
    w, bars, sectors = windows_and_bars(spark, sf_dir)
    moved = cut(me.moves(w, bars))
    return me.evidence(w, bars, moved, me.comovers(moved, sectors))


def _test(t: str) -> str:
    return f"coalesce({t}, false)::INT"


_T = {
    "pump_and_dump": (["coalesce(max_run_up_z, 0) >= 2.5", "coalesce(volume_ratio, 0) >= 1.5", "post_bars >= 10 AND giveback_pct >= 50", "(coalesce(move_bp, 0) > 0 OR coalesce(peak_excursion_bp, 0) > 0)"], 0),
    "wash_trading": (["coalesce(volume_ratio, 0) >= 2.5", "abs(coalesce(move_z, 0)) <= 1", "coalesce(nullif(range_ratio, 0), 9) <= 1.3"], 1),
    "spoofing": (["abs(coalesce(peak_excursion_z, 0)) >= 2", "coalesce(nullif(volume_ratio, 0), 9) <= 1.3", "coalesce(retrace_pct_by_5min_after, 0) >= 60", "coalesce(wick_share, 0) >= 0.6"], 1),
    "layering": (["abs(coalesce(peak_excursion_z, 0)) >= 1.5", "peak_minute_offset + 1 >= 3", "coalesce(nullif(volume_ratio, 0), 9) <= 1.3", "coalesce(retrace_pct_by_5min_after, 0) >= 50"], 1),
}
CHECKS = "ck0 AS (SELECT *, (n_comoving_same_sector >= 1 OR n_comoving >= 2) AS hard, (n_comoving_same_sector >= 1 OR n_comoving >= 2 OR coalesce(zero_volume_share, 0) >= 0.3) AS benign, " + ", ".join(
    f"({' + '.join(_test(t) for t in ts)}) AS s_{p}" for p, (ts, _) in _T.items()) + " FROM ev), ck AS (SELECT *, " + ", ".join(
    f"""CASE WHEN s_{p} = {len(ts)} AND hard THEN 'likely benign' WHEN s_{p} = {len(ts)} THEN '{'consistent (unverifiable)' if u else 'consistent'}' WHEN s_{p} >= {len(ts) / 2} AND hard THEN 'likely benign'
  WHEN s_{p} >= {len(ts) / 2} THEN 'partial' ELSE 'not consistent' END AS verdict_{p},
  round(CASE WHEN s_{p} = {len(ts)} AND hard THEN 0.2::DOUBLE WHEN s_{p} = {len(ts)} THEN CASE WHEN benign THEN {(0.5 if u else 0.75) * 0.7}::DOUBLE ELSE {0.5 if u else 0.75}::DOUBLE END WHEN s_{p} >= {len(ts) / 2} THEN 0.3::DOUBLE * (s_{p} / {len(ts)}.0::DOUBLE)
  ELSE 0.1::DOUBLE * (s_{p} / {len(ts)}.0::DOUBLE) END, 2) AS confidence_{p}""" for p, (ts, u) in _T.items()) + " FROM ck0)"
_order = "list_position(['consistent', 'consistent (unverifiable)', 'partial', 'likely benign', 'not consistent', 'insufficient data'], verdict_{p})"
_best = "least(" + ", ".join(f"{{'v': {_order.format(p=p)}, 'c': -confidence_{p}, 'i': {i}, 'p': '{p}'}}" for i, p in enumerate(_T)) + ").p"
CHECK_COLS = [f"{k}_{p}" for p in _T for k in ("verdict", "confidence")]


@query("mechanism_checks", with_ctes(*EV_CTES, CHECKS) + f"SELECT window_id, hard AS hard_benign, {', '.join(CHECK_COLS)}, {_best} AS best_match FROM ck", "Q5 Q6")
def mechanism_checks(spark, sf_dir):
    w, bars, sectors = windows_and_bars(spark, sf_dir)
    moved = cut(me.moves(w, bars))
    ev = cut(me.evidence(w, bars, moved, me.comovers(moved, sectors)))
    return me.check(ev).select("window_id", "hard_benign", *CHECK_COLS, "best_match")


@query("verdict_counts", with_ctes(*EV_CTES, CHECKS) + f"SELECT verdict, count(*) AS n FROM (SELECT unnest([{', '.join(f'verdict_{p}' for p in _T)}]) AS verdict FROM ck) GROUP BY 1", "Q7")
def verdict_counts(spark, sf_dir):
    c = mechanism_checks(spark, sf_dir)
    return c.select(F.explode(F.array(*[F.col(f"verdict_{p}") for p in _T])).alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


_CAL = ", ".join(
    f"('{e}', {h}, {m}, '{tz}', '{s}', {list(d)}, '{k}', '{c}')" for e, h, m, tz, scopes, d, k, c in me.CALENDAR for s in scopes)
NAMED_SECTORS = [("gold", "metals"), ("crude_oil_wti", "energy"), ("wheat", "grains"), ("natural_gas", "energy")]
NAMES = "CASE CAST(CAST(c.segment AS BIGINT) + length(c.commodity) + start_minute AS BIGINT) % 4 WHEN 0 THEN 'gold' WHEN 1 THEN 'crude_oil_wti' WHEN 2 THEN 'wheat' ELSE 'natural_gas' END"
CAL_SQL = f"""cal AS (SELECT * FROM (VALUES {_CAL}) t(event, hour, minute, tz, scope, days, kind, certainty)),
cw AS (SELECT c.commodity || '~' || start_minute AS window_id, 1790000000 + start_minute * 1800 AS su, 1790000000 + end_minute * 1800 + 60 AS eu, {NAMES} AS name FROM mcases c),
cs AS (SELECT *, unnest(['all', name, CASE name WHEN 'gold' THEN 'metals' WHEN 'wheat' THEN 'grains' ELSE 'energy' END]) AS scope FROM cw),
cd AS (SELECT *, unnest(generate_series(CAST(make_timestamp((su - 2 * 86400) * 1000000) AS DATE), CAST(make_timestamp((eu + 2 * 86400) * 1000000) AS DATE), INTERVAL 1 DAY)) AS day FROM cs),
ca AS (SELECT cd.*, event, kind, certainty, CAST(epoch(timezone(tz, day + to_hours(hour) + to_minutes(minute))) AS BIGINT) AS at_s FROM cd JOIN cal USING (scope) WHERE list_contains(days, isodow(day) - 1))"""


@query("scheduled_events", with_ctes(*CASE_CTES, CAL_SQL) + "SELECT DISTINCT window_id, event, kind, certainty, at_s AS at_utc FROM ca WHERE at_s - 180 <= eu AND at_s + 900 >= su", "Q4 C15")
def scheduled_events(spark, sf_dir):
    c = cs.minute_cases(minute_scores(spark, sf_dir)[1], PERSONAS)
    slot = (F.col("segment").cast("long") + F.length("commodity") + F.col("start_minute")) % 4
    name = F.when(slot == 0, "gold").when(slot == 1, "crude_oil_wti").when(slot == 2, "wheat").otherwise("natural_gas")
    w = c.select(F.concat_ws("~", "commodity", F.col("start_minute").cast("string")).alias("window_id"), name.alias("commodity"),
                 (F.lit(1790000000).cast("long") + F.col("start_minute") * 1800).alias("start_utc"), (F.lit(1790000060).cast("long") + F.col("end_minute") * 1800).alias("end_utc"))
    return me.scheduled_events(w, me.calendar(spark), spark.createDataFrame(NAMED_SECTORS, "commodity string, sector string"))


# Windows of the verdicts: the flagged ones and the half hours before a commodity's first bar and after its last, without bars to judge.
EDGES = "edges AS (SELECT commodity, min(minute) - 30 AS s, min(minute) - 1 AS e FROM bars GROUP BY 1 UNION ALL SELECT commodity, max(minute) + 1, max(minute) + 30 FROM bars GROUP BY 1)"
JUDGED = """wins AS (SELECT commodity || '~' || start_minute AS window_id, commodity AS home, start_minute AS s, end_minute AS e FROM mcases
  UNION ALL SELECT commodity || '~' || s || '~edge', commodity, s, e FROM edges)"""
COUNTS = """ec AS (SELECT window_id, count(*) FILTER (WHERE certainty = 'fixed') AS fixed_events, count(*) FILTER (WHERE certainty = 'possible') AS possible_events
  FROM (SELECT DISTINCT window_id, event, certainty, at_s FROM ca WHERE at_s - 180 <= eu AND at_s + 900 >= su) GROUP BY 1),
evx AS (SELECT ev.*, coalesce(fixed_events, 0) AS fixed_events, coalesce(possible_events, 0) AS possible_events FROM ev LEFT JOIN ec USING (window_id))"""
_TOGETHER = "(n_comoving_same_sector >= 1 OR n_comoving >= 2)"
EVENT_CHECKS = CHECKS.replace(f"{_TOGETHER} AS hard", f"(fixed_events > 0 OR {_TOGETHER}) AS hard").replace(
    "(n_comoving_same_sector >= 1 OR n_comoving >= 2 OR coalesce", "(fixed_events > 0 OR possible_events > 0 OR n_comoving_same_sector >= 1 OR n_comoving >= 2 OR coalesce").replace("FROM ev)", "FROM evx)")
REAL_TIME = CAL_SQL.replace("""cw AS (SELECT c.commodity || '~' || start_minute AS window_id, 1790000000 + start_minute * 1800 AS su, 1790000000 + end_minute * 1800 + 60 AS eu""",
                            "cw AS (SELECT window_id, 1790000000 + s * 1800 AS su, 1790000000 + e * 1800 + 60 AS eu").replace(f"{NAMES} AS name FROM mcases c", f"{NAMES.replace('CAST(c.segment AS BIGINT) + length(c.commodity) + start_minute', 'length(home) + s')} AS name FROM wins")
_benign = """concat_ws('; ', CASE WHEN fixed_events > 0 THEN 'scheduled event' END, CASE WHEN possible_events > 0 THEN 'usual release window' END,
  CASE WHEN n_comoving_same_sector >= 1 OR n_comoving >= 2 THEN 'moved with other commodities' END, CASE WHEN coalesce(zero_volume_share, 0) >= 0.3 THEN 'thin market' END)"""


@query("mechanism_verdicts", with_ctes(*CASE_CTES, EDGES, JUDGED, MEASURES, REAL_TIME, COUNTS, EVENT_CHECKS) + f"""SELECT w.window_id, ck.window_id IS NOT NULL AS available, fixed_events, possible_events,
  CASE WHEN ck.window_id IS NOT NULL THEN {_benign} END AS benign, hard AS hard_benign, {', '.join(f"coalesce(verdict_{p}, 'insufficient data') AS verdict_{p}, coalesce(confidence_{p}, 0.0) AS confidence_{p}" for p in _T)},
  CASE WHEN ck.window_id IS NOT NULL THEN {_best} END AS best_match FROM wins w LEFT JOIN ck ON ck.window_id = w.window_id""", "Q4 Q5 Q6 C15 C19")
def mechanism_verdicts(spark, sf_dir):
    flagged, bars, sectors = windows_and_bars(spark, sf_dir)
    span = bars.groupBy("commodity").agg(F.min("minute").alias("first"), F.max("minute").alias("last"))
    sides = F.array(F.struct((F.col("first") - 30).alias("start"), (F.col("first") - 1).alias("end")),
                    F.struct((F.col("last") + 1).alias("start"), (F.col("last") + 30).alias("end")))
    edges = span.select("commodity", F.explode(sides).alias("x")).select(
        F.concat_ws("~", "commodity", F.col("x.start").cast("string"), F.lit("edge")).alias("window_id"), "commodity", "x.start", "x.end")
    w = cut(flagged.unionByName(edges))
    out = me.mechanism_checks(w, bars, sectors, _events_of(spark, w))
    return out.select("window_id", "available", "fixed_events", "possible_events", "benign", "hard_benign", *CHECK_COLS, "best_match")


def _events_of(spark, windows):
    """Scheduled events of windows whose minutes are read as half hours and whose commodities as four well-known ones."""
    slot = (F.length("commodity") + F.col("start")) % 4
    name = F.when(slot == 0, "gold").when(slot == 1, "crude_oil_wti").when(slot == 2, "wheat").otherwise("natural_gas")
    w = windows.select("window_id", name.alias("commodity"), (F.lit(1790000000).cast("long") + F.col("start") * 1800).alias("start_utc"),
                       (F.lit(1790000060).cast("long") + F.col("end") * 1800).alias("end_utc"))
    return me.scheduled_events(w, me.calendar(spark), spark.createDataFrame(NAMED_SECTORS, "commodity string, sector string"))
