"""Training, threshold and skill queries."""

from pyspark.sql import functions as F

from pitwarden.config import PERSONAS, BarConfig
from pitwarden.models import bar_model as bm, detector as dm, forest as fo, scaling as sc, thresholds as th
from pitwarden.operators import bar_features as bf, bars as bo, cases as cs, ensemble as en, labels as lb
from pitwarden.operators.features import FEATURE_COLUMNS
from pitwarden.operators.lineage import cut
from pitwarden.plans.labelling import LABEL_CTES, episodes, scored, span_labels
from pitwarden.plans.mechanism import SCORES, minute_scores
from pitwarden.plans import bar_sql as bs
from pitwarden.plans.alerts import MATCH_CTES, RESULT_CTES, ROLLUP, matched, results
from pitwarden.plans.registry import query
from pitwarden.plans.shaping import r, rounded
from pitwarden.plans.sql import EPISODES, SCORED, TRADES, with_ctes
from pitwarden.sources import derived

COLS = ["iso_score", *[f"prob_{p}" for p in PERSONAS]]
KEYS = ["commodity", "window_start", "trader_id"]
RANGES = "ranges AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", quantile_cont({c}, 0.5) AS median, CASE WHEN quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1) > 0 THEN quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1) ELSE 1.0 END AS width FROM scored" for c in COLS) + ")"


@query("robust_ranges", with_ctes(TRADES, SCORED, RANGES) + f'SELECT "column", {r("median")} AS median, {r("width")} AS width FROM ranges', "L1 D3")
def robust_ranges(spark, sf_dir):
    return rounded(sc.robust_ranges(scored(spark, sf_dir), COLS))


def attributions(spark, sf_dir):
    df = scored(spark, sf_dir)
    return sc.scaled_attribution(sc.robust_scale(df, COLS, sc.robust_ranges(df, COLS)), COLS, 3)


_long = " UNION ALL ".join(f"SELECT commodity, window_start, trader_id, '{c}' AS feature, (s.{c} - x.median) / x.width AS v FROM scored s, ranges x WHERE x.\"column\" = '{c}'" for c in COLS)
ATTR = f"""lng AS ({_long}), topk AS (SELECT *, floor(abs(v) * 1e4 + 0.5) / 1e4 * sign(v) AS value FROM lng QUALIFY row_number() OVER (PARTITION BY commodity, window_start, trader_id ORDER BY abs(v) DESC, feature) <= 3)"""


@query("scaled_attribution", with_ctes(TRADES, SCORED, RANGES, ATTR) + "SELECT commodity, window_start, trader_id, feature, value + 0.0 AS value FROM topk", "L17 F3")
def scaled_attribution(spark, sf_dir):
    a = attributions(spark, sf_dir)
    return a.select(*KEYS, F.explode("top_features").alias("feature", "value")).withColumn("value", F.col("value") + 0.0)


@query("importance_drift", with_ctes(TRADES, SCORED, RANGES, ATTR) + f""", imp AS (SELECT window_start < 1000 AS early, feature, sum(abs(value)) AS s FROM topk GROUP BY 1, 2), n AS (SELECT window_start < 1000 AS early, count(*) AS n FROM scored GROUP BY 1),
i AS (SELECT early, feature, s / n AS importance FROM imp JOIN n USING (early))
SELECT feature, {r('coalesce(a.importance, 0)')} AS before, {r('coalesce(b.importance, 0)')} AS after, {r('coalesce(b.importance, 0) - coalesce(a.importance, 0)')} AS drift
FROM (SELECT * FROM i WHERE early) a FULL JOIN (SELECT * FROM i WHERE NOT early) b USING (feature)""", "L18")
def importance_drift(spark, sf_dir):
    imp = cut(sc.mean_absolute(attributions(spark, sf_dir).withColumn("early", F.col("window_start") < 1000), ["early"]))
    return rounded(sc.importance_drift(imp.filter("early"), imp.filter("NOT early")))


@query("attribution_share", with_ctes(*RESULT_CTES, RANGES, ATTR) + f"""SELECT feature, {r('sum(abs(value)) / any_value(total)')} AS share
FROM topk JOIN results USING (commodity, window_start, trader_id), (SELECT sum(abs(value)) AS total FROM topk JOIN results USING (commodity, window_start, trader_id) WHERE final_flag) WHERE final_flag GROUP BY feature""", "M16")
def attribution_share(spark, sf_dir):
    """What the alerted windows were told apart by, over all of them."""
    flags = results(spark, sf_dir).select(*KEYS, "final_flag").join(attributions(spark, sf_dir).select(*KEYS, "top_features"), KEYS)
    return rounded(cs.attribution_mix(flags, "top_features"))


TOP = "topf AS (SELECT t.*, r.predicted_persona AS persona, final_flag, window_end FROM topk t JOIN results r USING (commodity, window_start, trader_id) WHERE final_flag)"


def explained_flags(spark, sf_dir):
    return cut(results(spark, sf_dir).join(attributions(spark, sf_dir).select(*KEYS, "top_features"), KEYS))


@query("account_profiles", with_ctes(*MATCH_CTES, ROLLUP, RANGES, ATTR, TOP) + """, pf AS (SELECT commodity, trader_id, persona, feature, round(sum(abs(value)), 6) AS w, avg(value) AS m FROM topf WHERE persona IS NOT NULL GROUP BY 1, 2, 3, 4),
pk AS (SELECT commodity, trader_id, persona, string_agg(feature, ',' ORDER BY i) AS features, floor(max(m) FILTER (WHERE i = 1) * 1e3 + 0.500001::DOUBLE) / 1e3 AS first_mean
  FROM (SELECT *, row_number() OVER (PARTITION BY commodity, trader_id, persona ORDER BY w DESC, feature) AS i FROM pf) WHERE i <= 3 GROUP BY 1, 2, 3),
tr AS (SELECT commodity, trader_id, persona, arg_max(gt_persona, start_tick) AS other_truth FROM matched WHERE gt_event IS NOT NULL AND gt_persona <> persona GROUP BY 1, 2, 3)
SELECT commodity, trader_id, persona, cases, windows, other_truth, no_episode = cases AS only_status, features, first_mean
FROM rollup LEFT JOIN tr USING (commodity, trader_id, persona) LEFT JOIN pk USING (commodity, trader_id, persona) WHERE no_episode > 0""", "M12 F3")
def account_profiles(spark, sf_dir):
    p = cs.account_profiles(matched(spark, sf_dir), explained_flags(spark, sf_dir), "no_episode", top="top_features")
    # Means of four-decimal values often lie half way between thousandths: those go up on both sides.
    names, first = F.map_keys("top_features"), F.get(F.map_values("top_features"), F.lit(0))
    return p.select("commodity", "trader_id", "persona", "cases", "windows", "other_truth", "only_status", F.array_join(names, ",").alias("features"),
                    (F.floor(first * 1e3 + 0.500001) / 1e3).alias("first_mean"))


@query("caught_features", with_ctes(*RESULT_CTES, EPISODES, RANGES, ATTR, TOP) + """, ct AS (SELECT DISTINCT t.*, e.persona AS episode FROM topf t JOIN episode_accounts e
  ON e.commodity = t.commodity AND e.trader_id = t.trader_id AND t.window_end >= e.start_tick AND t.window_start <= e.end_tick),
cw AS (SELECT episode AS persona, feature, sum(abs(value)) / sum(sum(abs(value))) OVER (PARTITION BY episode) AS s FROM ct GROUP BY 1, 2)
SELECT persona, feature, round(s, 3) AS share FROM cw QUALIFY row_number() OVER (PARTITION BY persona ORDER BY round(s, 6) DESC, feature) <= 5""", "M16")
def caught_features(spark, sf_dir):
    return cs.caught_features(explained_flags(spark, sf_dir), episodes(spark, sf_dir), top="top_features")


def labelled(spark, sf_dir):
    return scored(spark, sf_dir).join(span_labels(spark, sf_dir).drop("window_end"), KEYS)


LAB = "lab AS (SELECT s.*, spoofing, wash_trading, pump_and_dump, layering FROM scored s JOIN labels USING (commodity, window_start, trader_id))"
L_CTES = [*LABEL_CTES, LAB]
_frac = "CAST('0x' || substr(md5(commodity || '|' || window_start || '|' || trader_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query("negative_subsample", with_ctes(*L_CTES) + f"""SELECT commodity, window_start, trader_id, spoofing, CASE WHEN spoofing = 1 THEN 1.0 WHEN trader_id LIKE 'acct_3%' THEN 3.0 ELSE 4.0 END::DOUBLE AS weight FROM lab
  WHERE spoofing = 1 OR trader_id LIKE 'acct_3%' OR {_frac} < 0.25""", "L7")
def negative_subsample(spark, sf_dir):
    s = th.subsample_negatives(labelled(spark, sf_dir), "spoofing", KEYS, 0.25, ("acct_3",), 3.0)
    return s.select(*KEYS, "spoofing", "weight")


@query("class_weights", with_ctes(*L_CTES) + f"SELECT count(*) FILTER (WHERE spoofing = 1) AS positives, {r('least(50.0, greatest(1.0, count(*) FILTER (WHERE spoofing <> 1) / greatest(count(*) FILTER (WHERE spoofing = 1), 1)))')} AS class_weight FROM lab", "L6")
def class_weights(spark, sf_dir):
    return rounded(th.class_weight(labelled(spark, sf_dir), "spoofing"))


@query("group_folds", with_ctes(TRADES, SCORED).replace("WITH ", "WITH RECURSIVE ", 1) + """, g AS (SELECT trader_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, trader_id) AS i FROM scored GROUP BY 1),
deal AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS trader_id, [0, 0, 0]::BIGINT[] AS load, 0 AS k, CAST(0 AS BIGINT) AS n
  UNION ALL SELECT g.i, g.trader_id, list_transform([1, 2, 3], lambda j: load[j] + CASE WHEN j = list_position(load, list_min(load)) THEN g.n ELSE 0 END), list_position(load, list_min(load)), g.n FROM deal JOIN g ON g.i = deal.i + 1)
SELECT trader_id, CAST(k - 1 AS INTEGER) AS fold, n AS rows FROM deal WHERE i > 0""", "L8 L16")
def group_folds(spark, sf_dir):
    return th.group_folds(scored(spark, sf_dir), "trader_id", 3).groupBy("trader_id", "fold").agg(F.count(F.lit(1)).alias("rows"))


def sweep_sql(lo: float, hi: float, n: int) -> str:
    step = (hi - lo) / (n - 1)
    ts = ", ".join(f"({i}, {round(lo + i * step, 10)}::DOUBLE)" for i in range(n))
    return f"""sweep AS (SELECT i, threshold, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM (
  SELECT g.i, g.threshold, count(*) FILTER (WHERE prob_spoofing >= threshold AND spoofing = 1) AS tp, count(*) FILTER (WHERE prob_spoofing >= threshold AND spoofing = 0) AS fp,
    count(*) FILTER (WHERE prob_spoofing < threshold AND spoofing = 1) AS fn FROM lab CROSS JOIN (VALUES {ts}) g(i, threshold) GROUP BY 1, 2))"""


@query("f1_sweep", with_ctes(*L_CTES, sweep_sql(0.25, 0.9, 27)) + f"SELECT CAST(i AS INTEGER) AS i, threshold, {r('f1')} AS f1 FROM sweep", "L9")
def f1_sweep(spark, sf_dir):
    s = th.f1_sweep(labelled(spark, sf_dir), "prob_spoofing", "spoofing", 0.25, 0.9, 27)
    return s.select("i", "threshold", F.floor(F.col("f1") * 1e6 + 0.5).cast("double").alias("f1")).withColumn("f1", F.col("f1") / 1e6)


@query("picked_threshold", with_ctes(*L_CTES, sweep_sql(0.25, 0.9, 27)) + f""", sm AS (SELECT *, (coalesce(lag(f1) OVER w, f1) + f1 + coalesce(lead(f1) OVER w, f1)) / 3.0::DOUBLE AS smooth FROM sweep WINDOW w AS (ORDER BY i)),
mid AS (SELECT max(smooth) AS top, quantile_cont(threshold, 0.5) FILTER (WHERE smooth >= (SELECT max(smooth) FROM sm) - 0.005) AS m FROM sm)
SELECT threshold, {r('top')} AS best_f1 FROM sm, mid ORDER BY round(abs(threshold - m), 9), threshold LIMIT 1""", "L10")
def picked_threshold(spark, sf_dir):
    s = cut(th.f1_sweep(labelled(spark, sf_dir), "prob_spoofing", "spoofing", 0.25, 0.9, 27))
    t = th.pick_threshold(s)
    return t.withColumn("best_f1", F.floor(F.col("best_f1") * 1e6 + 0.5) / 1e6)


def long_scores(spark, sf_dir):
    """(v, name, prob, label): stand-in scores of every persona, in three periods that stand for three trainings."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("name"), F.col(f"prob_{p}").alias("prob"), F.col(p).alias("label")) for p in PERSONAS]))
    v = F.when(F.col("window_start") < 600, 0).when(F.col("window_start") < 1200, 1).otherwise(2)
    return labelled(spark, sf_dir).select(v.alias("v"), each.alias("x")).select("v", "x.*")


_grid = ", ".join(f"({i}, {round(0.25 + i * 0.025, 10)}::DOUBLE)" for i in range(27))
LONG_SWEEP = "lng AS (" + " UNION ALL ".join(
    f"SELECT CASE WHEN window_start < 600 THEN 0 WHEN window_start < 1200 THEN 1 ELSE 2 END AS v, '{p}' AS name, prob_{p} AS prob, {p} AS label FROM lab" for p in PERSONAS) + f"""),
lsweep AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM (
  SELECT v, name, i, threshold, count(*) FILTER (WHERE prob >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE prob >= threshold AND label = 0) AS fp, count(*) FILTER (WHERE prob < threshold AND label = 1) AS fn
  FROM lng CROSS JOIN (VALUES {_grid}) g(i, threshold) GROUP BY 1, 2, 3, 4)),
lsm AS (SELECT *, lead(threshold) OVER w AS nt, lead(smooth) OVER w AS ns FROM (
  SELECT *, (coalesce(lag(f1) OVER w, f1) + f1 + coalesce(lead(f1) OVER w, f1)) / 3.0::DOUBLE AS smooth FROM lsweep WINDOW w AS (PARTITION BY v, name ORDER BY i)) WINDOW w AS (PARTITION BY v, name ORDER BY i)),
ltop AS (SELECT v, name, max(smooth) AS top FROM lsm GROUP BY 1, 2),
lmid AS (SELECT v, name, any_value(top) AS top, quantile_cont(threshold, 0.5) AS m FROM lsm JOIN ltop USING (v, name) WHERE smooth >= top - 0.005 GROUP BY 1, 2),
fresh AS (SELECT v, name, threshold, top AS best_f1 FROM lsm JOIN lmid USING (v, name) QUALIFY row_number() OVER (PARTITION BY v, name ORDER BY round(abs(threshold - m), 9), threshold) = 1),
st0 AS (SELECT name, threshold, best_f1, 0 AS kept FROM fresh WHERE v = 0)"""


def _settled(v: int) -> str:
    return f"""at{v} AS (SELECT o.name, o.threshold AS old, o.kept AS times, CASE WHEN nt IS NOT NULL AND o.threshold > s.threshold THEN smooth + (ns - smooth) / (nt - s.threshold) * (o.threshold - s.threshold) ELSE smooth END AS at_old
  FROM st{v - 1} o JOIN lsm s ON s.name = o.name AND s.v = {v} AND s.threshold <= o.threshold AND (nt IS NULL OR o.threshold < nt)),
pk{v} AS (SELECT name, best_f1, old, times, CASE WHEN times < 2 AND at_old >= best_f1 - 0.01 THEN old ELSE threshold END AS threshold FROM fresh LEFT JOIN at{v} USING (name) WHERE v = {v}),
st{v} AS (SELECT name, threshold, best_f1, CASE WHEN threshold = old THEN times + 1 ELSE 0 END AS kept FROM pk{v})"""


@query("sticky_thresholds", with_ctes(*L_CTES, LONG_SWEEP, _settled(1), _settled(2)) + f"""SELECT version, name, threshold, {r('best_f1')} AS best_f1, CAST(kept AS INTEGER) AS kept
FROM (SELECT 0 AS version, * FROM st0 UNION ALL SELECT 1, * FROM st1 UNION ALL SELECT 2, * FROM st2)""", "L10 L9")
def sticky_thresholds(spark, sf_dir):
    """Thresholds of three trainings in a row, each with the state that the last one left."""
    sweep = cut(th.f1_sweep(long_scores(spark, sf_dir), "prob", "label", 0.25, 0.9, 27, by=["v", "name"]))
    state, out = None, None
    for version in range(3):
        state = cut(th.settle_thresholds(sweep.filter(F.col("v") == version).drop("v"), state))
        part = state.withColumn("version", F.lit(version))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("best_f1", F.floor(F.col("best_f1") * 1e6 + 0.5) / 1e6)


@query("budget_threshold", with_ctes(*L_CTES, sweep_sql(0.05, 0.95, 91)) + """SELECT round(greatest((SELECT threshold FROM sweep ORDER BY f1 DESC, i LIMIT 1), (SELECT quantile_cont(prob_spoofing, 0.98) FROM lab)), 4) AS threshold""", "L11")
def budget_threshold(spark, sf_dir):
    return th.budget_threshold(cut(labelled(spark, sf_dir)), "prob_spoofing", "spoofing", 0.02)


@query("smoothed_probabilities", with_ctes(*bs.BARS, SCORES) + "SELECT commodity, segment, minute, " + ", ".join(
    r(f"avg(prob_{p}) OVER (PARTITION BY commodity, segment ORDER BY minute ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)") + f" AS prob_{p}" for p in PERSONAS) + " FROM minute_scores", "L12 L15 E2")
def smoothed_probabilities(spark, sf_dir):
    probs = [f"prob_{p}" for p in PERSONAS]
    s = th.smooth_probabilities(minute_scores(spark, sf_dir)[1], probs, 5)
    return rounded(s.select("commodity", "segment", "minute", *probs))


VERDICT_LIMITS = {"spoofing": 0.62, "wash_trading": 0.71, "pump_and_dump": 0.66, "layering": 0.68}
_sm = ", ".join(f"avg(prob_{p}) OVER w AS prob_{p}" for p in PERSONAS)
_best = "greatest(" + ", ".join(f"prob_{p} - {t}::DOUBLE" for p, t in VERDICT_LIMITS.items()) + ")"


@query("bar_verdicts", with_ctes(*bs.BARS, SCORES) + f""", smoothed AS (SELECT commodity, segment, minute, {_sm} FROM minute_scores
  WINDOW w AS (PARTITION BY commodity, segment ORDER BY minute ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
j AS (SELECT *, {_best} AS best FROM smoothed)
SELECT commodity, segment, minute, {', '.join(f"{r(f'prob_{p}', 4)} AS prob_{p}" for p in PERSONAS)}, {r('best', 4)} + 0.0 AS margin, {r('best', 4)} >= 0 AS flag,
  CASE WHEN {r('best', 4)} >= 0 THEN CASE {' '.join(f"WHEN prob_{p} - {t}::DOUBLE = best THEN '{p}'" for p, t in VERDICT_LIMITS.items())} END END AS predicted_persona FROM j""", "L15 L12 L14")
def bar_verdicts(spark, sf_dir):
    """The bar model's judgement of smoothed stand-in scores, each persona against a threshold of its own."""
    probs = [f"prob_{p}" for p in VERDICT_LIMITS]
    s = th.smooth_probabilities(minute_scores(spark, sf_dir)[1], probs, 5).select("commodity", "segment", "minute", *probs)
    return bm.judge(s, VERDICT_LIMITS)


def region_market(spark, sf_dir, region: str | None = None):
    """Labelled bar features of the regional tape: bars of five ticks, three of which an episode must touch."""
    cfg = BarConfig(bar_ticks=5, label_min_overlap=3)
    tape = derived.staged(spark, sf_dir, "trade_log")
    bars = cut(bo.minute_bars(tape.filter(F.col("commodity") == region) if region else tape, cfg))
    labels = lb.minute_labels(bars, episodes(spark, sf_dir), cfg=cfg)
    return cut(bf.bar_features(bars, cfg).join(labels, ["commodity", "segment", "minute"]))


@query("stacked_markets", with_ctes(TRADES, bs.RAW_BARS.replace("tick // 60", "tick // 5"), bs.GRID) + """SELECT CASE commodity WHEN 'AFRICA' THEN 0 WHEN 'ASIA' THEN 1 ELSE 2 END AS market, commodity,
  CAST(segment AS BIGINT) + 1000000 * CASE commodity WHEN 'AFRICA' THEN 0 WHEN 'ASIA' THEN 1 ELSE 2 END AS segment, count(*) AS minutes, min(minute) AS first_minute
  FROM bars WHERE commodity IN ('AFRICA', 'ASIA', 'EUROPE') GROUP BY ALL""", "L16")
def stacked_markets(spark, sf_dir):
    parts = [region_bars(spark, sf_dir, x) for x in ("AFRICA", "ASIA", "EUROPE")]
    return bm.stack_markets(parts).groupBy("market", "commodity", "segment").agg(F.count(F.lit(1)).alias("minutes"), F.min("minute").alias("first_minute"))


def region_bars(spark, sf_dir, region: str):
    tape = derived.staged(spark, sf_dir, "trade_log").filter(F.col("commodity") == region)
    return bo.minute_bars(tape, BarConfig(bar_ticks=5, label_min_overlap=3)).select("commodity", "segment", "minute")


@query("bar_model_scores", None, "L15 L16 L12")
def bar_model_scores(spark, sf_dir):
    """A bar model trained on four regional markets, each a market of its own, scores the fifth."""
    every = region_market(spark, sf_dir)
    train = [every.filter(F.col("commodity") == x) for x in derived.REGIONS[:4]]
    model = bm.fit_bar_model(cut(bm.stack_markets(train)))
    scored = bm.score_bars(every.filter(F.col("commodity") == derived.REGIONS[4]), model)
    return scored.select("commodity", "segment", "minute", "flag", "predicted_persona", "margin", *[c for c in scored.columns if c.startswith("prob_")])


SKILL = """d AS (SELECT commodity, prob_spoofing AS s, count(*) FILTER (WHERE spoofing = 1) AS p, count(*) FILTER (WHERE spoofing = 0) AS n FROM lab GROUP BY 1, 2),
dd AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY commodity ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(p) OVER dn AS tp, sum(p + n) OVER dn AS al FROM d WINDOW dn AS (PARTITION BY commodity ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
k AS (SELECT commodity, sum(p) AS P1, sum(n) AS N1, sum(p * (below + n / 2)) AS u, sum(p * tp / al) AS ap, coalesce(sum(p) FILTER (WHERE s >= 0.9), 0) AS tpf, coalesce(sum(n) FILTER (WHERE s >= 0.9), 0) AS fpf FROM dd GROUP BY 1),
skill AS (SELECT commodity, CASE WHEN P1 > 0 AND N1 > 0 THEN round(u / (P1 * N1), 4) END AS auc, CASE WHEN P1 > 0 AND N1 > 0 THEN round(ap / P1, 4) END AS avg_precision, round(P1 / (P1 + N1), 4) AS base_rate,
  CASE WHEN P1 > 0 AND N1 > 0 THEN round(tpf / greatest(tpf + fpf, 1), 4) END AS precision, CASE WHEN P1 > 0 AND N1 > 0 THEN round(tpf / P1, 4) END AS recall, CASE WHEN P1 > 0 AND N1 > 0 THEN round(2 * tpf / (tpf + fpf + P1), 4) END AS f1,
  round((tpf + fpf) / (P1 + N1), 4) AS flag_rate FROM k)"""


def skill(spark, sf_dir):
    return th.skill(labelled(spark, sf_dir), "prob_spoofing", "spoofing", 0.9, ["commodity"])


query("score_skill", with_ctes(*L_CTES, SKILL) + "SELECT * FROM skill", "L13")(skill)


@query("skill_verdict", with_ctes(*L_CTES, SKILL) + """SELECT round(m, 3) AS mean_auc, CASE WHEN m IS NULL THEN 'unknown' WHEN m < 0.6 THEN 'near chance' WHEN m < 0.7 THEN 'weak' WHEN m < 0.8 THEN 'moderate' ELSE 'good' END AS level
  FROM (SELECT avg(auc) AS m FROM skill)""", "L14")
def skill_verdict(spark, sf_dir):
    m = skill(spark, sf_dir).agg(F.avg("auc").alias("m"))
    x = F.col("m")
    level = F.when(x.isNull(), "unknown").when(x < 0.6, "near chance").when(x < 0.7, "weak").when(x < 0.8, "moderate").otherwise("good")
    return m.select(th.rnd(x, 3).alias("mean_auc"), level.alias("level"))


def stored_features(spark, sf_dir):
    """Account features, written once: training and scoring read them many times."""
    from pitwarden.plans.account import account_features

    return cut(account_features(spark, sf_dir))


@query("forest_scores", None, "L2 L3 L4")
def forest_scores(spark, sf_dir):
    cols = [c for c in FEATURE_COLUMNS if not c.startswith("mkt_")]
    f = stored_features(spark, sf_dir).select(*KEYS, *cols)
    forest = fo.fit_forest(f, cols, KEYS)
    return fo.forest_scores(f, forest).withColumn("iso_flag", F.col("iso_score") >= 1 - forest.contamination)


@query("market_forest_scores", None, "L5")
def market_forest_scores(spark, sf_dir):
    from pitwarden.operators.windows import MARKET_CONTEXT
    from pitwarden.plans.steps import market_windows

    m = cut(market_windows(spark, sf_dir))
    cols = list(MARKET_CONTEXT)
    distinct = cut(m.select(*cols).distinct().withColumn("row", F.xxhash64(*cols)))
    return fo.market_scores(m, cols, fo.fit_forest(distinct, cols, ["row"], contamination=0.05)).select("commodity", "window_start", "mkt_anomaly_score")


_trained: dict[tuple[str, str], tuple] = {}


def detector_run(spark, sf_dir):
    """(alerts, flags) of the default detector on all account features, trained and stored once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _trained:
        f = stored_features(spark, sf_dir)
        labels = cut(lb.span_labels(f, episodes(spark, sf_dir)))
        d = dm.train(f, labels.select(*KEYS, *PERSONAS), list(FEATURE_COLUMNS))
        alerts = cut(dm.score(f, d))
        explained = alerts.join(dm.explain(alerts, d), KEYS, "left").withColumn("top_features", F.coalesce("top_features", F.create_map().cast("map<string,double>")))
        _trained[key] = alerts, cut(en.flags_table(explained, d.cfg, "top_features"))
    return _trained[key]


@query("detector_alerts", None, "L4 L6 L8 M3")
def detector_alerts(spark, sf_dir):
    return detector_run(spark, sf_dir)[0].select(*KEYS, "iso_score", *[f"prob_{p}" for p in PERSONAS], "final_flag", "alert_tier", "predicted_persona")


@query("detector_flags", None, "L17 M6")
def detector_flags(spark, sf_dir):
    return detector_run(spark, sf_dir)[1]


@query("detector_cases", None, "M7 M8 L17")
def detector_cases(spark, sf_dir):
    """Cases of the trained detector's own flags with the episode each one meets."""
    cases = cut(cs.build_cases(detector_run(spark, sf_dir)[1]))
    return cs.match_cases(cases, episodes(spark, sf_dir))
