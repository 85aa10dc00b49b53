"""Label queries."""

from pitwarden.config import ACTIVITY_TAGS, PERSONAS, BarConfig
from pitwarden.operators import labels as lb
from pitwarden.plans import bar_sql as bs
from pitwarden.plans.bars import brand_bars
from pitwarden.plans.registry import query
from pitwarden.plans.sql import EPISODES, ORDERS, SCORED, TRADES, with_ctes
from pitwarden.sources import derived
from pyspark.sql import functions as F

_cols = ", ".join(f"CAST(coalesce(max((persona = '{p}')::INT), 0) AS INTEGER) AS {p}" for p in PERSONAS)
SPAN = f"""labels AS (
  SELECT s.commodity, s.window_start, s.trader_id, s.window_end, {_cols}
  FROM scored s LEFT JOIN episode_accounts e ON e.commodity = s.commodity AND e.trader_id = s.trader_id
    AND least(s.window_end, e.end_tick) - greatest(s.window_start, e.start_tick) >= 15
  GROUP BY 1, 2, 3, 4)"""
LABEL_CTES = [TRADES, SCORED, EPISODES, SPAN]


def scored(spark, sf_dir):
    return derived.staged(spark, sf_dir, "scored_windows")


def episodes(spark, sf_dir):
    return derived.staged(spark, sf_dir, "manipulation_events")


def span_labels(spark, sf_dir):
    return lb.span_labels(scored(spark, sf_dir), episodes(spark, sf_dir))


query("span_labels", with_ctes(*LABEL_CTES) + "SELECT * FROM labels", "K1 C10")(span_labels)

_tags = " OR ".join(f"(persona = '{p}' AND tag IN ({', '.join(repr(t) for t in tags)}))" for p, tags in ACTIVITY_TAGS.items())
ACTIVITY = f"""acts AS (
  SELECT DISTINCT o.commodity, o.trader_id, o.tick, persona FROM (
    SELECT *, regexp_extract(order_id, '-[0-9]+([a-z]*)$', 1) AS tag FROM order_events WHERE event_type = 'placed') o
  JOIN episode_accounts e ON e.commodity = o.commodity AND e.trader_id = o.trader_id AND o.tick BETWEEN e.start_tick AND e.end_tick
  WHERE {_tags}),
labels AS (
  SELECT s.commodity, s.window_start, s.trader_id, s.window_end, {_cols}
  FROM scored s LEFT JOIN acts a ON a.commodity = s.commodity AND a.trader_id = s.trader_id AND a.tick BETWEEN s.window_start AND s.window_end
  GROUP BY 1, 2, 3, 4)"""


@query("activity_labels", with_ctes(TRADES, SCORED, ORDERS, EPISODES, ACTIVITY) + "SELECT * FROM labels", "K2 B5 C11 C18")
def activity_labels(spark, sf_dir):
    return lb.activity_labels(scored(spark, sf_dir), episodes(spark, sf_dir), derived.staged(spark, sf_dir, "order_log"))


@query("family_labels", with_ctes(*LABEL_CTES) + "SELECT commodity, window_start, trader_id, spoofing, layering, greatest(spoofing, layering) AS fake_depth FROM labels", "K5")
def family_labels(spark, sf_dir):
    out = lb.family_labels(span_labels(spark, sf_dir), {"fake_depth": ("spoofing", "layering")})
    return out.select("commodity", "window_start", "trader_id", "spoofing", "layering", "fake_depth")


REGION_BARS = [TRADES, bs.RAW_BARS.replace("tick // 60", "tick // 5"), bs.GRID]


@query("minute_labels", with_ctes(*REGION_BARS, EPISODES) + f"""SELECT b.commodity, b.segment, b.minute, {_cols} FROM bars b LEFT JOIN episodes e
  ON e.commodity = b.commodity AND least((b.minute + 1) * 5, e.end_tick) - greatest(b.minute * 5, e.start_tick) >= 3 GROUP BY 1, 2, 3""", "K3 C12")
def minute_labels(spark, sf_dir):
    from pitwarden.operators.bars import minute_bars

    cfg = BarConfig(bar_ticks=5, label_min_overlap=3)
    return lb.minute_labels(minute_bars(derived.staged(spark, sf_dir, "trade_log"), cfg), episodes(spark, sf_dir), cfg=cfg)


@query("merged_episodes", with_ctes(EPISODES) + """SELECT commodity, persona, start_tick // 100 * 100 AS start_tick, start_tick // 100 * 100 + 180 AS end_tick, min(event_id) AS event_id,
  array_to_string(list_sort(list_distinct(flatten(list(trader_ids)))), ',') AS accounts FROM episodes GROUP BY 1, 2, 3, 4""", "K4")
def merged_episodes(spark, sf_dir):
    coarse = F.expr("start_tick div 100 * 100")
    ev = episodes(spark, sf_dir).withColumn("start_tick", coarse).withColumn("end_tick", F.col("start_tick") + 180)
    merged = lb.merge_episode_rows(ev)
    return merged.withColumn("accounts", F.array_join("trader_ids", ",")).drop("trader_ids")
