"""Bar queries."""

from pyspark.sql import functions as F

from pitwarden.config import BarConfig
from pitwarden.operators import bar_features as bf, bars as bo
from pitwarden.operators.lineage import cut
from pitwarden.plans import bar_sql as bs
from pitwarden.plans.registry import query
from pitwarden.plans.shaping import r, rounded, rounded_sql
from pitwarden.plans.sql import FEED, FIRST_PRICE, LAST_PRICE, TRADES, with_ctes
from pitwarden.sources import derived

BAR_COLS = "commodity, minute, open, high, low, close, volume, segment"


def brand_bars(spark, sf_dir):
    return bo.minute_bars(derived.staged(spark, sf_dir, "brand_tape"))


@query("minute_bars", with_ctes(*bs.BARS) + f"SELECT {BAR_COLS} FROM bars", "J1 J2 D2 E5 E14")
def minute_bars(spark, sf_dir):
    return brand_bars(spark, sf_dir)


@query("bar_features", with_ctes(*bs.BARS, bs.FEATURES) + rounded_sql("features", "commodity, segment, minute", bf.FEATURES, 4),
       "J7 J8 J9 E1 E2 E3 E9 E10")
def bar_features(spark, sf_dir):
    return rounded(bf.bar_features(cut(brand_bars(spark, sf_dir))), 4)


FEED_BARS = """feed_bars AS (
  SELECT commodity, minute, arg_min(price, {'a': event_id}) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, {'a': event_id}) AS close, CAST(count(*) AS DOUBLE) AS volume FROM feed GROUP BY 1, 2)"""


def feed_bars(spark, sf_dir):
    feed = derived.minute_feed(spark, sf_dir)
    return feed.groupBy("commodity", "minute").agg(
        F.min_by("price", "event_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "event_id").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    )


SEGMENTS_SQL = """seg AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY commodity ORDER BY minute
  ROWS UNBOUNDED PRECEDING) AS INTEGER) AS segment FROM (SELECT *, minute - lag(minute) OVER (PARTITION BY commodity ORDER BY minute) AS gap FROM feed_bars))"""


@query("bar_segments", with_ctes(FEED, FEED_BARS, SEGMENTS_SQL) + "SELECT commodity, minute, close, volume, segment FROM seg", "J3 E12 A10")
def bar_segments(spark, sf_dir):
    segmented = bo.segment_bars(feed_bars(spark, sf_dir), BarConfig(gap_minutes=60))
    return segmented.select("commodity", "minute", "close", "volume", "segment")


@query("loaded_dataset", with_ctes(FEED, FEED_BARS, SEGMENTS_SQL) + """, g AS (
  SELECT commodity, segment, unnest(range(min(minute), max(minute) + 1)) AS minute FROM seg GROUP BY 1, 2),
f AS (SELECT g.commodity, g.minute, open, high, low, last_value(close IGNORE NULLS) OVER (PARTITION BY g.commodity, g.segment ORDER BY g.minute) AS close,
  coalesce(volume, 0.0) AS volume, g.segment FROM g LEFT JOIN seg s ON s.commodity = g.commodity AND s.minute = g.minute)
SELECT commodity, minute, coalesce(open, close) AS open, coalesce(high, close) AS high, coalesce(low, close) AS low, close, volume, segment FROM f""", "A10 J2 J3")
def loaded_dataset(spark, sf_dir):
    return bo.complete_grid(bo.segment_bars(feed_bars(spark, sf_dir), BarConfig(gap_minutes=60)))


@query("tick_bars", with_ctes(TRADES) + f""", b AS (
  SELECT commodity, tick // 20 AS idx, {FIRST_PRICE} AS open, max(price) AS high, min(price) AS low, {LAST_PRICE} AS close, sum(quantity) AS volume
  FROM trades GROUP BY 1, 2), g AS (SELECT commodity, unnest(range(0, max(idx) + 1)) AS idx FROM b GROUP BY 1)
SELECT g.idx * 20 AS bar_start, g.commodity, open, high, low, close, CAST(coalesce(volume, 0) AS BIGINT) AS volume FROM g LEFT JOIN b USING (commodity, idx)""", "J4 E14")
def tick_bars(spark, sf_dir):
    return bo.tick_bars(derived.staged(spark, sf_dir, "trade_log"), 20)


@query("candles", with_ctes(TRADES) + f"""SELECT commodity, tick // 25 * 25 AS tick, {FIRST_PRICE} AS open, max(price) AS high, min(price) AS low,
  {LAST_PRICE} AS close, CAST(sum(quantity) AS BIGINT) AS volume, {r('sum(price * quantity) / sum(quantity)')} AS vwap FROM trades GROUP BY commodity, tick // 25""", "J5")
def candles(spark, sf_dir):
    return rounded(bo.candles(derived.staged(spark, sf_dir, "trade_log")))


@query("filled_vwap", with_ctes(TRADES) + f""", b AS (SELECT commodity, tick // 10 AS bar, sum(price * quantity) / sum(quantity) AS v FROM trades GROUP BY 1, 2),
g AS (SELECT commodity, unnest(range(min(bar), max(bar) + 1)) AS bar FROM b GROUP BY 1)
SELECT g.commodity, g.bar * 10 AS tick, {r("last_value(v IGNORE NULLS) OVER (PARTITION BY g.commodity ORDER BY g.bar)")} AS vwap FROM g LEFT JOIN b USING (commodity, bar)""", "J6")
def filled_vwap(spark, sf_dir):
    return rounded(bo.filled_vwap(derived.staged(spark, sf_dir, "trade_log")))
