"""Streaming queries: the event table replayed as a stream, results as epoch seconds."""

from pyspark.sql import functions as F

from pitwarden.plans.effects import orders
from pitwarden.plans.registry import query
from pitwarden.plans.shaping import r, rounded
from pitwarden.plans.sql import ORDERS, with_ctes
from pitwarden.sources.derived import EPOCH, staged_path, table
from pitwarden.streaming import jobs


def feed(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    s = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return s.select(F.col("event_type").alias("commodity"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1).cast("long").alias("quantity"), F.col("event_id").alias("seq"))


# Age limit of a resting order; one cancelled later, or never, is reported without a lifetime.
MAX_AGE = "20 DAYS"


def epoch(c: str):
    return F.unix_timestamp(c).alias(c)


@query("stream_sliding_market", f"""WITH x AS (SELECT event_type AS commodity, value, ts, CAST(floor(epoch(ts) / 30) AS BIGINT) AS b FROM events),
w AS (SELECT commodity, (b - k) * 30 AS window_start, (b - k) * 30 + 180 AS window_end, count(*) AS mkt_trades, count(*) AS mkt_volume, max(value) AS hi, min(value) AS lo FROM x, range(6) r(k) GROUP BY 1, 2, 3)
SELECT * FROM w""", "V1")
def stream_sliding_market(spark, sf_dir):
    out = jobs.run_to_end(jobs.sliding_market, feed(spark, sf_dir))
    return out.select("commodity", epoch("window_start"), epoch("window_end"), "mkt_trades", "mkt_volume", "hi", "lo")


@query("stream_minute_bars", f"""SELECT commodity, bar_start, open, high, low, close, volume FROM (SELECT event_type AS commodity, CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 AS bar_start, arg_min(value, {{'t': ts, 's': event_id}}) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, {{'t': ts, 's': event_id}}) AS close, count(*) AS volume FROM events GROUP BY 1, 2)""", "V3 J1")
def stream_minute_bars(spark, sf_dir):
    out = jobs.run_to_end(jobs.minute_bars, feed(spark, sf_dir))
    return out.select("commodity", epoch("bar_start"), "open", "high", "low", "close", "volume")


@query("stream_order_lifetimes", with_ctes(ORDERS) + """SELECT p.order_id, p.commodity, p.trader_id, (c.tick - p.tick) * 86400 AS lifetime_s FROM order_events p LEFT JOIN order_events c ON c.order_id = p.order_id AND c.event_type = 'cancelled'
  AND c.tick >= p.tick AND c.tick <= p.tick + 20 WHERE p.event_type = 'placed'""", "V2 I6")
def stream_order_lifetimes(spark, sf_dir):
    stored = orders(spark, sf_dir)
    s = spark.readStream.schema(stored.schema).parquet(staged_path(spark, sf_dir, "order_log"))
    # Calendar time: the first watermark is 1970-01-01, and a row at or before the watermark counts as late.
    s = s.withColumn("ts", F.timestamp_seconds(F.unix_date(F.lit(EPOCH).cast("date")) * 86400 + F.col("tick") * 86400))

    # The stored log is not in time order: the delay spans it whole, so no event counts as late.
    def lifetimes(placed, cancelled):
        return jobs.order_lifetimes(placed, cancelled, MAX_AGE, "4000 days")

    return jobs.run_to_end(lifetimes, s.filter("event_type = 'placed'"), s.filter("event_type = 'cancelled'")).select("order_id", "commodity", "trader_id", "lifetime_s")


@query("stream_alert_sessions", f"""WITH a AS (SELECT event_type AS commodity, CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 AS m, value AS score FROM events WHERE value >= 20),
b AS (SELECT *, CASE WHEN m - lag(m) OVER w <= 120 THEN 0 ELSE 1 END AS o FROM a WINDOW w AS (PARTITION BY commodity ORDER BY m, score)),
c AS (SELECT *, sum(o) OVER (PARTITION BY commodity ORDER BY m, score ROWS UNBOUNDED PRECEDING) AS i FROM b),
s AS (SELECT commodity, min(m) AS session_start, max(m) + 120 AS session_end, count(*) AS alerts, max(score) AS score FROM c GROUP BY commodity, i)
SELECT * FROM s""", "V4 M14")
def stream_alert_sessions(spark, sf_dir):
    a = feed(spark, sf_dir).filter("price >= 20").select("commodity", F.date_trunc("minute", "ts").alias("ts"), F.col("price").alias("score"))
    return jobs.run_to_end(jobs.alert_sessions, a).select("commodity", epoch("session_start"), epoch("session_end"), "alerts", "score")
