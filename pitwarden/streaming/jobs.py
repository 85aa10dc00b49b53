"""Structured Streaming versions of the window, lifetime, bar and session definitions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pitwarden.operators.lineage import ensure_checkpoint_dir

END_OF_FEED = "3000-01-01 00:00:00"


def sliding_market(events: DataFrame, delay: str = "10 minutes", window: str = "3 minutes", step: str = "30 seconds") -> DataFrame:
    """Prints, volume and price range per (market, sliding window), late rows dropped after ``delay``."""
    w = F.window("ts", window, step)
    return events.withWatermark("ts", delay).groupBy("commodity", w.alias("w")).agg(
        F.count(F.lit(1)).alias("mkt_trades"), F.sum("quantity").alias("mkt_volume"), F.max("price").alias("hi"), F.min("price").alias("lo")
    ).select("commodity", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "mkt_trades", "mkt_volume", "hi", "lo")


def minute_bars(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Tumbling one-minute bars; ``seq`` orders prints inside a timestamp."""
    at = F.struct("ts", "seq")
    return events.withWatermark("ts", delay).groupBy("commodity", F.window("ts", "1 minute").alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume")
    ).select("commodity", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume")


def order_lifetimes(placed: DataFrame, cancelled: DataFrame, max_age: str, delay: str) -> DataFrame:
    """Every placed order with its resting time in seconds, null when no cancel comes within ``max_age``.

    Rows leave the state once the watermark is past ``max_age``; an order cancelled later counts as unmatched.
    """
    p = placed.select("order_id", "commodity", "trader_id", F.col("ts").alias("placed_ts")).withWatermark("placed_ts", delay)
    c = cancelled.select(F.col("order_id").alias("cancel_id"), F.col("ts").alias("cancel_ts")).withWatermark("cancel_ts", delay)
    cond = F.expr(f"order_id = cancel_id AND cancel_ts >= placed_ts AND cancel_ts <= placed_ts + INTERVAL {max_age}")
    return p.join(c, cond, "left").select("order_id", "commodity", "trader_id", "placed_ts", "cancel_ts", (F.unix_timestamp("cancel_ts") - F.unix_timestamp("placed_ts")).alias("lifetime_s"))


def alert_sessions(alerts: DataFrame, gap: str = "2 minutes", delay: str = "10 minutes") -> DataFrame:
    """Alerts of one market at most ``gap`` apart as one session."""
    return alerts.withWatermark("ts", delay).groupBy("commodity", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("alerts"), F.max("score").alias("score")).select(
        "commodity", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "alerts", "score"
    )


def run_to_end(build: Callable[..., DataFrame], *feeds: DataFrame, ts: str = "ts") -> DataFrame:
    """Process finite feeds and close them: whatever is still open at their end is emitted too.

    Append mode holds a window until the watermark passes it, so the last windows of a feed that ends would never come
    out. Each feed is therefore read together with a folder of heartbeats. The first run takes all stored events; then one
    heartbeat per feed, a row at ``END_OF_FEED``, lets the second run of the same query move the watermark past them. Its
    text columns name the feed (a null join key would be filtered out before the watermark), the rest is null; its own
    window stays open. The result is a Parquet table under the checkpoint folder.
    """
    spark: SparkSession = feeds[0].sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    beats = [(f"{base}/heartbeats/{i}", f.schema) for i, f in enumerate(feeds)]

    def beat(closing: bool) -> None:
        for i, (path, schema) in enumerate(beats):
            text = {c.name: f"end of feed {i}" for c in schema if isinstance(c.dataType, T.StringType)}
            row = [F.lit(END_OF_FEED if c.name == ts else text.get(c.name)).cast(c.dataType).alias(c.name) for c in schema]
            spark.range(1 if closing else 0).select(*row).write.mode("append").parquet(path)

    beat(closing=False)
    closed = [f.unionByName(spark.readStream.schema(schema).parquet(path)) for f, (path, schema) in zip(feeds, beats)]
    out = build(*closed)
    for closing in (False, True):
        if closing:
            beat(closing)
        q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")
