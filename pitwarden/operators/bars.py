"""Minute bars, grids and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pitwarden.config import BarConfig
from pitwarden.functions.rolling import forward_fill
from pitwarden.operators.islands import number_segments
from pitwarden.operators.steps import log_order

OHLC = ("open", "high", "low", "close")


def bucket(width: int, tick: str = "tick"):
    return F.call_function("div", F.col(tick), F.lit(width).cast("long"))


def ohlcv(trades: DataFrame, width: int, out: str = "bar", keys: tuple[str, ...] = ("commodity",)) -> DataFrame:
    """First, highest, lowest, last price and volume of each bucket that traded."""
    return trades.groupBy(*keys, bucket(width).alias(out)).agg(
        F.min_by("price", log_order()).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", log_order()).alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum(F.col("price") * F.col("quantity")).alias("notional"),
    )


def minute_bars(trades: DataFrame, cfg: BarConfig | None = None) -> DataFrame:
    """One-minute bars of a simulated tape on a completed grid, segment 0."""
    cfg = cfg or BarConfig()
    bars = ohlcv(trades, cfg.bar_ticks, "minute").drop("notional").withColumn("segment", F.lit(0))
    return complete_grid(bars.withColumn("volume", F.col("volume").cast("double")))


def complete_grid(bars: DataFrame, keys: tuple[str, ...] = ("commodity", "segment")) -> DataFrame:
    """Fill missing minutes inside each segment: flat at the last close, volume 0."""
    span = bars.groupBy(*keys).agg(F.min("minute").alias("a"), F.max("minute").alias("b"))
    grid = span.select(*keys, F.explode(F.sequence("a", "b")).alias("minute"))
    w = Window.partitionBy(*keys).orderBy("minute")
    full = grid.join(bars, [*keys, "minute"], "left").withColumn("close", forward_fill("close", w))
    full = full.withColumns({c: F.coalesce(c, "close") for c in ("open", "high", "low")})
    return full.withColumn("volume", F.coalesce("volume", F.lit(0.0))).select(
        "commodity", "minute", *OHLC, "volume", "segment"
    )


def segment_bars(bars: DataFrame, cfg: BarConfig | None = None) -> DataFrame:
    """Number contiguous stretches of real bars per commodity."""
    cfg = cfg or BarConfig()
    return number_segments(bars, ["commodity"], "minute", cfg.gap_minutes)


def tick_bars(trades: DataFrame, width: int) -> DataFrame:
    """Bars from the first bucket of time to the last trade; empty bars stay missing, volume 0."""
    b = ohlcv(trades, width, "idx").drop("notional")
    last = b.groupBy("commodity").agg(F.max("idx").alias("last"))
    grid = last.select("commodity", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("idx"))
    return grid.join(b, ["commodity", "idx"], "left").select(
        (F.col("idx") * width).alias("bar_start"), "commodity", *OHLC, F.coalesce("volume", F.lit(0)).cast("long").alias("volume")
    )


def candles(trades: DataFrame, width: int = 25) -> DataFrame:
    """Bars with VWAP for buckets that traded."""
    b = ohlcv(trades, width)
    return b.select(
        "commodity", (F.col("bar") * width).alias("tick"), *OHLC, "volume", (F.col("notional") / F.col("volume")).alias("vwap")
    )


def filled_vwap(trades: DataFrame, width: int = 10) -> DataFrame:
    """VWAP per bucket on a dense grid, carried forward through quiet buckets."""
    b = ohlcv(trades, width)
    span = b.groupBy("commodity").agg(F.min("bar").alias("a"), F.max("bar").alias("z"))
    grid = span.select("commodity", F.explode(F.sequence("a", "z")).alias("bar"))
    w = Window.partitionBy("commodity").orderBy("bar")
    return (
        grid.join(b, ["commodity", "bar"], "left")
        .withColumn("vwap", forward_fill(F.col("notional") / F.col("volume"), w))
        .select("commodity", (F.col("bar") * width).alias("tick"), "vwap")
    )
