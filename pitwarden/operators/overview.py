"""Market overview reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from pitwarden.config import PERSONAS
from pitwarden.functions.exprs import canonical_persona
from pitwarden.functions.rolling import back_fill, forward_fill
from pitwarden.operators.bars import bucket
from pitwarden.operators.lineage import cut
from pitwarden.operators.quantiles import exact_percentiles
from pitwarden.operators.steps import log_order


def legs(trades: DataFrame, *cols: str) -> DataFrame:
    """Two rows per trade: the account and the side it was on."""
    side = F.explode(F.array(
        F.struct(F.col("buyer_trader_id").alias("trader_id"), F.col("seller_trader_id").alias("cpty"), F.lit("buy").alias("side")),
        F.struct(F.col("seller_trader_id").alias("trader_id"), F.col("buyer_trader_id").alias("cpty"), F.lit("sell").alias("side")),
    ))
    return trades.select(*cols, side.alias("leg")).select(*cols, "leg.*")


def market_kpi(trades: DataFrame, events: DataFrame) -> DataFrame:
    """Trades, volume, distinct accounts and episodes per market."""
    t = trades.groupBy("commodity").agg(F.count(F.lit(1)).alias("trades"), F.sum("quantity").alias("volume"))
    a = legs(trades, "commodity").groupBy("commodity").agg(F.count_distinct("trader_id").alias("traders"))
    e = events.groupBy("commodity").agg(F.count(F.lit(1)).alias("events"))
    return t.join(a, "commodity").join(e, "commodity", "left").fillna(0, ["events"])


def last_by_bucket(trades: DataFrame, width: int) -> DataFrame:
    """Last price per bucket of any market, carried forward then back within each market."""
    px = trades.groupBy("commodity", bucket(width).alias("b")).agg(F.max_by("price", log_order()).alias("price"))
    ends = px.agg(F.min("b").alias("a"), F.max("b").alias("z"))
    every = px.select("commodity").distinct().crossJoin(F.broadcast(ends)).select("commodity", F.explode(F.sequence("a", "z")).alias("b"))
    grid = every.join(px.select("b").distinct(), "b", "left_semi")
    w = Window.partitionBy("commodity").orderBy("b")
    full = grid.join(px, ["commodity", "b"], "left").withColumn("price", forward_fill("price", w))
    backwards = Window.partitionBy("commodity").orderBy(F.desc("b"))
    return full.withColumn("price", back_fill("price", backwards)).select("commodity", (F.col("b") * width).alias("bucket"), "price")


def price_index(trades: DataFrame, width: int = 50) -> DataFrame:
    """Bucket prices as an index, 100 at the first bucket."""
    w = Window.partitionBy("commodity").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return last_by_bucket(trades, width).withColumn("index", F.col("price") / F.first("price").over(w) * 100.0)


def snapshot(trades: DataFrame, events: DataFrame, width: int = 50) -> DataFrame:
    """First and last bucket price, change, volume, trades and episodes per market."""
    ends = last_by_bucket(trades, width).groupBy("commodity").agg(F.min_by("price", "bucket").alias("first"), F.max_by("price", "bucket").alias("last"))
    return ends.join(market_kpi(trades, events).drop("traders"), "commodity").withColumn(
        "pct", F.when(F.col("first") != 0, (F.col("last") / F.col("first") - 1) * 100).otherwise(0.0)
    )


def correlation(x: str, y: str):
    """Correlation of two columns from moments; missing when either is constant."""
    sx, sy = F.stddev_samp(x), F.stddev_samp(y)
    return F.when((sx > 0) & (sy > 0), F.covar_samp(x, y) / (sx * sy))


def return_correlation(trades: DataFrame, width: int = 50) -> DataFrame:
    """Correlation of bucket returns for every pair of markets, long form."""
    w = Window.partitionBy("commodity").orderBy("bucket")
    r = last_by_bucket(trades, width).withColumn("ret", F.col("price") / F.lag("price").over(w) - 1).filter("ret IS NOT NULL")
    a = r.select("bucket", F.col("commodity").alias("a"), F.col("ret").alias("ra"))
    b = r.select("bucket", F.col("commodity").alias("b"), F.col("ret").alias("rb"))
    return a.join(b, "bucket").groupBy("a", "b").agg(F.coalesce(correlation("ra", "rb"), F.lit(0.0)).alias("corr"))


def events_by_persona(events: DataFrame) -> DataFrame:
    """Episode counts, one column per persona; 0 where none."""
    named = events.withColumn("persona", canonical_persona("persona"))
    return named.groupBy("commodity").pivot("persona", list(PERSONAS)).count().fillna(0)


def event_list(events: DataFrame) -> DataFrame:
    return events.select("event_id", canonical_persona("persona").alias("persona"), "commodity", "start_tick", "end_tick", "trader_ids")


def flow(trades: DataFrame, orders: DataFrame, width: int = 60) -> DataFrame:
    """Aggressive flow, cancel rate and order-to-trade ratio for buckets that traded."""
    t = trades.groupBy("commodity", bucket(width).alias("b")).agg(
        F.sum(F.when(F.col("aggressor_side") == "buy", F.col("quantity")).otherwise(0)).alias("buy"),
        F.sum(F.when(F.col("aggressor_side") == "sell", F.col("quantity")).otherwise(0)).alias("sell"), F.count(F.lit(1)).alias("trades"),
    )
    o = orders.groupBy("commodity", bucket(width).alias("b")).agg(
        F.count_if(F.col("event_type") == "placed").alias("placed"), F.count_if(F.col("event_type") == "cancelled").alias("cancelled")
    )
    j = t.join(o, ["commodity", "b"], "left").fillna(0, ["placed", "cancelled"])
    both, acts = F.col("buy") + F.col("sell"), F.col("placed") + F.col("cancelled")
    return j.select(
        "commodity", (F.col("b") * width).alias("tick"), "buy", "sell", "trades", "placed", "cancelled",
        F.when(both > 0, (F.col("buy") - F.col("sell")) / both).otherwise(0.0).alias("imbalance"),
        F.when(acts > 0, F.col("cancelled") / acts).otherwise(0.0).alias("cancel_rate"), (F.col("placed") / F.col("trades")).alias("otr"),
    )


def order_activity(orders: DataFrame, width: int = 300) -> DataFrame:
    """Submissions, cancels and cancel rate per bucket."""
    g = orders.groupBy("commodity", bucket(width).alias("b")).agg(
        F.count_if(F.col("event_type") == "placed").alias("submits"), F.count_if(F.col("event_type") == "cancelled").alias("cancels")
    )
    total = F.col("submits") + F.col("cancels")
    return g.select("commodity", (F.col("b") * width).alias("tick"), "submits", "cancels", F.when(total > 0, F.col("cancels") / total).otherwise(0.0).alias("cancel_rate"))


def volume_profile(trades: DataFrame, bins: int = 40) -> DataFrame:
    """Volume per equal-width, right-closed price bin; the lowest price belongs to the first bin."""
    span = trades.groupBy("commodity").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.greatest(F.ceil((F.col("price") - F.col("lo")) / width), F.lit(1)).cast("int")
    at = F.when(F.col("hi") > F.col("lo"), F.least(at, F.lit(bins))).otherwise(1)
    v = trades.join(span, "commodity").groupBy("commodity", at.alias("bin")).agg(F.sum("quantity").alias("volume"))
    grid = span.select("commodity", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return grid.join(v, ["commodity", "bin"], "left").fillna(0, ["volume"])


def sampled_returns(trades: DataFrame, step: int = 30) -> DataFrame:
    """Log returns (bp) between every ``step``-th tick counted from the market's first print."""
    first = trades.groupBy("commodity").agg(F.min("tick").alias("t0"))
    offset = F.ceil((F.col("tick") - F.col("t0")) / step).cast("long")
    px = trades.join(first, "commodity").groupBy("commodity", offset.alias("i")).agg(F.max_by("price", log_order()).alias("price"), F.min("t0").alias("t0"), F.max("tick").alias("tmax"))
    ends = px.groupBy("commodity").agg(F.max("tmax").alias("t1"), F.min("t0").alias("t0"))
    grid = ends.select("commodity", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("t1") - F.col("t0"), F.lit(step).cast("long")))).alias("i"))
    w = Window.partitionBy("commodity").orderBy("i")
    path = grid.join(px.select("commodity", "i", "price"), ["commodity", "i"], "left").withColumn("price", forward_fill("price", w))
    return path.withColumn("ret", (F.ln("price") - F.ln(F.lag("price").over(w))) * 1e4).filter("ret IS NOT NULL").select("commodity", "i", "ret")


def return_distribution(trades: DataFrame, step: int = 30, bins: int = 40) -> DataFrame:
    """Histogram density of clipped returns beside the fitted normal density."""
    r = cut(sampled_returns(trades, step))
    tails = exact_percentiles(r, ["ret"], [0.005, 0.995], ["commodity"]).groupBy("commodity").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    s = r.groupBy("commodity").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sd")).join(tails, "commodity").filter("n > 20 AND hi > lo")
    width = (F.col("hi") - F.col("lo")) / bins
    x = F.least(F.greatest("ret", "lo"), F.col("hi"))
    at = F.least(F.floor((x - F.col("lo")) / width).cast("int"), F.lit(bins - 1))
    counts = r.join(s, "commodity").groupBy("commodity", at.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    grid = s.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts, ["commodity", "bin"], "left")
    centre = F.col("lo") + (F.col("bin") + 0.5) * width
    z = (centre - F.col("mu")) / F.col("sd")
    normal = F.when(F.col("sd") > 0, F.exp(-0.5 * z * z) / (F.col("sd") * math.sqrt(2 * math.pi))).otherwise(0.0)
    return grid.select("commodity", "bin", centre.alias("centre"), (F.coalesce("c", F.lit(0)) / (F.col("n") * width)).alias("density"), normal.alias("normal"))


def return_moments(trades: DataFrame, step: int = 30) -> DataFrame:
    """Mean, sample deviation and fourth moment over the sample variance squared, less 3."""
    r = sampled_returns(trades, step)
    s = r.groupBy("commodity").agg(F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sd"), F.count(F.lit(1)).alias("n"))
    m4 = r.join(s.select("commodity", "mu"), "commodity").groupBy("commodity").agg(F.avg(F.pow(F.col("ret") - F.col("mu"), F.lit(4.0))).alias("m4"))
    kurt = F.when(F.col("sd") > 0, F.col("m4") / F.pow("sd", F.lit(4.0)) - 3).otherwise(0.0)
    return s.join(m4, "commodity").select("commodity", "n", F.col("mu").alias("mean"), F.col("sd").alias("std"), kurt.alias("excess_kurtosis"))


def top_accounts(trades: DataFrame, n: int = 20) -> DataFrame:
    """The n accounts with the largest two-sided volume of each market."""
    v = legs(trades, "commodity", "quantity").groupBy("commodity", "trader_id").agg(F.sum("quantity").alias("volume"))
    w = Window.partitionBy("commodity").orderBy(F.desc("volume"), "trader_id")
    return v.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def activity_heatmap(trades: DataFrame, width: int = 300, n: int = 20) -> DataFrame:
    """Volume per bucket of the top accounts, long form with zeros on the market's bucket grid."""
    top = top_accounts(trades, n).select("commodity", "trader_id")
    v = legs(trades, "commodity", "tick", "quantity").groupBy("commodity", "trader_id", bucket(width).alias("b")).agg(F.sum("quantity").alias("volume"))
    grid = top.join(v.select("commodity", "b").distinct(), "commodity")
    return grid.join(v, ["commodity", "trader_id", "b"], "left").select("commodity", "trader_id", (F.col("b") * width).alias("bucket"), F.coalesce("volume", F.lit(0)).alias("volume"))


def compare_markets(trades: DataFrame, events: DataFrame, alerts: DataFrame, width: int = 60) -> DataFrame:
    """Change, range, bucket volatility, aggressive share, episodes and alerts per market."""
    t = trades.groupBy("commodity").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("quantity").alias("volume"), F.min_by("price", log_order()).alias("first"),
        F.max_by("price", log_order()).alias("last"), F.max("price").alias("hi"), F.min("price").alias("lo"),
        F.sum(F.when(F.col("aggressor_side") == "buy", F.col("quantity")).otherwise(0)).alias("agg_buy"),
    )
    w = Window.partitionBy("commodity").orderBy("b")
    px = trades.groupBy("commodity", bucket(width).alias("b")).agg(F.max_by("price", log_order()).alias("p"))
    vol = px.withColumn("r", F.ln("p") - F.ln(F.lag("p").over(w))).groupBy("commodity").agg((F.stddev_samp("r") * 1e4).alias("volatility_bp"))
    e = events.groupBy("commodity").agg(F.count(F.lit(1)).alias("episodes"))
    a = alerts.filter("final_flag").groupBy("commodity").agg(F.count(F.lit(1)).alias("alerts"))
    j = t.join(vol, "commodity").join(e, "commodity", "left").join(a, "commodity", "left").fillna(0, ["episodes", "alerts"])
    return j.select(
        "commodity", "trades", "volume", ((F.col("last") / F.col("first") - 1) * 100).alias("change_pct"), ((F.col("hi") - F.col("lo")) / F.col("lo") * 1e4).alias("range_bp"),
        "volatility_bp", (F.col("agg_buy") / F.col("volume")).alias("aggressive_buy_share"), "episodes", "alerts",
    )


def trader_history(trades: DataFrame, orders: DataFrame, top: int = 3) -> DataFrame:
    """Orders, cancels, bought, sold, net and the largest counterparties of every account."""
    k = ["commodity", "trader_id"]
    o = orders.groupBy(*k).agg(F.count_if(F.col("event_type") == "placed").alias("orders"), F.count_if(F.col("event_type") == "cancelled").alias("cancels"))
    pair = legs(trades, "commodity", "quantity").groupBy(*k, "cpty").agg(
        F.sum(F.when(F.col("side") == "buy", F.col("quantity")).otherwise(0)).alias("b"), F.sum(F.when(F.col("side") == "sell", F.col("quantity")).otherwise(0)).alias("s"),
        F.count(F.lit(1)).alias("n"),
    )
    t = pair.groupBy(*k).agg(F.sum("n").alias("trades"), F.sum("b").alias("bought"), F.sum("s").alias("sold"), F.count(F.lit(1)).alias("counterparties"))
    w = Window.partitionBy(*k).orderBy(F.desc(F.col("b") + F.col("s")), "cpty")
    best = pair.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).groupBy(*k).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "cpty"))), lambda x: x["cpty"]), ",").alias("top_counterparties")
    )
    j = o.join(t, k, "full").join(best, k, "left").fillna(0, ["orders", "cancels", "trades", "bought", "sold", "counterparties"])
    return j.withColumn("net", F.col("bought") - F.col("sold"))
