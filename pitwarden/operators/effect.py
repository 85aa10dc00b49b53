"""Did the manipulation work: effect, profit and evasion measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pitwarden.functions.exprs import clip, rnd, safe_div
from pitwarden.operators.asof import asof_previous, range_sums
from pitwarden.operators.labels import episode_accounts
from pitwarden.operators.lineage import cut
from pitwarden.operators.ranges import overlap_join
from pitwarden.operators.steps import log_order

PRIMARY_METRIC = {
    "spoofing": "fake_depth_share",
    "wash_trading": "wash_volume_share",
    "pump_and_dump": "ignition_pressure",
    "layering": "fake_depth_share",
}
EFFECT_FLOOR, EFFECT_AT_RISK, EFFECT_SURPLUS, EFFECT_CAP = 0.5, 0.65, 1.5, 1.0
PRESSURE_WINDOW = 60
DELAY_REFERENCE = 300
SCORE_WEIGHTS = {"coverage": 0.5, "missed": 0.3, "delay": 0.2}


def tick_prices(trades: DataFrame) -> DataFrame:
    """Last print and volume of each tick that traded."""
    return trades.groupBy("commodity", "tick").agg(F.max_by("price", log_order()).alias("price"), F.sum("quantity").alias("volume"))


def price_at(queries: DataFrame, prices: DataFrame, tick: str, out: str) -> DataFrame:
    """Price in force at ``tick``; missing before the first and after the last print of the market."""
    last = prices.groupBy("commodity").agg(F.max("tick").alias("_last"))
    p = prices.select("commodity", "tick", F.col("price").alias("_px"))
    got = asof_previous(queries, p, ["commodity"], tick, ["_px"], point_tick="tick", out_tick="_at")
    got = got.join(last, "commodity", "left")
    return got.withColumn(out, F.when(F.col(tick) <= F.col("_last"), F.col("_px"))).drop("_px", "_at", "_last")


def spoof_effects(events: DataFrame, orders: DataFrame, prices: DataFrame) -> DataFrame:
    """Fake depth, favourable move, genuine fill rate and cycles of spoofing and layering episodes."""
    ev = events.filter(F.col("persona").isin("spoofing", "layering"))
    acc = episode_accounts(ev)
    tagged = orders.filter("event_type = 'placed'").withColumn("mark", F.substring("order_id", -1, 1)).filter(F.col("mark").isin("s", "l", "g"))
    mine = overlap_join(tagged, acc, ["commodity", "trader_id"], ("tick", "tick"), ("start_tick", "end_tick"))
    bait_mark = F.when(F.col("persona") == "spoofing", "s").otherwise("l")
    mine = mine.withColumn("leg", F.when(F.col("mark") == "g", "genuine").when(F.col("mark") == bait_mark, "bait")).filter("leg IS NOT NULL")
    mine = cut(mine.select("event_id", "commodity", "order_id", "side", "quantity", "tick", "leg"))
    done = orders.filter(F.col("event_type").isin("cancelled", "filled", "partial_fill")).groupBy("commodity", "order_id").agg(
        F.max(F.when(F.col("event_type") == "cancelled", F.col("tick"))).alias("cancel_tick"),
        F.sum(F.when(F.col("event_type") != "cancelled", F.col("quantity"))).alias("filled"),
    )
    known = mine.join(done, ["commodity", "order_id"], "left")
    cycles = known.filter("leg = 'bait'").groupBy("event_id", "commodity", "tick").agg(
        F.min_by("side", "order_id").alias("side"), F.max("cancel_tick").alias("t_end")
    ).withColumns({"t_end": F.coalesce("t_end", F.col("tick") + 5), "t_before": F.col("tick") - 1})
    cycles = price_at(price_at(cut(cycles), prices, "t_before", "p0"), prices, "t_end", "p1")
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    move = F.when(F.col("p0") > 0, sign * (F.col("p1") - F.col("p0")) / F.col("p0") * 1e4)
    per_cycle = cycles.groupBy("event_id").agg(F.avg(move).alias("m"), F.count(F.lit(1)).alias("spoof_cycles"))
    genuine = known.filter("leg = 'genuine'").groupBy("event_id").agg(F.sum("quantity").alias("g"), F.sum("filled").alias("f"))
    rate = F.when(F.col("g") > 0, rnd(F.least(F.lit(1.0), F.coalesce("f", F.lit(0)) / F.col("g")), 4)).otherwise(0.0)
    return (
        ev.join(per_cycle, "event_id", "left").join(genuine, "event_id", "left")
        .select(
            "event_id", "persona",
            rnd(F.coalesce(F.col("parameters")["realised_fake_depth_share"].cast("double"), F.lit(0.0)), 4).alias("fake_depth_share"),
            rnd(F.coalesce("m", F.lit(0.0)), 4).alias("favorable_move_bp"),
            F.when(F.col("spoof_cycles") > 0, rate).otherwise(0.0).alias("genuine_fill_rate"),
            F.coalesce("spoof_cycles", F.lit(0)).alias("spoof_cycles"),
        )
    )


def wash_effects(events: DataFrame, trades: DataFrame, prices: DataFrame) -> DataFrame:
    """Volume the ring crossed with itself against the market's volume in the span."""
    ev = events.filter("persona = 'wash_trading'")
    acc = ev.select("event_id", "commodity", "start_tick", "end_tick", "trader_ids", F.explode(F.array_distinct("trader_ids")).alias("trader_id"))
    buys = trades.select("commodity", F.col("buyer_trader_id").alias("trader_id"), "seller_trader_id", "quantity", "tick")
    inside = overlap_join(buys, acc, ["commodity", "trader_id"], ("tick", "tick"), ("start_tick", "end_tick"))
    crossed = inside.filter(F.array_contains("trader_ids", F.col("seller_trader_id"))).groupBy("event_id").agg(F.sum("quantity").alias("wash_volume"))
    total = range_sums(ev.select("event_id", "commodity", "start_tick", "end_tick"), prices.select("commodity", "tick", "volume"), ["commodity"], "start_tick", "end_tick", ["volume"])
    out = ev.select("event_id", "persona").join(total.select("event_id", "volume"), "event_id").join(crossed, "event_id", "left")
    washed = F.coalesce("wash_volume", F.lit(0)).cast("long")
    return out.select("event_id", "persona", rnd(safe_div(washed.cast("double"), "volume"), 4).alias("wash_volume_share"), washed.alias("wash_volume"))


def pump_effects(events: DataFrame, trades: DataFrame, prices: DataFrame) -> DataFrame:
    """Ignition pressure, price lift and coalition profit of pump-and-dump episodes."""
    ev = events.filter("persona = 'pump_and_dump'").select("event_id", "persona", "commodity", "start_tick", "end_tick", "trader_ids")
    acc = ev.select("event_id", "commodity", "start_tick", "end_tick", F.explode(F.array_distinct("trader_ids")).alias("trader_id"))
    legs = trades.select("commodity", "tick", "price", "quantity", "aggressor_side", F.explode(F.array(
        F.struct(F.col("buyer_trader_id").alias("trader_id"), F.lit("buy").alias("side")),
        F.struct(F.col("seller_trader_id").alias("trader_id"), F.lit("sell").alias("side")))).alias("leg"))
    legs = legs.select("commodity", "tick", "aggressor_side", "leg.*", "quantity", (F.col("price") * F.col("quantity")).alias("notional"))
    legs = legs.groupBy("commodity", "tick", "trader_id", "side").agg(
        F.sum("quantity").alias("quantity"), F.sum("notional").alias("notional"),
        F.sum(F.when(F.col("aggressor_side") == "buy", F.col("quantity")).otherwise(0)).alias("push"),
    )
    mine = overlap_join(legs, acc, ["commodity", "trader_id"], ("tick", "tick"), ("start_tick", "end_tick"))
    ticks = cut(mine.groupBy("event_id", "tick").agg(
        F.sum(F.when(F.col("side") == "buy", F.col("push")).otherwise(0)).alias("push"),
        *[F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(0)).alias(f"{s}_{c}") for s in ("buy", "sell") for c in ("quantity", "notional")],
    ))
    dense = ev.select("event_id", "commodity", F.explode(F.sequence("start_tick", "end_tick")).alias("tick"))
    dense = dense.join(prices.select("commodity", "tick", "volume"), ["commodity", "tick"], "left").join(ticks.select("event_id", "tick", "push"), ["event_id", "tick"], "left")
    w = Window.partitionBy("event_id").orderBy("tick")
    frame = w.rowsBetween(-(PRESSURE_WINDOW - 1), 0)
    full = F.row_number().over(w) >= PRESSURE_WINDOW
    rolled = dense.select("event_id", F.when(full, F.sum(F.coalesce("push", F.lit(0))).over(frame)).alias("p"), F.sum(F.coalesce("volume", F.lit(0))).over(frame).alias("m"))
    pressure = rolled.groupBy("event_id").agg(F.max(F.when(F.col("m") > 0, F.col("p") / F.col("m"))).alias("pressure"))
    own = ticks.groupBy("event_id").agg(
        F.min(F.when(F.col("push") > 0, F.col("tick"))).alias("t0"), F.max(F.when(F.col("push") > 0, F.col("tick"))).alias("t1"),
        *[F.sum(f"{s}_{c}").alias(f"{s}_{c}") for s in ("buy", "sell") for c in ("quantity", "notional")],
    )
    end = prices.groupBy("commodity").agg(F.max("tick").alias("last_tick"), F.max_by("price", "tick").alias("last_price"))
    q = ev.join(end, "commodity").join(own, "event_id", "left").join(pressure, "event_id", "left").withColumns({
        "a": F.col("t0") - 1, "z": F.least(F.col("t1") + 5, F.col("last_tick")), "e": F.least("end_tick", "last_tick"),
    })
    q = price_at(price_at(price_at(cut(q), prices, "a", "p0"), prices, "z", "p1"), prices, "e", "mark")
    lift = F.when(F.col("t0").isNotNull() & (F.col("p0") > 0), (F.col("p1") - F.col("p0")) / F.col("p0") * 1e4)
    n = {c: F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("buy_quantity", "sell_quantity", "buy_notional", "sell_notional")}
    pnl = n["sell_notional"] - n["buy_notional"] + (n["buy_quantity"] - n["sell_quantity"]) * F.coalesce("mark", "last_price")
    return q.select(
        "event_id", "persona",
        rnd(F.when(F.col("t0").isNotNull(), F.coalesce("pressure", F.lit(0.0))).otherwise(0.0), 4).alias("ignition_pressure"),
        rnd(F.coalesce(lift, F.lit(0.0)), 3).alias("price_lift_bp"),
        F.when(n["buy_notional"] > 0, rnd(pnl / n["buy_notional"] * 1e4, 3)).otherwise(0.0).alias("pnl_bp"),
    )


def episode_effects(events: DataFrame, trades: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per episode; measures of other personas are missing."""
    prices = cut(tick_prices(trades))
    return (
        spoof_effects(events, orders, prices)
        .unionByName(wash_effects(events, trades, prices), allowMissingColumns=True)
        .unionByName(pump_effects(events, trades, prices), allowMissingColumns=True)
    )


MEASURES = ("fake_depth_share", "favorable_move_bp", "genuine_fill_rate", "spoof_cycles", "wash_volume_share", "wash_volume",
            "ignition_pressure", "price_lift_bp", "pnl_bp")


def effect_summary(effects: DataFrame) -> DataFrame:
    """Median of every measure per persona, the number of episodes and the primary measure."""
    primary = F.create_map(*[F.lit(x) for kv in PRIMARY_METRIC.items() for x in kv])
    return effects.groupBy("persona").agg(
        *[rnd(F.median(m), 4).alias(m) for m in MEASURES if m in effects.columns], F.count(F.lit(1)).alias("episodes")
    ).withColumn("primary_metric", primary[F.col("persona")])


def account_pnl(events: DataFrame, trades: DataFrame) -> DataFrame:
    """Session profit of each episode's accounts together, trades among them netted out.

    Works on flows per (buyer, seller) pair, so the trade log is read once whatever the
    number of episodes.
    """
    flows = trades.groupBy("commodity", "buyer_trader_id", "seller_trader_id").agg(
        F.sum(F.col("price") * F.col("quantity")).alias("notional"), F.sum("quantity").alias("qty")
    )
    last = trades.groupBy("commodity").agg(F.max_by("price", log_order()).alias("last"))
    acc = events.select("event_id", "commodity", "persona", "trader_ids", F.explode(F.array_distinct("trader_ids")).alias("trader_id"))

    def side(own: str, other: str, sign: int) -> DataFrame:
        f = flows.withColumnRenamed(own, "trader_id").join(acc, ["commodity", "trader_id"])
        f = f.filter(~F.array_contains("trader_ids", F.col(other)))
        return f.select("event_id", (F.lit(-sign) * F.col("notional")).alias("cash"), (F.lit(sign) * F.col("qty")).alias("inventory"), F.col("notional").alias("gross"))

    both = side("buyer_trader_id", "seller_trader_id", 1).unionByName(side("seller_trader_id", "buyer_trader_id", -1))
    total = both.groupBy("event_id").agg(F.sum("cash").alias("cash"), F.sum("inventory").alias("inventory"), F.sum("gross").alias("gross"))
    out = events.filter(F.size("trader_ids") > 0).select("event_id", "persona", "commodity").join(last, "commodity").join(total, "event_id", "left")
    pnl = F.coalesce(F.col("cash") + F.col("inventory") * F.col("last"), F.lit(0.0))
    return out.select("event_id", "persona", F.when(F.col("gross") > 0, pnl / F.col("gross") * 1e4).otherwise(0.0).alias("pnl_bp"), (pnl > 0).alias("profitable"))


def pnl_summary(pnl: DataFrame) -> DataFrame:
    return pnl.groupBy("persona").agg(
        rnd(F.median("pnl_bp"), 2).alias("pnl_bp_median"), rnd(F.avg(F.col("profitable").cast("double")), 3).alias("profitable_share"),
        F.count(F.lit(1)).alias("episodes"),
    )


def merge_pnl(parts: DataFrame) -> DataFrame:
    """Episode-weighted combination of per-market summaries: each value counts once per episode."""
    return parts.groupBy("persona").agg(
        rnd(F.percentile("pnl_bp_median", 0.5, F.col("episodes")), 2).alias("pnl_bp_median"),
        rnd(F.sum(F.col("profitable_share") * F.col("episodes")) / F.sum("episodes"), 3).alias("profitable_share"),
        F.sum("episodes").alias("episodes"),
    )


def effect_ratio(current: Column, baseline: Column) -> Column:
    """Current primary measure over its baseline; missing when undefined."""
    return F.when(baseline > 0, rnd(current / baseline, 3))


def evasion(metrics: DataFrame) -> DataFrame:
    """coverage, missed and delay components and the evasion score of round metrics.

    Uses any-alert columns where present, else the persona's own; effect_ratio scales the score.
    """
    c = F.col
    any_alert = c("caught_coverage").isNotNull()
    cov = F.coalesce(F.when(any_alert, c("caught_coverage")).otherwise(c("episode_coverage")), c("recall"))
    detected = F.when(any_alert, c("caught_events_detected")).otherwise(c("events_detected"))
    missed = safe_div(c("events_total") - detected, "events_total")
    missed = F.greatest(missed, F.when(any_alert, c("caught_weak_share")))
    lat = F.when(any_alert, c("caught_latency_ticks")).otherwise(c("detection_latency_ticks"))
    delay = F.when(lat.isNotNull(), F.least(F.lit(1.0), lat / DELAY_REFERENCE)).otherwise(
        F.when((c("events_total") > 0) & (detected == 0), 1.0).otherwise(0.0)
    )
    out = metrics.withColumns({
        "coverage": rnd(1.0 - cov, 4),
        "missed": F.when(cov.isNotNull(), rnd(missed, 4)),
        "delay": F.when(cov.isNotNull(), rnd(delay, 4)),
    })
    total = sum((F.lit(w) * F.col(n) for n, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    score = F.when(c("effect_ratio") < EFFECT_FLOOR, 0.0).otherwise(rnd(total * F.least(F.lit(EFFECT_CAP), c("effect_ratio")), 4))
    return out.withColumn("mutation_score", F.when(F.col("coverage").isNotNull() & c("effect_ratio").isNotNull(), score))
