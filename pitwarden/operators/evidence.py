"""Measured facts behind alert cases, for all cases in one job.

Orders and fills reach a case through (market, account) plus time; market-wide baselines
come from per-tick histograms; sums over a resting period are differences of running totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pitwarden.config import LARGE_ORDER_MULTIPLE
from pitwarden.functions.exprs import bp, rnd
from pitwarden.operators.asof import near_points, range_sums
from pitwarden.operators.effect import price_at, tick_prices
from pitwarden.operators.lineage import cut
from pitwarden.operators.overview import legs
from pitwarden.operators.ranges import overlap_join

BURST_WINDOW = 60
ACCOUNT = ["commodity", "trader_id"]


def case_spans(cases: DataFrame, *personas: str) -> DataFrame:
    return cases.filter(F.col("persona").isin(*personas)).select("case_id", *ACCOUNT, F.col("start_tick").alias("start"), F.col("end_tick").alias("end"))


def account_legs(trades: DataFrame, spans: DataFrame, lo: str, hi: str) -> DataFrame:
    """Per (market, account, side, tick) near a span (market, account, side, lo, hi): filled and aggressively filled quantity."""
    both = near_points(legs(trades, "commodity", "tick", "quantity", "aggressor_side"), spans, [*ACCOUNT, "side"], lo, hi)
    return both.groupBy(*ACCOUNT, "side", "tick").agg(
        F.sum("quantity").alias("qty"), F.sum(F.when(F.col("side") == F.col("aggressor_side"), F.col("quantity")).otherwise(0)).alias("aggr_qty")
    )


def span_median_size(spans: DataFrame, orders: DataFrame) -> DataFrame:
    """Median size of all orders placed in the market during each span (1 when none)."""
    sizes = orders.filter("event_type = 'placed'").groupBy("commodity", "tick", "quantity").agg(F.count(F.lit(1)).alias("n"))
    distinct = spans.select("commodity", "start", "end").distinct()
    hit = overlap_join(sizes, distinct, ["commodity"], ("tick", "tick"), ("start", "end"))
    # Totals per size before the percentile: the final aggregate sees distinct sizes only.
    per = hit.groupBy("commodity", "start", "end", "quantity").agg(F.sum("n").alias("n"))
    med = per.groupBy("commodity", "start", "end").agg(F.percentile(F.col("quantity").cast("double"), 0.5, F.col("n")).alias("median_size"))
    return spans.join(med, ["commodity", "start", "end"], "left").withColumn("median_size", F.coalesce("median_size", F.lit(1.0)))


def case_orders(spans: DataFrame, orders: DataFrame, event: str) -> DataFrame:
    """The account's own events of one kind inside each case span."""
    own = orders.filter(F.col("event_type") == event).select(*ACCOUNT, "order_id", "side", "price", "quantity", "tick")
    return overlap_join(own, spans, ACCOUNT, ("tick", "tick"), ("start", "end"))


def first_cancel(orders: DataFrame) -> DataFrame:
    return orders.filter("event_type = 'cancelled'").groupBy(*ACCOUNT, "order_id").agg(F.min("tick").alias("cancel_tick"))


def _whole(c: Column) -> Column:
    """Integer part, as an int cast of a float gives."""
    return F.floor(c).cast("long")


def spoofing_facts(cases: DataFrame, trades: DataFrame, orders: DataFrame, personas: tuple[str, ...] = ("spoofing",)) -> DataFrame:
    """Large orders against the market's median size, their cancels, and what filled meanwhile."""
    spans = cut(span_median_size(case_spans(cases, *personas), orders))
    prices = cut(tick_prices(trades))
    placed = cut(case_orders(spans, orders, "placed").withColumn(
        "is_large", F.col("quantity") >= LARGE_ORDER_MULTIPLE * F.greatest("median_size", F.lit(1.0))
    ))
    large = placed.filter("is_large").join(first_cancel(orders), [*ACCOUNT, "order_id"], "left")
    gone = large.filter("cancel_tick IS NOT NULL").withColumns({
        "own_side": F.col("side"), "side": F.when(F.col("side") == "buy", "sell").otherwise("buy"),
        "until": F.least(F.col("cancel_tick") + 2, F.col("end") + 2), "t_before": F.col("tick") - 1,
    })
    gone = cut(gone)
    fills = cut(account_legs(trades, gone.withColumn("from", F.least("tick", "cancel_tick")), "from", "until"))
    gone = range_sums(gone, fills.select(*ACCOUNT, "side", "tick", F.col("qty").alias("opp_qty")), [*ACCOUNT, "side"], "tick", "until", ["opp_qty"])
    gone = range_sums(cut(gone), fills.select(*ACCOUNT, "side", "tick", F.col("aggr_qty").alias("flip_qty")), [*ACCOUNT, "side"], "cancel_tick", "until", ["flip_qty"])
    gone = price_at(price_at(cut(gone), prices, "t_before", "p0"), prices, "cancel_tick", "p1")
    beside = placed.select("case_id", F.col("tick").alias("cancel_tick"), F.col("side").alias("own_side")).distinct().withColumn("beside", F.lit(True))
    gone = gone.join(beside, ["case_id", "cancel_tick", "own_side"], "left")
    sign = F.when(F.col("own_side") == "buy", 1.0).otherwise(-1.0)
    g = gone.groupBy("case_id").agg(
        F.count_if(F.col("beside")).alias("large_orders_cancelled_and_replaced_same_tick"),
        F.count_if(F.col("flip_qty") > 0).alias("aggressive_opposite_trades_right_after_cancel"),
        F.sum("flip_qty").alias("aggressive_volume_right_after_cancel"),
        F.count(F.lit(1)).alias("large_orders_cancelled"),
        _whole(F.median(F.col("cancel_tick") - F.col("tick"))).alias("median_large_order_lifetime_ticks"),
        F.count_if(F.col("opp_qty") > 0).alias("large_orders_with_opposite_side_fill_while_resting"),
        F.sum("opp_qty").alias("opposite_side_volume_filled"),
        F.avg(sign * (F.col("p1") - F.col("p0")) / F.col("p0") * 1e4).alias("move"),
    )
    big = F.when(F.col("is_large"), F.col("quantity"))
    p = placed.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("orders_placed"), F.count_if("is_large").alias("large_orders_placed"), F.median(big).alias("large_median"),
        F.count_if(F.col("is_large") & (F.col("side") == "buy")).alias("large_buy_orders"), F.count_if(F.col("is_large") & (F.col("side") == "sell")).alias("large_sell_orders"),
        F.count_if(~F.col("is_large")).alias("small_orders_placed"), F.median(F.when(~F.col("is_large"), F.col("quantity"))).alias("small_median"),
        F.sum("quantity").alias("placed_vol"),
    )
    c = case_orders(spans, orders, "cancelled").groupBy("case_id").agg(F.sum("quantity").alias("cancel_vol"))
    j = spans.join(p, "case_id", "left").join(g, "case_id", "left").join(c, "case_id", "left")
    zero = ("orders_placed", "large_orders_placed", "large_buy_orders", "large_sell_orders", "small_orders_placed",
            "large_orders_cancelled_and_replaced_same_tick", "aggressive_opposite_trades_right_after_cancel", "aggressive_volume_right_after_cancel",
            "large_orders_cancelled", "large_orders_with_opposite_side_fill_while_resting", "opposite_side_volume_filled", "cancel_vol", "placed_vol")
    j = j.fillna(0, list(zero))
    return j.select(
        "case_id", *[z for z in zero if z not in ("cancel_vol", "placed_vol")], "median_large_order_lifetime_ticks",
        F.coalesce(_whole(F.col("large_median")), F.lit(0)).alias("large_order_median_size"),
        F.bround("median_size", 0).cast("long").alias("market_median_order_size"),
        F.when(F.col("large_median").isNotNull() & (F.col("median_size") > 0), rnd(F.col("large_median") / F.col("median_size"), 1)).otherwise(0.0).alias("large_order_size_vs_market_median_x"),
        F.coalesce(_whole(F.col("small_median")), F.lit(0)).alias("small_order_median_size"),
        rnd(F.coalesce("move", F.lit(0.0)), 2).alias("avg_price_move_toward_filled_side_bp"),
        F.when(F.col("placed_vol") > 0, rnd(100 * F.col("cancel_vol") / F.col("placed_vol"), 1)).otherwise(0.0).alias("account_cancelled_volume_pct"),
    )


def layering_facts(cases: DataFrame, trades: DataFrame, orders: DataFrame, min_levels: int = 3) -> DataFrame:
    """Batches of same-tick, same-side orders on several price levels."""
    spans = cut(span_median_size(case_spans(cases, "layering"), orders))
    prices = cut(tick_prices(trades))
    placed = cut(case_orders(spans, orders, "placed"))
    unit = ["case_id", "tick", "side"]
    levels = placed.groupBy(*unit).agg(F.count_distinct("price").alias("levels")).filter(F.col("levels") >= min_levels).select(*unit)
    w = Window.partitionBy(*unit).orderBy("price", "order_id")
    b = placed.join(levels, unit, "left_semi").join(first_cancel(orders), [*ACCOUNT, "order_id"], "left")
    b = cut(b.withColumn("gap", F.col("price") - F.lag("price").over(w)))
    batch = b.groupBy(*unit, *ACCOUNT, "end").agg(F.max("cancel_tick").alias("t1"), F.count(F.lit(1)).alias("n")).withColumns({
        "t1": F.coalesce("t1", F.col("tick") + 5), "t_before": F.col("tick") - 1, "own_side": F.col("side"),
        "side": F.when(F.col("side") == "buy", "sell").otherwise("buy"),
    }).withColumn("until", F.least(F.col("t1") + 2, F.col("end") + 2))
    batch = cut(batch)
    fills = account_legs(trades, batch, "tick", "until").select(*ACCOUNT, "side", "tick", F.col("qty").alias("opp_qty"))
    batch = range_sums(batch, fills, [*ACCOUNT, "side"], "tick", "until", ["opp_qty"])
    batch = price_at(price_at(cut(batch), prices, "t_before", "p0"), prices, "t1", "p1")
    sign = F.when(F.col("own_side") == "buy", 1.0).otherwise(-1.0)
    g = batch.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("multi_level_batches"), _whole(F.median("n")).alias("median_levels_per_batch"),
        F.count_if(F.col("own_side") == "buy").alias("buy_batches"), F.count_if(F.col("own_side") == "sell").alias("sell_batches"),
        F.count_if(F.col("opp_qty") > 0).alias("batches_with_opposite_side_fill_while_resting"),
        rnd(F.coalesce(F.avg(sign * (F.col("p1") - F.col("p0")) / F.col("p0") * 1e4), F.lit(0.0)), 2).alias("avg_price_move_toward_filled_side_bp"),
    )
    o = b.groupBy("case_id").agg(
        F.median("quantity").alias("layer_median"), rnd(F.coalesce(F.median(F.abs("gap")), F.lit(0.0)), 4).alias("median_price_gap_between_layers"),
        rnd(100 * F.avg(F.col("cancel_tick").isNotNull().cast("double")), 1).alias("layer_orders_cancelled_pct"),
        _whole(F.median(F.col("cancel_tick") - F.col("tick"))).alias("median_layer_lifetime_ticks"),
    )
    p = placed.groupBy("case_id").agg(F.count(F.lit(1)).alias("orders_placed"))
    j = spans.join(p, "case_id", "left").join(g, "case_id", "left").join(o, "case_id", "left").fillna(0, ["orders_placed", "multi_level_batches"])
    some = F.col("multi_level_batches") > 0
    return j.select(
        "case_id", "orders_placed", "multi_level_batches", "median_levels_per_batch", "buy_batches", "sell_batches",
        _whole(F.col("layer_median")).alias("median_layer_size"), F.when(some, F.bround("median_size", 0).cast("long")).alias("market_median_order_size"),
        F.when(some & (F.col("median_size") > 0), rnd(F.col("layer_median") / F.col("median_size"), 1)).alias("layer_size_vs_market_median_x"),
        "median_price_gap_between_layers", "layer_orders_cancelled_pct", "median_layer_lifetime_ticks",
        "batches_with_opposite_side_fill_while_resting", "avg_price_move_toward_filled_side_bp",
    )


def case_legs(spans: DataFrame, trades: DataFrame) -> DataFrame:
    """The account's fills inside each case span with counterparty and aggressor flag."""
    both = legs(trades, "commodity", "tick", "price", "quantity", "aggressor_side", "seq")
    both = both.withColumn("aggressive", F.col("side") == F.col("aggressor_side")).drop("aggressor_side")
    return overlap_join(both, spans, ACCOUNT, ("tick", "tick"), ("start", "end"))


def wash_facts(cases: DataFrame, trades: DataFrame) -> DataFrame:
    """Net against gross volume, the top counterparty and distance from the span's VWAP."""
    spans = cut(case_spans(cases, "wash_trading"))
    span = ["commodity", "start", "end"]
    per_tick = trades.groupBy("commodity", "tick").agg(F.sum("quantity").alias("mkt_vol"), F.sum(F.col("price") * F.col("quantity")).alias("mkt_notional"))
    # Cases of one span share its market totals.
    market = range_sums(cut(spans.select(*span).distinct()), per_tick, ["commodity"], "start", "end", ["mkt_vol", "mkt_notional"])
    vwap = F.col("mkt_notional") / F.nullif(F.col("mkt_vol"), F.lit(0))
    known = cut(spans.join(cut(market.select(*span, "mkt_vol", vwap.alias("vwap"))), span))
    # One shuffle by case: the sums per counterparty are frames inside it.
    mine = case_legs(known, trades).select("case_id", "cpty", "side", "price", "quantity", "aggressive", "mkt_vol", "vwap").repartition("case_id")
    pair = Window.partitionBy("case_id", "cpty")
    on = {s: F.when(F.col("side") == s, F.col("quantity")).otherwise(0) for s in ("buy", "sell")}
    both = mine.withColumns({
        "v": F.sum("quantity").over(pair), "n": F.count(F.lit(1)).over(pair), "b": F.sum(on["buy"]).over(pair), "s": F.sum(on["sell"]).over(pair),
    })
    dev = F.abs(F.col("price") - F.col("vwap")) / F.col("vwap") * 1e4
    j = both.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("quantity").alias("gross"), (F.sum(on["buy"]) - F.sum(on["sell"])).alias("net"), F.median("quantity").alias("med"),
        F.median(dev).alias("dev"), F.sum(F.when(F.col("aggressive"), F.col("quantity")).otherwise(0)).alias("aggr"), F.first("mkt_vol").alias("mkt_vol"),
        F.min(F.struct(-F.col("v"), "cpty", "n", "b", "s", "v")).alias("t"),
    )
    return spans.select("case_id").join(j, "case_id", "left").select(
        "case_id", F.coalesce("trades", F.lit(0)).alias("trades"), F.col("gross").alias("gross_volume"), F.col("net").alias("net_position_change"),
        rnd(100 * F.abs("net") / F.col("gross"), 1).alias("net_position_vs_gross_pct"), F.col("t.cpty").alias("top_counterparty"),
        rnd(100 * F.col("t.v") / F.col("gross"), 1).alias("volume_with_top_counterparty_pct"), F.col("t.n").alias("trades_with_top_counterparty"),
        F.col("t.b").alias("bought_from_top_counterparty"), F.col("t.s").alias("sold_to_top_counterparty"),
        rnd(100 * F.col("t.v") / F.col("mkt_vol"), 1).alias("pair_share_of_market_volume_pct"), _whole(F.col("med")).alias("median_trade_size"),
        rnd("dev", 2).alias("median_price_distance_from_vwap_bp"), rnd(100 * F.col("aggr") / F.col("gross"), 1).alias("aggressive_share_pct"),
    )


def pump_facts(cases: DataFrame, trades: DataFrame) -> DataFrame:
    """Position path, its peak, what was bought before and sold after, and the largest buying burst."""
    spans = cut(case_spans(cases, "pump_and_dump"))
    prices = cut(tick_prices(trades))
    mine = case_legs(spans, trades)
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    pushed = F.when((F.col("side") == "buy") & F.col("aggressive"), F.col("quantity"))
    own = Window.partitionBy("case_id")
    w = own.orderBy("tick", "side", "seq", "price").rowsBetween(Window.unboundedPreceding, 0)
    path = mine.withColumns({
        "pos": F.sum(signed).over(w), "ord": F.row_number().over(w),
        "push": F.sum(pushed).over(own.orderBy("tick").rangeBetween(-(BURST_WINDOW - 1), 0)),
    })
    path = path.withColumn("peak_tick", F.max_by("tick", F.struct("pos", -F.col("ord"))).over(own))
    bought = (F.col("side") == "buy") & (F.col("tick") <= F.col("peak_tick"))
    sold = (F.col("side") == "sell") & (F.col("tick") > F.col("peak_tick"))

    def total(cond):
        return F.sum(F.when(cond, F.col("quantity")).otherwise(0))

    def burst(volume: Column, tick: Column) -> Column:
        return F.struct(volume.alias("p"), (-tick).alias("t"))

    # A burst window is whole from ``full`` on. Its volume rises only with a print of the account, so the earliest tick of the
    # largest is ``full`` or the tick of a print: the ticks between need no rows.
    full = F.col("start") + BURST_WINDOW - 1
    q = path.groupBy("case_id", "commodity", "start", "end").agg(
        F.first("peak_tick").alias("peak_tick"), F.max("pos").alias("peak_position"),
        F.max_by("pos", "ord").alias("end_position"), F.count(F.lit(1)).alias("trades"),
        total(bought).alias("bought_until_peak_position"), total(bought & F.col("aggressive")).alias("of_which_aggressive_buys"),
        total(sold).alias("sold_after_peak"), total(sold & F.col("aggressive")).alias("of_which_aggressive_sells"),
        F.sum(F.when(F.col("tick") <= full, pushed)).alias("_early"),
        F.max(F.when((F.col("tick") >= full) & (F.col("push") > 0), burst(F.col("push"), F.col("tick")))).alias("_late"),
    )
    early = F.when((F.col("_early") > 0) & (full <= F.col("end")), burst(F.col("_early"), full))
    q = q.withColumn("_top", F.greatest(early, F.col("_late"))).withColumns({
        "burst_end_tick": -F.col("_top.t"), "burst_aggressive_buy_volume": F.col("_top.p"),
    }).drop("_early", "_late", "_top").withColumns({
        "burst_first": F.col("burst_end_tick") - BURST_WINDOW + 1, "burst_before": F.col("burst_end_tick") - BURST_WINDOW,
    })
    q = range_sums(cut(q), prices.select("commodity", "tick", F.col("volume").alias("m")), ["commodity"], "burst_first", "burst_end_tick", ["m"])
    share = F.when(F.col("m") > 0, rnd(100 * F.col("burst_aggressive_buy_volume") / F.col("m"), 1)).otherwise(0.0)
    q = q.withColumn("burst_share_of_market_volume_pct", F.when(F.col("burst_end_tick").isNotNull(), share))
    for tick, out in (("start", "p_start"), ("peak_tick", "p_peak"), ("end", "p_end"), ("burst_before", "b0"), ("burst_end_tick", "b1")):
        q = price_at(cut(q), prices, tick, out)
    facts = q.select(
        "case_id", "trades", "bought_until_peak_position", "of_which_aggressive_buys", "peak_position", F.col("peak_tick").alias("peak_position_tick"),
        "sold_after_peak", "of_which_aggressive_sells", "end_position", rnd("p_start", 4).alias("price_at_start"), rnd("p_peak", 4).alias("price_at_peak_position"),
        rnd("p_end", 4).alias("price_at_end"), bp("p_start", "p_peak").alias("price_change_start_to_peak_bp"), bp("p_peak", "p_end").alias("price_change_peak_to_end_bp"),
        "burst_end_tick", "burst_aggressive_buy_volume", "burst_share_of_market_volume_pct",
        F.when(F.col("burst_end_tick").isNotNull(), bp("b0", "b1")).alias("price_change_over_burst_bp"),
    )
    return facts


def flagged_stretches(flags: DataFrame) -> DataFrame:
    """(market, account, lo, hi): windows of an account that overlap made one, and ``before``, the end of the stretch before."""
    w = Window.partitionBy(*ACCOUNT).orderBy("window_start", "window_end")
    reach = F.max("window_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = flags.withColumn("_opens", F.when(F.col("window_start") <= reach, 0).otherwise(1))
    runs = opens.withColumn("_run", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(*ACCOUNT, "_run").agg(F.min("window_start").alias("lo"), F.max("window_end").alias("hi")).drop("_run")
    return merged.withColumn("before", F.lag("hi").over(Window.partitionBy(*ACCOUNT).orderBy("lo")))


def pump_peers(cases: DataFrame, flags: DataFrame) -> DataFrame:
    """Other accounts alerted for pump and dump in the case's market and span.

    Cases never meet single accounts. An account with k stretches inside a span has k - 1 gaps inside it, so the accounts
    of a span are its stretches less its gaps. Both are counted by their ticks first, and the two smallest names
    of each kind of stretch are enough for the first peer, whoever owns the case.
    """
    spans = cut(case_spans(cases, "pump_and_dump"))
    f = flags.filter("final_flag AND predicted_persona = 'pump_and_dump'").select(*ACCOUNT, "window_start", "window_end")
    stretches = cut(flagged_stretches(f))
    at = ["commodity", "lo", "hi"]
    gaps = stretches.filter("before IS NOT NULL").select("commodity", F.col("before").alias("lo"), F.col("lo").alias("hi"))
    counts = stretches.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).unionByName(gaps.groupBy(*at).agg((-F.count(F.lit(1))).alias("n")))
    names = stretches.select(*at, "trader_id", F.row_number().over(Window.partitionBy(*at).orderBy("trader_id")).alias("_r")).filter("_r <= 2")
    span = ["commodity", "start", "end"]
    distinct = cut(spans.select(*span).distinct())
    inside = (F.col("n") > 0) | ((F.col("lo") >= F.col("start")) & (F.col("hi") <= F.col("end")))
    total = overlap_join(distinct, cut(counts), ["commodity"], ("start", "end"), ("lo", "hi")).filter(inside).groupBy(*span).agg(F.sum("n").alias("n"))
    first = overlap_join(distinct, cut(names), ["commodity"], ("start", "end"), ("lo", "hi")).groupBy(*span).agg(F.slice(F.array_sort(F.collect_set("trader_id")), 1, 2).alias("two"))
    own = overlap_join(spans, stretches.select(*ACCOUNT, "lo", "hi"), ACCOUNT, ("start", "end"), ("lo", "hi"), how="left_semi").select("case_id", F.lit(1).alias("own"))
    peers = F.col("n") - F.coalesce("own", F.lit(0))
    met = spans.join(total.join(first, span), span).join(own, "case_id", "left").filter(peers > 0)
    name = F.when(F.get("two", F.lit(0)) == F.col("trader_id"), F.get("two", F.lit(1))).otherwise(F.get("two", F.lit(0)))
    return met.select("case_id", peers.cast("long").alias("peers"), name.alias("first_peer"))


def generic_facts(cases: DataFrame, trades: DataFrame, orders: DataFrame, personas: tuple[str, ...] = ("anomaly",)) -> DataFrame:
    """Order and trade totals of a case without a named scheme."""
    spans = cut(case_spans(cases, *personas))
    p = case_orders(spans, orders, "placed").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("orders_placed"), F.median("quantity").alias("med"), F.max("quantity").alias("largest_order"), F.sum("quantity").alias("pv")
    )
    c = case_orders(spans, orders, "cancelled").groupBy("case_id").agg(F.sum("quantity").alias("cv"))
    t = case_legs(spans, trades).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("trades"), F.sum(F.when(F.col("side") == "buy", F.col("quantity")).otherwise(0)).alias("bought"),
        F.sum(F.when(F.col("side") == "sell", F.col("quantity")).otherwise(0)).alias("sold"),
    )
    j = spans.select("case_id").join(p, "case_id", "left").join(c, "case_id", "left").join(t, "case_id", "left")
    j = j.fillna(0, ["orders_placed", "largest_order", "pv", "cv", "trades", "bought", "sold"])
    return j.select(
        "case_id", "orders_placed", F.coalesce(_whole(F.col("med")), F.lit(0)).alias("median_order_size"), "largest_order",
        F.when(F.col("pv") > 0, rnd(100 * F.col("cv") / F.col("pv"), 1)).otherwise(0.0).alias("cancelled_volume_pct"), "trades", "bought", "sold",
    )
