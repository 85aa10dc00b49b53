"""Window stage: overlapping windows of W steps, account formulas and market context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pitwarden.config import PEER_Z_COLUMNS, FeatureConfig
from pitwarden.functions.exprs import clip, finite, safe_div, starts_with_any
from pitwarden.functions.rolling import trailing
from pitwarden.operators.lineage import cut


BLOCK = "_block"
BLOCK_WINDOWS = 8  # windows of one block, in window lengths


def to_windows(
    df: DataFrame, bounds: DataFrame, keys: list[str], sums: list[str], maxes: list[str], cfg: FeatureConfig,
    by: list[str] | None = None, repeated: bool = False,
) -> DataFrame:
    """Sum / max of the step rows of every complete window that holds at least one.

    Window w covers steps [w - W + 1, w].  Step rows are shuffled once, by (market, block of windows, ``keys``), and only
    the last W - 1 steps of a block are sent to two blocks; rows are repeated for their windows inside the block's task,
    never in a shuffle.  With ``by``, a part of ``keys``, rows are shuffled by it and the block stays in the result, so that
    groupings by (market, block, window, ``by``) need no further shuffle.  Such a group has many keys with few steps
    each: a window is then produced once, by its last step row, from frames over the rows before it.
    ``repeated`` rows of a key and step are merged in the block's task before they meet their windows.
    """
    k, n = list(cfg.keys), cfg.n_steps
    width = BLOCK_WINDOWS * n
    step, lo = F.col("step").cast("long"), F.greatest(F.col("step"), F.col("first_step") + n - 1)
    hi = F.least(F.col("step") + n - 1, F.col("last_step"))
    # lo > hi only where the row's windows are all incomplete; bounds hold at least one window.
    blocks = F.sequence(F.floor(F.least(lo, hi) / width), F.floor(hi / width))
    spread = (
        df.join(bounds, k).filter(lo <= hi)
        .select(*k, *keys, step.alias("step"), lo.cast("long").alias("_lo"), hi.cast("long").alias("_hi"), *sums, *maxes, F.explode(blocks).alias(BLOCK))
        .repartition(*k, BLOCK, *(keys if by is None else by))
    )
    first, last = F.greatest(F.col("_lo"), F.col(BLOCK) * width), F.least(F.col("_hi"), F.col(BLOCK) * width + width - 1)
    if by is None:
        if repeated:
            spread = spread.groupBy(*k, BLOCK, *keys, "step", "_lo", "_hi").agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxes])
        placed = spread.withColumn("win", F.explode(F.sequence(first, last)))
        rolled = placed.groupBy(*k, BLOCK, "win", *keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxes])
        return rolled.drop(BLOCK)
    w = Window.partitionBy(*k, BLOCK, *keys).orderBy("step")
    frames = [w.rangeBetween(-(n - 1 - d), 0) for d in range(n)]
    until = F.coalesce(F.lead("step").over(w) - 1, F.col("_hi"))
    rolled = spread.select(
        *k, BLOCK, *keys, "step",
        first.alias("_lo"), F.least(last, until).alias("_hi"),
        *[F.sum(c).over(f).alias(f"_{d}_{c}") for d, f in enumerate(frames) for c in sums],
        *[F.max(c).over(f).alias(f"_{d}_{c}") for d, f in enumerate(frames) for c in maxes],
    )
    out = rolled.filter("_lo <= _hi").withColumn("win", F.explode(F.sequence("_lo", "_hi")))
    late = F.col("win") - F.col("step")

    def at(c: str) -> Column:
        value = F.when(late == 0, F.col(f"_0_{c}"))
        for d in range(1, n):
            value = value.when(late == d, F.col(f"_{d}_{c}"))
        return value.alias(c)

    return out.select(*k, BLOCK, "win", *keys, *[at(c) for c in (*sums, *maxes)])


def add_span(df: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """window_start and inclusive window_end in ticks."""
    s = cfg.step_ticks
    return df.withColumns({
        "window_start": (F.col("win") - cfg.n_steps + 1) * s,
        "window_end": (F.col("win") + 1) * s - 1,
    })


# Published names of the market and account features, in their order (also BEHAVIOUR_FEATURES).
MARKET_FEATURES = (
    "mkt_volume", "mkt_trades", "mkt_return_bp", "mkt_volatility_bp", "mkt_range_bp", "mkt_volume_spike",
    "mkt_trade_imbalance", "mkt_order_imbalance", "mkt_cancel_ratio", "mkt_abnormal_return_z",
)
MARKET_CONTEXT = tuple(c for c in MARKET_FEATURES if c not in ("mkt_volume", "mkt_trades"))


def market_windows(price_path: DataFrame, orders_by_step: DataFrame, bounds: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Ten market features per (market, window), from rolling frames over dense steps."""
    k, n, back = list(cfg.keys), cfg.n_steps, cfg.lookback_windows * cfg.n_steps
    flow = orders_by_step.groupBy(*k, "step").agg(
        *[F.sum(c).alias(c) for c in ("placed_buy", "placed_sell", "n_placed", "n_cancel")]
    )
    st = price_path.join(flow, [*k, "step"], "left").fillna(0.0, ["placed_buy", "placed_sell", "n_placed", "n_cancel"])
    w = Window.partitionBy(*k).orderBy("step")
    rolled = {
        f"r_{c}": trailing(c, w, n, "sum", n)
        for c in ("vol", "n_trades", "agg_buy", "placed_buy", "placed_sell", "n_placed", "n_cancel")
    }
    st = st.withColumns({
        **rolled,
        "mkt_return_bp": F.coalesce((F.ln("last") - F.ln(F.lag("last", n).over(w))) * 1e4, F.lit(0.0)),
        "mkt_volatility_bp": F.coalesce(trailing("ret", w, n, "std", n), F.lit(0.0)) * 1e4,
        "r_hi": trailing(F.coalesce("hi", "last"), w, n, "max", n),
        "r_lo": trailing(F.coalesce("lo", "last"), w, n, "min", n),
        "first_row": F.row_number().over(w),
    })
    st = st.withColumn("abs_ret", F.abs("mkt_return_bp"))
    st = st.withColumns({
        "base_vol": trailing("r_vol", w, back, "mean", n, lag=n),
        "mu": trailing("abs_ret", w, back, "mean", n, lag=n),
        "sd": trailing("abs_ret", w, back, "std", n, lag=n),
    })
    z = F.when(F.col("sd") > 0, (F.col("abs_ret") - F.col("mu")) / F.col("sd"))
    out = st.select(
        *k, F.col("step").alias("win"),
        F.col("r_vol").alias("mkt_volume"),
        F.col("r_n_trades").alias("mkt_trades"),
        "mkt_return_bp", "mkt_volatility_bp",
        (safe_div(F.col("r_hi") - F.col("r_lo"), "r_lo") * 1e4).alias("mkt_range_bp"),
        safe_div("r_vol", F.coalesce("base_vol", "r_vol"), 1.0).alias("mkt_volume_spike"),
        safe_div(2 * F.col("r_agg_buy") - F.col("r_vol"), "r_vol").alias("mkt_trade_imbalance"),
        safe_div(F.col("r_placed_buy") - F.col("r_placed_sell"), F.col("r_placed_buy") + F.col("r_placed_sell")).alias("mkt_order_imbalance"),
        safe_div("r_n_cancel", "r_n_placed").alias("mkt_cancel_ratio"),
        clip(F.coalesce(z, F.lit(0.0)), -10.0, 10.0).alias("mkt_abnormal_return_z"),
    )
    inside = out.join(bounds, k).filter(F.col("win") >= F.col("first_step") + n - 1)
    filled = inside.select(*k, "win", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in MARKET_FEATURES])
    return add_span(filled, cfg)


ACCOUNT_SUMS = (
    "n_placed", "placed_vol", "placed_buy", "placed_sell", "placed_q2", "large_vol", "dist_q", "layer_vol",
    "n_cancel", "cancel_vol", "cancel_buy", "cancel_sell", "fast_cancel", "large_cancel", "lifetime_sum", "n_replaced",
    "n_exec", "exec_buy", "exec_sell", "aggr_vol", "dev_sum", "exec_q2", "n_large_cancel", "n_large_cancel_opp",
)


def account_windows(order_steps: DataFrame, trade_steps: DataFrame, bait_steps: DataFrame | None, bounds: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """One row per (market, window, account) that ordered, cancelled or traded.

    The outer join of the step tables is a union followed by one aggregation. ``bait_steps``: none, if not asked for.
    """
    step_rows = order_steps.unionByName(trade_steps, allowMissingColumns=True)
    if bait_steps is not None:
        step_rows = step_rows.unionByName(bait_steps, allowMissingColumns=True)
    step_rows = step_rows.filter(~starts_with_any("trader_id", cfg.exclude_prefixes))
    sums = [c for c in ACCOUNT_SUMS if c in step_rows.columns]
    win = to_windows(step_rows, bounds, ["trader_id"], sums, ["placed_max"], cfg)
    return win.fillna(0.0, [*sums, "placed_max"])


def traded_windows(trades: DataFrame, orders: DataFrame, bounds: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """``net_qty`` and ``exec_vol`` of every row of ``account_windows``.

    They need no prices, baselines or counterparties, and an order only makes its windows exist: both logs go straight to
    the blocks of windows.
    """
    k, q = list(cfg.keys), F.col("quantity").cast("double")
    step = F.call_function("div", F.col("tick"), F.lit(cfg.step_ticks).cast("long")).alias("step")

    def leg(account: str, bought: Column, sold: Column) -> Column:
        return F.struct(F.col(account).alias("trader_id"), bought.alias("exec_buy"), sold.alias("exec_sell"))

    none = F.lit(0.0)
    legs = F.explode(F.array(leg("buyer_trader_id", q, none), leg("seller_trader_id", none, q))).alias("leg")
    present = orders.filter("event_type IN ('placed', 'cancelled')").select(*k, step, "trader_id", none.alias("exec_buy"), none.alias("exec_sell"))
    rows = trades.select(*k, step, legs).select(*k, "step", "leg.*").unionByName(present).filter(~starts_with_any("trader_id", cfg.exclude_prefixes))
    win = to_windows(rows, bounds, ["trader_id"], ["exec_buy", "exec_sell"], [], cfg, repeated=True).fillna(0.0, ["exec_buy", "exec_sell"])
    buy, sell = F.col("exec_buy"), F.col("exec_sell")
    return win.select(*k, "win", "trader_id", (buy - sell).alias("net_qty"), (buy + sell).alias("exec_vol"))


def pair_windows(pair_steps: DataFrame, bounds: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Volume of each directed pair and window; all pairs of an account and block of windows are in one partition."""
    return to_windows(pair_steps, bounds, ["trader_id", "cpty"], ["bought", "sold"], [], cfg, ["trader_id"])


def reciprocal_windows(trades: DataFrame, bounds: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """``recip`` of the account windows in which a pair dealt both ways; it is 0 in all others.

    Reciprocal volume is the same for both accounts of a pair: a trade is shuffled once, by its pair, instead of once for
    each of its legs, and only the windows with volume both ways go on to the accounts.
    """
    k, q = list(cfg.keys), F.col("quantity").cast("double")
    step = F.call_function("div", F.col("tick"), F.lit(cfg.step_ticks).cast("long")).alias("step")
    a, b = F.least("buyer_trader_id", "seller_trader_id"), F.greatest("buyer_trader_id", "seller_trader_id")

    def where(account: str) -> Column:
        return F.when(F.col(account) == a, q).otherwise(0.0)

    rows = trades.select(*k, step, a.alias("a"), b.alias("b"), where("buyer_trader_id").alias("up"), where("seller_trader_id").alias("down"))
    both = to_windows(rows, bounds, ["a", "b"], ["up", "down"], [], cfg, ["a", "b"]).withColumn("recip", 2 * F.least("up", "down")).filter("recip <> 0")
    own = both.select(*k, "win", F.explode(F.array_distinct(F.array("a", "b"))).alias("trader_id"), "recip")
    return own.groupBy(*k, "win", "trader_id").agg(F.sum("recip").alias("recip"))


def account_group(pair_win: DataFrame, cfg: FeatureConfig) -> list[str]:
    """Grouping of pair windows by account window, with the block that keeps it in place where there is one."""
    return [*cfg.keys, *([BLOCK] if BLOCK in pair_win.columns else []), "win", "trader_id"]


def counterparty_summary(pair_win: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Largest pair volume, reciprocal volume and number of counterparties per account window."""
    gross = F.col("bought") + F.col("sold")
    return pair_win.groupBy(*account_group(pair_win, cfg)).agg(
        F.max(gross).alias("top_pair"),
        F.sum(2 * F.least("bought", "sold")).alias("recip"),
        F.count(F.lit(1)).cast("double").alias("n_cpty"),
    ).drop(BLOCK)


def _cv(second_moment: Column, mean: Column) -> Column:
    spread = F.sqrt(F.greatest(second_moment - mean * mean, F.lit(0.0)))
    return spread / F.when(mean > 0, mean).otherwise(1.0)


BEHAVIOUR_FEATURES = (
    "n_orders", "n_trades", "exec_vol", "avg_order_size_rel", "max_order_size_rel", "order_size_cv",
    "large_order_share", "layered_order_share", "cancel_replace_ratio", "cancel_ratio", "fast_cancel_ratio",
    "large_cancel_ratio", "mean_cancel_lifetime", "passive_distance_bp", "fill_ratio", "cancel_side_imbalance",
    "exec_side_imbalance", "cancel_exec_opposition", "n_large_cancels", "spoof_signature", "net_flatness",
    "aggressor_ratio", "top_cpty_share", "reciprocal_ratio", "n_counterparties", "trade_size_cv", "price_dev_bp",
)


def account_formulas(acct_win: DataFrame, cpty: DataFrame | None, baseline: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Behaviour features of one account window, plus its net traded quantity.

    Features of counterparties and of large cancels are left out where the columns they need are not given.
    """
    k = [*cfg.keys, "win"]
    f = acct_win.join(baseline, k, "left").fillna(1.0, ["size_baseline"])
    if cpty is not None:
        f = f.join(cpty, [*k, "trader_id"], "left").fillna(0.0, [c for c in cpty.columns if c in ("top_pair", "recip", "n_cpty")])
    asks = {
        "n_large_cancels": "n_large_cancel", "spoof_signature": "n_large_cancel",
        "top_cpty_share": "top_pair", "reciprocal_ratio": "recip", "n_counterparties": "n_cpty",
    }
    absent = {feature for feature, column in asks.items() if column not in f.columns}
    ev = F.col("exec_buy") + F.col("exec_sell")
    avg = safe_div("placed_vol", "n_placed")
    mean_trade = safe_div(ev, "n_exec")
    no_new = F.when(F.col("cancel_vol") > 0, 1.0).otherwise(0.0)
    cancel_imb = safe_div(F.col("cancel_buy") - F.col("cancel_sell"), F.col("cancel_buy") + F.col("cancel_sell"))
    exec_imb = safe_div(F.col("exec_buy") - F.col("exec_sell"), ev)
    cols = {
        "n_orders": F.col("n_placed"),
        "n_trades": F.col("n_exec"),
        "exec_vol": ev,
        "avg_order_size_rel": avg / F.col("size_baseline"),
        "max_order_size_rel": F.col("placed_max") / F.col("size_baseline"),
        "order_size_cv": _cv(safe_div("placed_q2", "n_placed"), avg),
        "large_order_share": safe_div("large_vol", "placed_vol"),
        "layered_order_share": safe_div("layer_vol", "placed_vol"),
        "cancel_replace_ratio": clip(safe_div("n_replaced", "n_cancel"), 0.0, 1.0),
        "cancel_ratio": F.when(F.col("placed_vol") > 0, clip(safe_div("cancel_vol", "placed_vol"), 0.0, 1.0)).otherwise(no_new),
        "fast_cancel_ratio": clip(safe_div("fast_cancel", F.greatest("placed_vol", "cancel_vol")), 0.0, 1.0),
        "large_cancel_ratio": clip(safe_div("large_cancel", "large_vol"), 0.0, 1.0),
        "mean_cancel_lifetime": safe_div("lifetime_sum", "n_cancel", float(cfg.window_ticks)),
        "passive_distance_bp": safe_div("dist_q", "placed_vol"),
        "fill_ratio": clip(safe_div(ev, "placed_vol"), 0.0, 2.0),
        "cancel_side_imbalance": cancel_imb,
        "exec_side_imbalance": exec_imb,
        "cancel_exec_opposition": clip(-cancel_imb * exec_imb, 0.0, 1.0),
        "n_large_cancels": F.col("n_large_cancel"),
        "spoof_signature": safe_div("n_large_cancel_opp", "n_large_cancel"),
        "net_flatness": F.when(ev > 0, 1 - F.abs(exec_imb)).otherwise(0.0),
        "aggressor_ratio": safe_div("aggr_vol", ev),
        "top_cpty_share": safe_div("top_pair", ev),
        "reciprocal_ratio": clip(safe_div("recip", ev), 0.0, 1.0),
        "n_counterparties": F.col("n_cpty"),
        "trade_size_cv": _cv(safe_div("exec_q2", "n_exec"), mean_trade),
        "price_dev_bp": safe_div("dev_sum", ev),
    }
    return f.select(*k, "trader_id", *[v.alias(n) for n, v in cols.items() if n not in absent], (F.col("exec_buy") - F.col("exec_sell")).alias("net_qty"))


def peer_scores(features: DataFrame, cfg: FeatureConfig, rows: DataFrame | None = None) -> DataFrame:
    """Robust z of each account against all accounts of the window: median and MAD, else std.

    ``features`` is read twice for the statistics; the scores are added to ``rows``, the same account windows with more columns.

    Medians are plain aggregates joined back (two passes), not window functions: a window
    holding very many accounts is then reduced map-side instead of sorted in one task.  The
    statistics are written first, so that their joins know how small they are and leave the wide rows in place.
    """
    k = [*cfg.keys, "win"]
    med = cut(features.groupBy(*k).agg(*[F.percentile(c, 0.5).alias(f"m_{c}") for c in PEER_Z_COLUMNS]))
    base = features.join(med, k)
    spread = cut(base.groupBy(*k).agg(
        *[F.percentile(F.abs(F.col(c) - F.col(f"m_{c}")), 0.5).alias(f"d_{c}") for c in PEER_Z_COLUMNS],
        *[F.stddev_samp(c).alias(f"s_{c}") for c in PEER_Z_COLUMNS],
    ))
    out = (base if rows is None else rows.join(med, k)).join(spread, k)
    z = {}
    for c in PEER_Z_COLUMNS:
        mad = 1.4826 * F.col(f"d_{c}")
        scale = F.when(mad > 1e-9, mad).otherwise(F.coalesce(F.col(f"s_{c}"), F.lit(0.0)) + 1e-6)
        z[f"peer_z_{c}"] = clip(finite((F.col(c) - F.col(f"m_{c}")) / scale), -20.0, 20.0)
    return out.withColumns(z).drop(*[f"{p}_{c}" for p in "mds" for c in PEER_Z_COLUMNS])
