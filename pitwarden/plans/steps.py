"""Step-stage queries over the derived logs."""

from pyspark.sql import functions as F

from pitwarden.config import FeatureConfig
from pitwarden.operators import linked, steps as st, windows
from pitwarden.operators.lineage import cut
from pitwarden.plans import feature_sql as fs
from pitwarden.plans.registry import query
from pitwarden.plans.shaping import r, rounded, rounded_sql
from pitwarden.plans.sql import with_ctes
from pitwarden.sources import derived

CFG = FeatureConfig()
K = list(CFG.keys)


def logs(spark, sf_dir):
    return derived.staged(spark, sf_dir, "trade_log"), derived.staged(spark, sf_dir, "order_log")


def base_tables(spark, sf_dir):
    trades, orders = logs(spark, sf_dir)
    bounds = cut(st.step_bounds(trades, orders, CFG))
    path = cut(st.step_price_path(trades, bounds, CFG))
    return trades, orders, bounds, path, cut(st.size_baseline(orders, bounds, CFG))


PATH_COLS = ("vol", "n_trades", "notional", "last", "hi", "lo", "agg_buy", "vwap", "ret", "ref_price")


@query("step_price_path", with_ctes(*fs.LOGS, fs.BOUNDS, fs.PATH) + rounded_sql("path", "commodity, step", PATH_COLS, 5), "I1 D1 D2 E4 E5 E14")
def step_price_path(spark, sf_dir):
    _, _, _, path, _ = base_tables(spark, sf_dir)
    return rounded(path.select(*K, "step", *PATH_COLS), 5)


@query("size_baseline", with_ctes(*fs.LOGS, fs.BOUNDS, fs.BASELINE)
       + rounded_sql("baseline", "commodity, step", ("step_median", "prior_baseline", "baseline")), "I2 D3 E7")
def size_baseline(spark, sf_dir):
    return rounded(base_tables(spark, sf_dir)[4])


@query("window_baseline", with_ctes(*fs.LOGS, fs.BOUNDS, fs.BASELINE) + rounded_sql("win_baseline", "commodity, win", ("size_baseline",)), "I2 E7")
def window_baseline(spark, sf_dir):
    _, _, bounds, _, base = base_tables(spark, sf_dir)
    return rounded(st.window_baseline(base, bounds, CFG))


@query("placed_enriched", with_ctes(*fs.LOGS, fs.BOUNDS, fs.PATH, fs.BASELINE, fs.PLACED)
       + rounded_sql("placed", "commodity, order_id, trader_id, side, tick, step, is_large", ("quantity", "baseline", "dist_bp"), 4), "I3 I4 B1 B7")
def placed_enriched(spark, sf_dir):
    _, orders, _, path, base = base_tables(spark, sf_dir)
    placed = st.enrich_placed(orders, path, base, CFG)
    return rounded(placed.select(*K, "order_id", "trader_id", "side", "tick", "step", "is_large", "quantity", "baseline", "dist_bp"), 4)


@query("cancel_lifetimes", with_ctes(*fs.LOGS, fs.BOUNDS, fs.PATH, fs.BASELINE, fs.PLACED)
       + "SELECT commodity, order_id, trader_id, side, placed_tick, tick, is_large, lifetime FROM cancels", "I6 C1")
def cancel_lifetimes(spark, sf_dir):
    _, orders, _, path, base = base_tables(spark, sf_dir)
    c = st.enrich_cancels(orders, st.enrich_placed(orders, path, base, CFG), CFG)
    return c.select(*K, "order_id", "trader_id", "side", "placed_tick", "tick", "is_large", "lifetime")


ORDER_STEP_COLS = (*fs.P_SUMS, "placed_max", *fs.C_SUMS)
ORDER_STEP_SQL = with_ctes(*fs.LOGS, fs.BOUNDS, fs.PATH, fs.BASELINE, fs.PLACED, fs.ORDER_STEPS) + "SELECT commodity, step, trader_id, " + ", ".join(
    f"{r(f'coalesce({c}, 0)', 4)} AS {c}" for c in ORDER_STEP_COLS
) + " FROM p_step FULL JOIN c_step USING (commodity, step, trader_id)"


@query("order_steps", ORDER_STEP_SQL, "I5 I7 I8 C2 D1 D7")
def order_steps(spark, sf_dir):
    _, orders, _, path, base = base_tables(spark, sf_dir)
    placed = cut(st.enrich_placed(orders, path, base, CFG))
    out = st.order_steps(placed, st.enrich_cancels(orders, placed, CFG), CFG)
    return rounded(out.select(*K, "step", "trader_id", *ORDER_STEP_COLS), 4)


@query("trade_steps", with_ctes(*fs.LOGS, fs.BOUNDS, fs.PATH, fs.LEGS) + rounded_sql("t_step", "commodity, step, trader_id", fs.T_SUMS, 3), "I9 G1")
def trade_steps(spark, sf_dir):
    trades, _, _, path, _ = base_tables(spark, sf_dir)
    return rounded(st.trade_steps(st.leg_ticks(trades, path, CFG), CFG), 3)


@query("pair_steps", with_ctes(*fs.LOGS, fs.BOUNDS, fs.PATH, fs.LEGS) + "SELECT * FROM pair_step", "I10 G1")
def pair_steps(spark, sf_dir):
    trades, _, _, path, _ = base_tables(spark, sf_dir)
    return st.pair_steps(st.leg_ticks(trades, path, CFG), CFG)


def bait_and_legs(spark, sf_dir):
    trades, orders, bounds, path, base = base_tables(spark, sf_dir)
    placed = cut(st.enrich_placed(orders, path, base, CFG))
    bait = cut(st.bait_groups(st.enrich_cancels(orders, placed, CFG), CFG))
    return bait, st.leg_ticks(trades, path, CFG), placed, bounds


@query("opposite_fills", with_ctes(*fs.LOGS, fs.BOUNDS, fs.PATH, fs.BASELINE, fs.PLACED, fs.LEGS, fs.BAIT)
       + "SELECT commodity, step, trader_id, CAST(n_large_cancel AS DOUBLE) AS n_large_cancel, "
         "CAST(n_large_cancel_opp AS DOUBLE) AS n_large_cancel_opp FROM lc_step", "I11 C6")
def opposite_fills(spark, sf_dir):
    bait, legs, _, _ = bait_and_legs(spark, sf_dir)
    return st.bait_steps(st.opposite_fill_flags(bait, legs, CFG), CFG)


@query("linked_pairs", with_ctes(*fs.STEP_CTES, fs.LINK.format(min_events=3))
       + "SELECT commodity, step, trader_id, cpty, CAST(n_ev AS DOUBLE) AS n_ev FROM link_step", "I12 C7 C8 C9 G2 G3")
def linked_pairs(spark, sf_dir):
    bait, legs, placed, _ = bait_and_legs(spark, sf_dir)
    return linked.linked_pair_steps(bait, legs, placed, CFG)


RATES_SQL = with_ctes(*fs.STEP_CTES, fs.LINK.format(min_events=3)) + rounded_sql("rate_step", "commodity, step, trader_id", linked.RATE_COLUMNS)


@query("link_rates", RATES_SQL, "I12")
def link_rates(spark, sf_dir):
    bait, legs, placed, _ = bait_and_legs(spark, sf_dir)
    return rounded(linked.rate_steps(bait, legs, placed, CFG))


@query("market_windows", with_ctes(*fs.LOGS, fs.BOUNDS, fs.PATH, fs.BASELINE, fs.PLACED, fs.ORDER_STEPS, fs.MARKET)
       + "SELECT commodity, (win - 5) * 30 AS window_start, (win + 1) * 30 - 1 AS window_end, "
       + ", ".join(f"{r(c, 5)} AS {c}" for c in windows.MARKET_FEATURES) + " FROM market", "I18 E1 E4")
def market_windows(spark, sf_dir):
    _, orders, bounds, path, base = base_tables(spark, sf_dir)
    placed = cut(st.enrich_placed(orders, path, base, CFG))
    by_step = st.order_steps(placed, st.enrich_cancels(orders, placed, CFG), CFG)
    return rounded(windows.market_windows(path, by_step, bounds, CFG).drop("win"), 5)
