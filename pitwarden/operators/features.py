"""The account-feature job: logs in, 61 numeric features per (market, window, account) out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pitwarden.config import LINK_MIN_EVENTS, PEER_Z_COLUMNS, SELF_Z_COLUMNS, FeatureConfig
from pitwarden.functions.exprs import safe_div
from pitwarden.operators import history, linked, rings, steps, windows
from pitwarden.operators.lineage import cut, cut_all

RING_FEATURES = {"mutual_cpty_share": 0.0, "ring_size": 1.0, "ring_volume_share": 0.0}
LINK_FEATURES = {"linked_spoof_signature": 0.0, "linked_lift_log": 0.0}
FEATURE_COLUMNS = (
    *windows.BEHAVIOUR_FEATURES, *RING_FEATURES, *LINK_FEATURES,
    "prev_net_ratio", "long_net_ratio", "activity_vs_history", "reversal_score", "coordinated_peers",
    *windows.MARKET_CONTEXT, "gross_volume_share", "signed_flow_return",
    *[f"peer_z_{c}" for c in PEER_Z_COLUMNS], *[f"self_z_{c}" for c in SELF_Z_COLUMNS],
)


@dataclass(frozen=True)
class StepTables:
    """Reduced tables of the step stage, shared by everything downstream."""

    bounds: DataFrame
    price_path: DataFrame
    baseline: DataFrame
    placed: DataFrame
    cancels: DataFrame
    legs: DataFrame
    order_steps: DataFrame
    trade_steps: DataFrame
    pair_legs: DataFrame
    bait: DataFrame


def build_steps(trades: DataFrame, orders: DataFrame, cfg: FeatureConfig) -> StepTables:
    """Reduce both logs; each reduced table that several stages read is written once."""
    bounds = cut(steps.step_bounds(trades, orders, cfg))
    path, base = cut_all(steps.step_price_path(trades, bounds, cfg), steps.size_baseline(orders, bounds, cfg))
    placed, legs = cut(steps.enrich_placed(orders, path, base, cfg)), steps.leg_ticks(trades, path, cfg)
    cancels = cut(steps.enrich_cancels(orders, placed, cfg))
    by_order, bait = cut_all(steps.order_steps(placed, cancels, cfg), steps.bait_groups(cancels, cfg))
    return StepTables(
        bounds=bounds, price_path=path, baseline=base, placed=placed, cancels=cancels, legs=legs,
        order_steps=by_order, trade_steps=steps.trade_steps(legs, cfg), pair_legs=steps.pair_legs(legs, cfg), bait=bait,
    )


def market_features(trades: DataFrame, orders: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Market features alone; emitted even when every account is excluded."""
    t = build_steps(trades, orders, cfg)
    return windows.market_windows(t.price_path, t.order_steps, t.bounds, cfg).drop("win")


def pairs_and_baseline(t: StepTables, cfg: FeatureConfig) -> tuple[DataFrame, DataFrame]:
    """Pair windows and the size baseline of each window."""
    return windows.pair_windows(t.pair_legs, t.bounds, cfg), cut(steps.window_baseline(t.baseline, t.bounds, cfg))


def behaviour(t: StepTables, cfg: FeatureConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Behaviour formulas, the pair windows and the window size baseline."""
    flagged = steps.opposite_fill_flags(t.bait, t.legs, cfg)
    acct = windows.account_windows(t.order_steps, t.trade_steps, steps.bait_steps(flagged, cfg), t.bounds, cfg)
    pairs, baseline = pairs_and_baseline(t, cfg)
    return windows.account_formulas(acct, windows.counterparty_summary(pairs, cfg), baseline, cfg), pairs, baseline


def own_behaviour(t: StepTables, cfg: FeatureConfig, cpty: DataFrame | None = None) -> DataFrame:
    """The behaviour features that follow from an account's own orders and volumes, for the same account windows.

    Large cancels are cancels, so leaving them out leaves no window out; what is not asked of the trades is not shuffled.
    ``cpty``: those columns of the counterparty summary that are needed, if any.
    """
    acct = windows.account_windows(t.order_steps, t.trade_steps, None, t.bounds, cfg)
    return windows.account_formulas(acct, cpty, cut(steps.window_baseline(t.baseline, t.bounds, cfg)), cfg)


def link_features(t: StepTables, cfg: FeatureConfig) -> DataFrame:
    """Links of each account window.

    A link needs ``LINK_MIN_EVENTS`` events of one bait account in a window, so only the baits of windows with as many
    are paired with partners.  What a link is compared with (all events of its partner, rates of both accounts, large
    cancels of the window) is then computed for the accounts that have one.
    """
    k = list(cfg.keys)
    bait = cut(linked.outsiders(t.bait, cfg))
    busy = windows.to_windows(bait.select(*k, "step", "trader_id", "n"), t.bounds, ["trader_id"], ["n"], [], cfg)
    held = busy.filter(F.col("n") >= LINK_MIN_EVENTS).select(*k, "trader_id", F.explode(F.sequence(F.col("win") - cfg.n_steps + 1, F.col("win"))).alias("step"))
    dense = cut(bait.join(cut(held.distinct()), [*k, "trader_id", "step"], "left_semi"))
    events = linked.linked_pair_steps(dense, t.legs, t.placed, cfg)
    link_win = cut(windows.to_windows(events, t.bounds, ["trader_id", "cpty"], ["n_ev"], [], cfg).filter(F.col("n_ev") >= LINK_MIN_EVENTS))
    partners = cut(link_win.select(*k, F.col("cpty").alias("trader_id")).distinct())
    either = cut(partners.union(link_win.select(*k, "trader_id")).distinct())

    def of(df: DataFrame, who: DataFrame) -> DataFrame:
        return df.join(who, [*k, "trader_id"], "left_semi")

    theirs = linked.linked_pair_steps(bait, of(t.legs, partners), of(t.placed, partners), cfg).groupBy(*k, "step", "cpty").agg(F.sum("n_ev").alias("ev_b"))
    totals = windows.to_windows(theirs, t.bounds, ["cpty"], ["ev_b"], [], cfg)
    large = windows.to_windows(bait.groupBy(*k, "step").agg(F.sum("n").alias("lc_all")), t.bounds, [], ["lc_all"], [], cfg)
    rates = linked.rate_steps(of(bait, either), of(t.legs, either), of(t.placed, either), cfg)
    rate_win = windows.to_windows(rates, t.bounds, ["trader_id"], list(linked.RATE_COLUMNS), [], cfg)
    return linked.linked_features(link_win, *cut_all(totals, large, rate_win), cfg)


def account_features(trades: DataFrame, orders: DataFrame, cfg: FeatureConfig | None = None) -> DataFrame:
    """Model input: every feature of every account window."""
    cfg = cfg or FeatureConfig()
    k = [*cfg.keys, "win"]
    t = build_steps(trades, orders, cfg)
    f, pairs, baseline = behaviour(t, cfg)
    ring = rings.ring_features(cut(rings.mutual_pairs(pairs, baseline, cfg)), cfg)
    link = cut(link_features(t, cfg))
    market = cut(windows.market_windows(t.price_path, t.order_steps, t.bounds, cfg))
    f = (
        f.join(ring, [*k, "trader_id"], "left").join(link, [*k, "trader_id"], "left")
        .fillna({**RING_FEATURES, **LINK_FEATURES})
        .join(market.select(*k, "mkt_volume", *windows.MARKET_CONTEXT), k, "left")
        .withColumns({
            "gross_volume_share": safe_div("exec_vol", "mkt_volume"),
            "signed_flow_return": F.col("exec_side_imbalance") * F.col("mkt_return_bp"),
        })
    )
    f = cut(f)
    who = [*k, "trader_id"]
    # The wide rows are stored once and shuffled once, to meet what their accounts' histories say.
    own = history.coordination(cut(history.own_history(f, cfg)), cfg).drop("exec_side_imbalance")
    scored = windows.peer_scores(f, cfg, f.join(own, who))
    return windows.add_span(scored, cfg).select(*cfg.keys, "window_start", "trader_id", "window_end", *FEATURE_COLUMNS)
