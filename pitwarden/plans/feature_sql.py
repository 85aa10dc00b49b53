"""SQL of the account-feature definitions, as named CTEs (30-tick steps, 6-step windows)."""

from pitwarden.config import PEER_Z_COLUMNS, SELF_Z_COLUMNS, SELF_Z_SCALE_FLOOR
from pitwarden.plans.sql import LAST_PRICE, ORDERS, TRADES

BOUNDS = """bounds AS (
  SELECT commodity, min(tick) // 30 AS first_step, max(tick) // 30 AS last_step
  FROM (SELECT commodity, tick FROM trades UNION ALL SELECT commodity, tick FROM order_events) GROUP BY commodity
  HAVING max(tick) // 30 - min(tick) // 30 + 1 >= 6),
steps AS (SELECT commodity, unnest(range(first_step, last_step + 1)) AS step FROM bounds)"""

PATH = f"""prints AS (
  SELECT commodity, tick // 30 AS step, sum(quantity) AS vol, count(*) AS n_trades, sum(price * quantity) AS notional,
    {LAST_PRICE} AS last, max(price) AS hi, min(price) AS lo,
    sum(quantity) FILTER (WHERE aggressor_side = 'buy') AS agg_buy FROM trades GROUP BY 1, 2),
path0 AS (
  SELECT s.commodity, s.step, CAST(coalesce(vol, 0) AS DOUBLE) AS vol, CAST(coalesce(n_trades, 0) AS DOUBLE) AS n_trades,
    coalesce(notional, 0.0) AS notional, CAST(coalesce(agg_buy, 0) AS DOUBLE) AS agg_buy, hi, lo,
    last_value(last IGNORE NULLS) OVER w AS last,
    last_value(CASE WHEN vol > 0 THEN notional / vol END IGNORE NULLS) OVER w AS vwap
  FROM steps s LEFT JOIN prints p ON s.commodity = p.commodity AND s.step = p.step
  WINDOW w AS (PARTITION BY s.commodity ORDER BY s.step)),
path AS (
  SELECT *, lag(last) OVER w AS ref_price, coalesce(ln(last) - ln(lag(last) OVER w), 0.0) AS ret
  FROM path0 WINDOW w AS (PARTITION BY commodity ORDER BY step))"""

BASELINE = """step_sizes AS (
  SELECT commodity, tick // 30 AS step, quantile_cont(CAST(quantity AS DOUBLE), 0.5) AS step_median
  FROM order_events WHERE event_type = 'placed' GROUP BY 1, 2),
base0 AS (
  SELECT s.commodity, s.step, step_median,
    quantile_cont(step_median, 0.5) OVER (PARTITION BY s.commodity ORDER BY s.step
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_baseline,
    quantile_cont(step_median, 0.5) OVER (PARTITION BY s.commodity ORDER BY s.step
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_baseline
  FROM steps s LEFT JOIN step_sizes z ON s.commodity = z.commodity AND s.step = z.step),
baseline AS (
  SELECT commodity, step, step_median, prior_baseline,
    greatest(coalesce(prior_baseline, current_baseline, 1.0), 1.0) AS baseline FROM base0),
win_baseline AS (
  SELECT commodity, win, greatest(coalesce(b, 1.0), 1.0) AS size_baseline FROM (
    SELECT commodity, step + 5 AS win, last_value(coalesce(prior_baseline, step_median) IGNORE NULLS)
      OVER (PARTITION BY commodity ORDER BY step) AS b FROM baseline) JOIN bounds USING (commodity) WHERE win <= last_step)"""

PLACED = """placed AS (
  SELECT o.commodity, o.order_id, o.trader_id, o.side, o.price, CAST(o.quantity AS DOUBLE) AS quantity, o.tick,
    o.tick // 30 AS step, b.baseline, o.quantity >= 4 * b.baseline AS is_large,
    CASE WHEN o.side = 'buy' THEN 1 ELSE -1 END * (p.ref_price - o.price) / p.ref_price * 1e4 AS dist_bp
  FROM order_events o LEFT JOIN baseline b ON b.commodity = o.commodity AND b.step = o.tick // 30
  LEFT JOIN path p ON p.commodity = o.commodity AND p.step = o.tick // 30 WHERE event_type = 'placed'),
cancels AS (
  SELECT c.commodity, c.order_id, c.trader_id, CAST(c.quantity AS DOUBLE) AS quantity, c.tick, c.tick // 30 AS step,
    p.side, p.tick AS placed_tick, coalesce(p.is_large, false) AS is_large,
    CAST(coalesce(c.tick - p.tick, 180) AS DOUBLE) AS lifetime,
    EXISTS (SELECT 1 FROM placed r WHERE r.commodity = c.commodity AND r.trader_id = c.trader_id AND r.tick = c.tick
            AND r.side = p.side) AS replaced
  FROM order_events c LEFT JOIN placed p ON c.order_id = p.order_id AND c.commodity = p.commodity
  WHERE c.event_type = 'cancelled')"""

ORDER_STEPS = """layered AS (
  SELECT commodity, trader_id, tick, side, count(DISTINCT price) >= 3 AS is_layer FROM placed GROUP BY ALL),
p_step AS (
  SELECT p.commodity, step, p.trader_id, count(*) AS n_placed, sum(quantity) AS placed_vol,
    sum(CASE WHEN p.side = 'buy' THEN quantity ELSE 0 END) AS placed_buy,
    sum(CASE WHEN p.side = 'buy' THEN 0 ELSE quantity END) AS placed_sell, sum(quantity * quantity) AS placed_q2,
    max(quantity) AS placed_max, sum(CASE WHEN is_large THEN quantity ELSE 0 END) AS large_vol,
    coalesce(sum(dist_bp * quantity), 0.0) AS dist_q, sum(CASE WHEN is_layer THEN quantity ELSE 0 END) AS layer_vol
  FROM placed p JOIN layered l ON p.commodity = l.commodity AND p.trader_id = l.trader_id AND p.tick = l.tick AND p.side = l.side
  GROUP BY 1, 2, 3),
c_step AS (
  SELECT commodity, step, trader_id, count(*) AS n_cancel, sum(quantity) AS cancel_vol,
    sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) AS cancel_buy,
    sum(CASE WHEN side = 'sell' THEN quantity ELSE 0 END) AS cancel_sell,
    sum(CASE WHEN lifetime <= 10 THEN quantity ELSE 0 END) AS fast_cancel,
    sum(CASE WHEN is_large THEN quantity ELSE 0 END) AS large_cancel, sum(lifetime) AS lifetime_sum,
    sum(CASE WHEN replaced THEN 1.0 ELSE 0.0 END) AS n_replaced FROM cancels GROUP BY 1, 2, 3)"""

LEGS = """legs AS (
  SELECT t.commodity, t.tick // 30 AS step, t.tick, l.trader_id, l.cpty, l.side, CAST(t.quantity AS DOUBLE) AS qty,
    t.aggressor_side = l.side AS aggressive, abs(t.price - p.vwap) / p.vwap * 1e4 * t.quantity AS dev
  FROM trades t JOIN path p ON p.commodity = t.commodity AND p.step = t.tick // 30,
  LATERAL (SELECT buyer_trader_id AS trader_id, seller_trader_id AS cpty, 'buy' AS side
           UNION ALL SELECT seller_trader_id, buyer_trader_id, 'sell') l),
t_step AS (
  SELECT commodity, step, trader_id, count(*) AS n_exec, sum(CASE WHEN side = 'buy' THEN qty ELSE 0 END) AS exec_buy,
    sum(CASE WHEN side = 'sell' THEN qty ELSE 0 END) AS exec_sell, sum(CASE WHEN aggressive THEN qty ELSE 0 END) AS aggr_vol,
    sum(dev) AS dev_sum, sum(qty * qty) AS exec_q2 FROM legs GROUP BY 1, 2, 3),
pair_step AS (
  SELECT commodity, step, trader_id, cpty, sum(CASE WHEN side = 'buy' THEN qty ELSE 0 END) AS bought,
    sum(CASE WHEN side = 'sell' THEN qty ELSE 0 END) AS sold FROM legs GROUP BY 1, 2, 3, 4)"""

BAIT = """lc AS (
  SELECT c.commodity, c.order_id, c.trader_id, c.side, c.placed_tick, c.tick, c.step,
    EXISTS (SELECT 1 FROM legs l WHERE l.commodity = c.commodity AND l.trader_id = c.trader_id AND l.side <> c.side
            AND l.tick BETWEEN c.placed_tick AND c.tick) AS opp_fill
  FROM cancels c WHERE is_large AND side IS NOT NULL),
lc_step AS (
  SELECT commodity, step, trader_id, count(*) AS n_large_cancel, count(*) FILTER (WHERE opp_fill) AS n_large_cancel_opp
  FROM lc GROUP BY 1, 2, 3)"""


def windows_of(source: str, out: str, keys: str, sums: tuple[str, ...], maxes: tuple[str, ...] = ()) -> str:
    aggs = [f"sum({c}) AS {c}" for c in sums] + [f"max({c}) AS {c}" for c in maxes]
    return f"""{out} AS (
  SELECT x.commodity, x.step + w.k AS win, {keys}, {', '.join(aggs)}
  FROM {source} x, range(6) w(k), bounds b
  WHERE b.commodity = x.commodity AND x.step + w.k BETWEEN b.first_step + 5 AND b.last_step GROUP BY ALL)"""


P_SUMS = ("n_placed", "placed_vol", "placed_buy", "placed_sell", "placed_q2", "large_vol", "dist_q", "layer_vol")
C_SUMS = ("n_cancel", "cancel_vol", "cancel_buy", "cancel_sell", "fast_cancel", "large_cancel", "lifetime_sum", "n_replaced")
T_SUMS = ("n_exec", "exec_buy", "exec_sell", "aggr_vol", "dev_sum", "exec_q2")
L_SUMS = ("n_large_cancel", "n_large_cancel_opp")

_all = [(c, "p") for c in (*P_SUMS, "placed_max")] + [(c, "c") for c in C_SUMS] + [(c, "t") for c in T_SUMS] + [(c, "l") for c in L_SUMS]
ACCOUNT_WINDOWS = ",\n".join([
    windows_of("p_step", "p_win", "trader_id", P_SUMS, ("placed_max",)),
    windows_of("c_step", "c_win", "trader_id", C_SUMS),
    windows_of("t_step", "t_win", "trader_id", T_SUMS),
    windows_of("lc_step", "l_win", "trader_id", L_SUMS),
    windows_of("pair_step", "pair_win", "trader_id, cpty", ("bought", "sold")),
    "tw AS (SELECT commodity, win, trader_id, "
    + ", ".join(f"CAST(coalesce({a}_win.{c}, 0) AS DOUBLE) AS {c}" for c, a in _all)
    + """
  FROM p_win FULL JOIN c_win USING (commodity, win, trader_id) FULL JOIN t_win USING (commodity, win, trader_id)
  FULL JOIN l_win USING (commodity, win, trader_id))""",
])

FORMULAS = """cp AS (
  SELECT commodity, win, trader_id, max(bought + sold) AS top_pair, sum(2 * least(bought, sold)) AS recip,
    count(DISTINCT cpty) AS n_cpty FROM pair_win GROUP BY 1, 2, 3),
raw AS (
  SELECT tw.*, coalesce(top_pair, 0) AS top_pair, coalesce(recip, 0) AS recip, CAST(coalesce(n_cpty, 0) AS DOUBLE) AS n_cpty,
    coalesce(size_baseline, 1.0) AS size_baseline, exec_buy + exec_sell AS ev,
    CASE WHEN n_placed > 0 THEN placed_vol / n_placed ELSE 0 END AS avg_size,
    CASE WHEN n_exec > 0 THEN (exec_buy + exec_sell) / n_exec ELSE 0 END AS mean_trade,
    CASE WHEN cancel_buy + cancel_sell > 0 THEN (cancel_buy - cancel_sell) / (cancel_buy + cancel_sell) ELSE 0 END AS cimb,
    CASE WHEN exec_buy + exec_sell > 0 THEN (exec_buy - exec_sell) / (exec_buy + exec_sell) ELSE 0 END AS eimb
  FROM tw LEFT JOIN cp USING (commodity, win, trader_id) LEFT JOIN win_baseline USING (commodity, win)),
feats AS (
  SELECT commodity, win, trader_id, n_placed AS n_orders, n_exec AS n_trades, ev AS exec_vol,
    avg_size / size_baseline AS avg_order_size_rel, placed_max / size_baseline AS max_order_size_rel,
    sqrt(greatest(CASE WHEN n_placed > 0 THEN placed_q2 / n_placed ELSE 0 END - avg_size * avg_size, 0))
      / CASE WHEN avg_size > 0 THEN avg_size ELSE 1 END AS order_size_cv,
    CASE WHEN placed_vol > 0 THEN large_vol / placed_vol ELSE 0 END AS large_order_share,
    CASE WHEN placed_vol > 0 THEN layer_vol / placed_vol ELSE 0 END AS layered_order_share,
    CASE WHEN n_cancel > 0 THEN least(n_replaced / n_cancel, 1.0) ELSE 0 END AS cancel_replace_ratio,
    CASE WHEN placed_vol > 0 THEN least(cancel_vol / placed_vol, 1.0) WHEN cancel_vol > 0 THEN 1 ELSE 0 END AS cancel_ratio,
    CASE WHEN greatest(placed_vol, cancel_vol) > 0 THEN least(fast_cancel / greatest(placed_vol, cancel_vol), 1.0) ELSE 0 END
      AS fast_cancel_ratio,
    CASE WHEN large_vol > 0 THEN least(large_cancel / large_vol, 1.0) ELSE 0 END AS large_cancel_ratio,
    CASE WHEN n_cancel > 0 THEN lifetime_sum / n_cancel ELSE 180 END AS mean_cancel_lifetime,
    CASE WHEN placed_vol > 0 THEN dist_q / placed_vol ELSE 0 END AS passive_distance_bp,
    CASE WHEN placed_vol > 0 THEN least(ev / placed_vol, 2.0) ELSE 0 END AS fill_ratio,
    cimb AS cancel_side_imbalance, eimb AS exec_side_imbalance,
    greatest(least(-cimb * eimb, 1.0), 0.0) AS cancel_exec_opposition, n_large_cancel AS n_large_cancels,
    CASE WHEN n_large_cancel > 0 THEN n_large_cancel_opp / n_large_cancel ELSE 0 END AS spoof_signature,
    CASE WHEN ev > 0 THEN 1 - abs(eimb) ELSE 0 END AS net_flatness,
    CASE WHEN ev > 0 THEN aggr_vol / ev ELSE 0 END AS aggressor_ratio,
    CASE WHEN ev > 0 THEN top_pair / ev ELSE 0 END AS top_cpty_share,
    CASE WHEN ev > 0 THEN least(recip / ev, 1.0) ELSE 0 END AS reciprocal_ratio, n_cpty AS n_counterparties,
    sqrt(greatest(CASE WHEN n_exec > 0 THEN exec_q2 / n_exec ELSE 0 END - mean_trade * mean_trade, 0))
      / CASE WHEN mean_trade > 0 THEN mean_trade ELSE 1 END AS trade_size_cv,
    CASE WHEN ev > 0 THEN dev_sum / ev ELSE 0 END AS price_dev_bp, exec_buy - exec_sell AS net_qty
  FROM raw)"""

MARKET = """flow AS (
  SELECT commodity, step, sum(placed_buy) AS placed_buy, sum(placed_sell) AS placed_sell, sum(n_placed) AS n_placed
  FROM p_step GROUP BY 1, 2),
cflow AS (SELECT commodity, step, sum(n_cancel) AS n_cancel FROM c_step GROUP BY 1, 2),
mroll AS (
  SELECT p.commodity, p.step, row_number() OVER o AS rn, sum(vol) OVER w AS v, sum(n_trades) OVER w AS nt, sum(agg_buy) OVER w AS ab,
    sum(coalesce(placed_buy, 0)) OVER w AS pb, sum(coalesce(placed_sell, 0)) OVER w AS ps,
    sum(coalesce(n_placed, 0)) OVER w AS np, sum(coalesce(n_cancel, 0)) OVER w AS nc,
    coalesce((ln(last) - ln(lag(last, 6) OVER o)) * 1e4, 0.0) AS ret_bp,
    CASE WHEN row_number() OVER o >= 6 THEN coalesce(stddev_samp(ret) OVER w, 0.0) * 1e4 ELSE 0.0 END AS vola,
    max(coalesce(hi, last)) OVER w AS hi, min(coalesce(lo, last)) OVER w AS lo
  FROM path p LEFT JOIN flow USING (commodity, step) LEFT JOIN cflow USING (commodity, step)
  WINDOW o AS (PARTITION BY p.commodity ORDER BY p.step),
         w AS (PARTITION BY p.commodity ORDER BY p.step ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
mbase AS (
  SELECT *, CASE WHEN rn >= 6 THEN v END AS vv, avg(CASE WHEN rn >= 6 THEN v END) OVER b AS base,
    count(CASE WHEN rn >= 6 THEN v END) OVER b AS nb, avg(abs(ret_bp)) OVER b AS mu, stddev_samp(abs(ret_bp)) OVER b AS sd,
    count(*) OVER b AS nr
  FROM mroll WINDOW b AS (PARTITION BY commodity ORDER BY step ROWS BETWEEN 65 PRECEDING AND 6 PRECEDING)),
market AS (
  SELECT commodity, step AS win, v AS mkt_volume, nt AS mkt_trades, ret_bp AS mkt_return_bp, vola AS mkt_volatility_bp,
    CASE WHEN lo > 0 THEN (hi - lo) / lo * 1e4 ELSE 0 END AS mkt_range_bp,
    CASE WHEN (CASE WHEN nb >= 6 THEN base ELSE v END) > 0 THEN v / (CASE WHEN nb >= 6 THEN base ELSE v END) ELSE 1.0 END AS mkt_volume_spike,
    CASE WHEN v > 0 THEN (2 * ab - v) / v ELSE 0 END AS mkt_trade_imbalance,
    CASE WHEN pb + ps > 0 THEN (pb - ps) / (pb + ps) ELSE 0 END AS mkt_order_imbalance,
    CASE WHEN np > 0 THEN nc / np ELSE 0 END AS mkt_cancel_ratio,
    CASE WHEN nr >= 6 AND sd > 0 THEN greatest(least((abs(ret_bp) - mu) / sd, 10.0), -10.0) ELSE 0.0 END AS mkt_abnormal_return_z
  FROM mbase WHERE rn >= 6)"""

RING = """pw0 AS (SELECT *, bought + sold AS gross, (bought + sold) / sum(bought + sold) OVER (PARTITION BY commodity, win, trader_id) AS share
  FROM pair_win),
pw AS (
  SELECT a.commodity, a.win, a.trader_id, a.cpty, a.gross, a.share, r.share AS share_rev,
    a.share >= 0.1 AND coalesce(r.share, 0) >= 0.1 AND a.gross >= 2 * coalesce(size_baseline, 1.0) AS mutual
  FROM pw0 a LEFT JOIN pw0 r ON r.commodity = a.commodity AND r.win = a.win AND r.trader_id = a.cpty AND r.cpty = a.trader_id
  LEFT JOIN win_baseline b ON b.commodity = a.commodity AND b.win = a.win),
edges AS (SELECT commodity, win, trader_id, cpty FROM pw WHERE mutual),
reach(commodity, win, node, other) AS (
  SELECT DISTINCT commodity, win, trader_id, trader_id FROM edges
  UNION SELECT r.commodity, r.win, r.node, e.cpty FROM reach r JOIN edges e
    ON e.commodity = r.commodity AND e.win = r.win AND e.trader_id = r.other),
comp AS (SELECT commodity, win, node, min(other) AS component, count(*) AS n FROM reach GROUP BY 1, 2, 3),
ring AS (
  SELECT p.commodity, p.win, p.trader_id, least(coalesce(sum(share) FILTER (WHERE mutual), 0), 1.0) AS mutual_cpty_share,
    CAST(any_value(c.n) AS DOUBLE) AS ring_size,
    least(coalesce(sum(share) FILTER (WHERE d.component = c.component), 0), 1.0) AS ring_volume_share
  FROM pw p JOIN comp c ON c.commodity = p.commodity AND c.win = p.win AND c.node = p.trader_id
  LEFT JOIN comp d ON d.commodity = p.commodity AND d.win = p.win AND d.node = p.cpty GROUP BY 1, 2, 3)"""

LINK = """fills AS (SELECT DISTINCT commodity, trader_id, side, tick, cpty FROM legs),
spots AS (SELECT DISTINCT commodity, trader_id, side, tick FROM placed),
lev AS (
  SELECT DISTINCT l.commodity, l.order_id, l.step, l.trader_id, s.trader_id AS cpty
  FROM lc l JOIN spots s ON s.commodity = l.commodity AND s.side <> l.side
    AND s.tick BETWEEN l.placed_tick - 1 AND l.placed_tick + 1 AND s.trader_id <> l.trader_id
  JOIN fills f ON f.commodity = l.commodity AND f.trader_id = s.trader_id AND f.side <> l.side
    AND f.tick BETWEEN l.placed_tick AND l.tick AND f.cpty <> l.trader_id),
link_step AS (SELECT commodity, step, trader_id, cpty, count(*) AS n_ev FROM lev GROUP BY 1, 2, 3, 4),
rate_step AS (
  SELECT commodity, step, trader_id, sum(lc_buy) AS lc_buy, sum(lc_sell) AS lc_sell, sum(life_buy) AS life_buy,
    sum(life_sell) AS life_sell, sum(pt_buy) AS pt_buy, sum(pt_sell) AS pt_sell, sum(f_buy) AS f_buy, sum(f_sell) AS f_sell
  FROM (
    SELECT commodity, step, trader_id, (side = 'buy')::INT AS lc_buy, (side = 'sell')::INT AS lc_sell,
      (side = 'buy')::INT * greatest(tick - placed_tick + 1, 1) AS life_buy,
      (side = 'sell')::INT * greatest(tick - placed_tick + 1, 1) AS life_sell, 0 AS pt_buy, 0 AS pt_sell, 0 AS f_buy, 0 AS f_sell FROM lc
    UNION ALL SELECT commodity, tick // 30, trader_id, 0, 0, 0, 0, (side = 'buy')::INT, (side = 'sell')::INT, 0, 0 FROM spots
    UNION ALL SELECT commodity, step, trader_id, 0, 0, 0, 0, 0, 0, (side = 'buy')::INT, (side = 'sell')::INT FROM legs)
  GROUP BY 1, 2, 3),
""" + windows_of("link_step", "link_win", "trader_id, cpty", ("n_ev",)) + ",\n" + windows_of(
    "rate_step", "rate_win", "trader_id", ("lc_buy", "lc_sell", "life_buy", "life_sell", "pt_buy", "pt_sell", "f_buy", "f_sell")
) + """,
lwin AS (
  SELECT l.commodity, l.win, l.trader_id, l.cpty, l.n_ev, eb.ev_b, la.lc_all, a.lc_buy + a.lc_sell AS n_a,
    a.lc_buy * least(3 * coalesce(b.pt_sell, 0) / 180.0, 1.0)
      * least(CASE WHEN a.lc_buy > 0 THEN a.life_buy / a.lc_buy ELSE 0 END * coalesce(b.f_sell, 0) / 180.0, 1.0)
    + a.lc_sell * least(3 * coalesce(b.pt_buy, 0) / 180.0, 1.0)
      * least(CASE WHEN a.lc_sell > 0 THEN a.life_sell / a.lc_sell ELSE 0 END * coalesce(b.f_buy, 0) / 180.0, 1.0) AS chance
  FROM link_win l
  JOIN (SELECT commodity, win, cpty, sum(n_ev) AS ev_b FROM link_win GROUP BY 1, 2, 3) eb USING (commodity, win, cpty)
  JOIN (SELECT commodity, win, sum(lc_buy + lc_sell) AS lc_all FROM rate_win GROUP BY 1, 2) la USING (commodity, win)
  JOIN rate_win a ON a.commodity = l.commodity AND a.win = l.win AND a.trader_id = l.trader_id
  LEFT JOIN rate_win b ON b.commodity = l.commodity AND b.win = l.win AND b.trader_id = l.cpty WHERE l.n_ev >= {min_events}),
lscore AS (
  SELECT *, least(n_ev / greatest(chance, 1e-6), (n_ev / ev_b) / (n_a / lc_all)) AS lift FROM lwin),
link AS (
  SELECT commodity, win, trader_id, max(s) AS linked_spoof_signature, max(l) AS linked_lift_log FROM (
    SELECT commodity, win, unnest([trader_id, cpty]) AS trader_id,
      least(n_ev / n_a, 1.0) * (1 - 1 / greatest(lift, 1.0)) * n_ev / (n_ev + 4.0) AS s, ln(1 + lift) AS l FROM lscore)
  GROUP BY 1, 2, 3)"""

_LAGS = "RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING"


def _lag(c: str, k: int) -> str:
    return f"coalesce(sum({c}) OVER (PARTITION BY commodity, trader_id ORDER BY win {_LAGS.format(k=k)}), 0)"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0 END"


_pn, _pg = (" + ".join(_lag(c, k) for k in (6, 12)) for c in ("net_qty", "exec_vol"))
_ln, _lg = (" + ".join(_lag(c, k) for k in (0, 6, 12, 18)) for c in ("net_qty", "exec_vol"))

CONTEXT = f"""ctx AS (
  SELECT f.*, coalesce(mutual_cpty_share, 0.0) AS mutual_cpty_share, coalesce(ring_size, 1.0) AS ring_size,
    coalesce(ring_volume_share, 0.0) AS ring_volume_share, coalesce(linked_spoof_signature, 0.0) AS linked_spoof_signature,
    coalesce(linked_lift_log, 0.0) AS linked_lift_log, m.* EXCLUDE (commodity, win, mkt_trades),
    CASE WHEN mkt_volume > 0 THEN exec_vol / mkt_volume ELSE 0 END AS gross_volume_share,
    exec_side_imbalance * mkt_return_bp AS signed_flow_return
  FROM feats f LEFT JOIN ring USING (commodity, win, trader_id) LEFT JOIN link USING (commodity, win, trader_id)
  LEFT JOIN market m ON m.commodity = f.commodity AND m.win = f.win),
pos AS (SELECT *, {_ratio(_pn, '(' + _pg + ')')} AS prev_net_ratio, {_ratio(_ln, '(' + _lg + ')')} AS long_net_ratio FROM ctx)"""


def _activity() -> str:
    out = ["""grid AS (
  SELECT a.commodity, a.trader_id, w.win, coalesce(f.exec_vol + f.n_orders, 0) AS act
  FROM (SELECT DISTINCT commodity, trader_id FROM feats) a
  JOIN (SELECT commodity, unnest(range(min(win), max(win) + 1)) AS win FROM feats GROUP BY commodity) w USING (commodity)
  LEFT JOIN feats f ON f.commodity = a.commodity AND f.trader_id = a.trader_id AND f.win = w.win)""",
           "g0 AS (SELECT *, true AS keep, CAST(NULL AS DOUBLE) AS hist FROM grid)"]
    for i in range(1, 5):
        out.append(f"""g{i} AS (SELECT commodity, trader_id, win, act, hist,
    NOT coalesce(abs(ln(1 + act) - ln(1 + hist)) > 1.5, false) AS keep FROM (
    SELECT commodity, trader_id, win, act, quantile_cont(CASE WHEN keep THEN act END, 0.5) OVER (
      PARTITION BY commodity, trader_id ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING) AS hist FROM g{i - 1}))""")
    out.append("act AS (SELECT commodity, trader_id, win, ln(1 + act) - ln(1 + coalesce(hist, 0)) AS activity_vs_history FROM g4)")
    return ",\n".join(out)


def _self_z_stage(i: int, final: bool) -> str:
    frame = "OVER (PARTITION BY commodity, trader_id ORDER BY win RANGE BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING)"
    inner = [f"count(CASE WHEN keep THEN 1 END) {frame} AS n_past"]
    zs = []
    for c in SELF_Z_COLUMNS:
        inner.append(f"quantile_cont(CASE WHEN keep THEN {c} END, [0.25, 0.5, 0.75]) {frame} AS q_{c}")
        z = (f"greatest(least(({c} - q_{c}[2]) / greatest((q_{c}[3] - q_{c}[1]) / 1.349, {SELF_Z_SCALE_FLOOR[c]}), 20), -20)")
        z = f"CASE WHEN n_past >= 10 THEN {z} END"
        if final:
            weight = "1.0" if c == "n_orders" else "n_orders / (n_orders + 5.0)"
            zs.append(f"coalesce({z} * {weight}, 0.0) AS self_z_{c}")
        else:
            zs.append(f"coalesce(abs({z}) >= 4, false)")
    src = f"(SELECT *, {', '.join(inner)} FROM s{i - 1})"
    keep_cols = "commodity, trader_id, win, " + ", ".join(SELF_Z_COLUMNS)
    if final:
        return f"selfz AS (SELECT commodity, trader_id, win, {', '.join(zs)} FROM {src})"
    return f"s{i} AS (SELECT {keep_cols}, NOT ({' OR '.join(zs)}) AS keep FROM {src})"


HISTORY = ",\n".join([
    _activity(),
    "s0 AS (SELECT commodity, trader_id, win, " + ", ".join(SELF_Z_COLUMNS) + ", true AS keep FROM ctx)",
    *[_self_z_stage(i, False) for i in range(1, 5)],
    _self_z_stage(5, True),
])

_bursting = "activity_vs_history > 0.7 AND abs(exec_side_imbalance) > 0.5"
COORD = f"""hist_all AS (
  SELECT p.*, a.activity_vs_history, z.* EXCLUDE (commodity, trader_id, win),
    CASE WHEN {_bursting} THEN sign(exec_side_imbalance) ELSE 0 END AS dir
  FROM pos p JOIN act a ON a.commodity = p.commodity AND a.trader_id = p.trader_id AND a.win = p.win
  JOIN selfz z ON z.commodity = p.commodity AND z.trader_id = p.trader_id AND z.win = p.win),
coord AS (
  SELECT *, greatest(least(-prev_net_ratio * exec_side_imbalance, 1.0), 0.0) AS reversal_score,
    CAST(CASE WHEN dir > 0 THEN sum((dir > 0)::INT) OVER w - 1 WHEN dir < 0 THEN sum((dir < 0)::INT) OVER w - 1 ELSE 0 END AS DOUBLE)
      AS coordinated_peers
  FROM hist_all WINDOW w AS (PARTITION BY commodity, win))"""


def _peer() -> str:
    meds = ", ".join(f"quantile_cont({c}, 0.5) OVER w AS m_{c}" for c in PEER_Z_COLUMNS)
    mads = ", ".join(
        f"quantile_cont(abs({c} - m_{c}), 0.5) OVER w AS d_{c}, stddev_samp({c}) OVER w AS s_{c}" for c in PEER_Z_COLUMNS)
    zs = ", ".join(
        f"greatest(least(({c} - m_{c}) / CASE WHEN 1.4826 * d_{c} > 1e-9 THEN 1.4826 * d_{c} ELSE coalesce(s_{c}, 0) + 1e-6 END, 20), -20)"
        f" AS peer_z_{c}" for c in PEER_Z_COLUMNS)
    return f"""peer0 AS (SELECT *, {meds} FROM {{src}} WINDOW w AS (PARTITION BY commodity, win)),
peer1 AS (SELECT *, {mads} FROM peer0 WINDOW w AS (PARTITION BY commodity, win)),
peer AS (SELECT *, {zs} FROM peer1)"""


PEER = _peer()
LOGS = [TRADES, ORDERS]
STEP_CTES = [*LOGS, BOUNDS, PATH, BASELINE, PLACED, ORDER_STEPS, LEGS, BAIT]
BEHAVIOUR_CTES = [*STEP_CTES, ACCOUNT_WINDOWS, FORMULAS]
