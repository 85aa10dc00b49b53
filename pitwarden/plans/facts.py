"""Case-evidence queries."""

from pyspark.sql import functions as F

from pitwarden.operators import evidence as ev
from pitwarden.operators.lineage import cut
from pitwarden.plans.alerts import CASE_CTES, alert_cases, results
from pitwarden.plans.effects import PX, orders, px_at, trades
from pitwarden.plans.overview import LEGS
from pitwarden.plans.registry import query
from pitwarden.plans.sql import ORDERS, with_ctes

LEG_CTE = LEGS.replace("legs AS (SELECT commodity, tick, quantity,", "legs AS (SELECT commodity, tick, price, quantity, seq, aggressor_side = 'buy' AS aggressive,").replace(
    "UNION ALL SELECT commodity, tick, quantity,", "UNION ALL SELECT commodity, tick, price, quantity, seq, aggressor_side = 'sell',")


def spans_sql(persona: str) -> str:
    return f"spans AS (SELECT case_id, commodity, trader_id, start_tick AS s, end_tick AS e FROM cases WHERE persona = '{persona}')"


MEDIAN = """med AS (SELECT commodity, s, e, quantile_cont(CAST(quantity AS DOUBLE), 0.5) AS m FROM (SELECT DISTINCT commodity, s, e FROM spans) x
  JOIN order_events o USING (commodity) WHERE o.event_type = 'placed' AND o.tick BETWEEN s AND e GROUP BY 1, 2, 3),
sp AS (SELECT spans.*, coalesce(m, 1.0) AS m FROM spans LEFT JOIN med USING (commodity, s, e)),
placed AS (SELECT sp.case_id, sp.commodity, sp.trader_id, s, e, m, order_id, side, price, quantity, tick, quantity >= 4 * greatest(m, 1.0) AS is_large FROM sp JOIN order_events o
  ON o.commodity = sp.commodity AND o.trader_id = sp.trader_id AND o.tick BETWEEN s AND e WHERE event_type = 'placed'),
canc AS (SELECT commodity, trader_id, order_id, min(tick) AS cancel_tick FROM order_events WHERE event_type = 'cancelled' GROUP BY 1, 2, 3),
cvol AS (SELECT case_id, sum(quantity) AS cv FROM sp JOIN order_events o ON o.commodity = sp.commodity AND o.trader_id = sp.trader_id AND o.tick BETWEEN s AND e
  WHERE event_type = 'cancelled' GROUP BY 1)"""

SPOOF = f"""gone0 AS (SELECT p.*, cancel_tick FROM placed p JOIN canc USING (commodity, trader_id, order_id) WHERE is_large),
gone AS (SELECT g.*,
  (SELECT coalesce(sum(l.quantity), 0) FROM legs l WHERE l.commodity = g.commodity AND l.trader_id = g.trader_id AND l.side <> g.side AND l.tick BETWEEN g.tick AND least(g.cancel_tick + 2, g.e + 2)) AS opp,
  (SELECT coalesce(sum(l.quantity), 0) FROM legs l WHERE l.commodity = g.commodity AND l.trader_id = g.trader_id AND l.side <> g.side AND l.aggressive
     AND l.tick BETWEEN g.cancel_tick AND least(g.cancel_tick + 2, g.e + 2)) AS flip,
  EXISTS (SELECT 1 FROM placed b WHERE b.case_id = g.case_id AND b.tick = g.cancel_tick AND b.side = g.side) AS beside,
  {px_at('g.commodity', 'g.tick - 1')} AS p0, {px_at('g.commodity', 'g.cancel_tick')} AS p1 FROM gone0 g),
gg AS (SELECT case_id, count(*) FILTER (WHERE beside) AS rep, count(*) FILTER (WHERE flip > 0) AS flips, CAST(sum(flip) AS BIGINT) AS flipv, count(*) AS n, CAST(floor(median(cancel_tick - tick)) AS BIGINT) AS life,
  count(*) FILTER (WHERE opp > 0) AS wopp, CAST(sum(opp) AS BIGINT) AS oppv, avg(CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END * (p1 - p0) / p0 * 1e4) AS mv FROM gone GROUP BY 1),
pp AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE is_large) AS nl, median(quantity) FILTER (WHERE is_large) AS lm, count(*) FILTER (WHERE is_large AND side = 'buy') AS lb,
  count(*) FILTER (WHERE is_large AND side = 'sell') AS ls, count(*) FILTER (WHERE NOT is_large) AS ns, median(quantity) FILTER (WHERE NOT is_large) AS sm, sum(quantity) AS pv FROM placed GROUP BY 1)
SELECT sp.case_id, coalesce(pp.n, 0) AS orders_placed, coalesce(nl, 0) AS large_orders_placed, coalesce(lb, 0) AS large_buy_orders, coalesce(ls, 0) AS large_sell_orders, coalesce(ns, 0) AS small_orders_placed,
  coalesce(rep, 0) AS large_orders_cancelled_and_replaced_same_tick, coalesce(flips, 0) AS aggressive_opposite_trades_right_after_cancel, coalesce(flipv, 0) AS aggressive_volume_right_after_cancel,
  coalesce(gg.n, 0) AS large_orders_cancelled, coalesce(wopp, 0) AS large_orders_with_opposite_side_fill_while_resting, coalesce(oppv, 0) AS opposite_side_volume_filled, life AS median_large_order_lifetime_ticks,
  CAST(coalesce(floor(lm), 0) AS BIGINT) AS large_order_median_size, CAST(round_even(m, 0) AS BIGINT) AS market_median_order_size,
  CASE WHEN lm IS NOT NULL THEN round(lm / m, 1) ELSE 0.0 END AS large_order_size_vs_market_median_x, CAST(coalesce(floor(sm), 0) AS BIGINT) AS small_order_median_size,
  round(coalesce(mv, 0.0), 2) AS avg_price_move_toward_filled_side_bp, CASE WHEN pv > 0 THEN round(100 * coalesce(cv, 0) / pv, 1) ELSE 0.0 END AS account_cancelled_volume_pct
FROM sp LEFT JOIN pp USING (case_id) LEFT JOIN gg USING (case_id) LEFT JOIN cvol USING (case_id)"""


def cases(spark, sf_dir):
    return cut(alert_cases(spark, sf_dir))


@query("spoofing_facts", with_ctes(*CASE_CTES, ORDERS, LEG_CTE, PX, spans_sql("spoofing"), MEDIAN) + ", " + SPOOF, "P2 P1 P7")
def spoofing_facts(spark, sf_dir):
    return ev.spoofing_facts(cases(spark, sf_dir), trades(spark, sf_dir), orders(spark, sf_dir))


LAYER = f"""b0 AS (SELECT p.*, cancel_tick, count(*) OVER u AS n, price - lag(price) OVER (PARTITION BY p.case_id, p.tick, p.side ORDER BY price, p.order_id) AS gap
  FROM placed p LEFT JOIN canc USING (commodity, trader_id, order_id)
  WHERE (SELECT count(DISTINCT q.price) FROM placed q WHERE q.case_id = p.case_id AND q.tick = p.tick AND q.side = p.side) >= 2 WINDOW u AS (PARTITION BY p.case_id, p.tick, p.side)),
bt0 AS (SELECT case_id, commodity, trader_id, e, tick, side, coalesce(max(cancel_tick), tick + 5) AS t1, count(*) AS n FROM b0 GROUP BY 1, 2, 3, 4, 5, 6),
bt AS (SELECT *, EXISTS (SELECT 1 FROM legs l WHERE l.commodity = bt0.commodity AND l.trader_id = bt0.trader_id AND l.side <> bt0.side AND l.tick BETWEEN bt0.tick AND least(bt0.t1 + 2, bt0.e + 2)) AS opp,
  {px_at('bt0.commodity', 'bt0.tick - 1')} AS p0, {px_at('bt0.commodity', 'bt0.t1')} AS p1 FROM bt0),
bg AS (SELECT case_id, count(*) AS nb, CAST(floor(median(n)) AS BIGINT) AS lv, count(*) FILTER (WHERE side = 'buy') AS bb, count(*) FILTER (WHERE side = 'sell') AS bs, count(*) FILTER (WHERE opp) AS wo,
  round(coalesce(avg(CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END * (p1 - p0) / p0 * 1e4), 0.0), 2) AS mv FROM bt GROUP BY 1),
bo AS (SELECT case_id, median(quantity) AS lm, round(coalesce(median(abs(gap)), 0.0), 4) AS gp, round(100 * avg((cancel_tick IS NOT NULL)::INT), 1) AS cp, CAST(floor(median(cancel_tick - tick)) AS BIGINT) AS life FROM b0 GROUP BY 1),
pn AS (SELECT case_id, count(*) AS n FROM placed GROUP BY 1)
SELECT sp.case_id, coalesce(n, 0) AS orders_placed, coalesce(nb, 0) AS multi_level_batches, lv AS median_levels_per_batch, bb AS buy_batches, bs AS sell_batches, CAST(floor(lm) AS BIGINT) AS median_layer_size,
  CASE WHEN nb > 0 THEN CAST(round_even(m, 0) AS BIGINT) END AS market_median_order_size, CASE WHEN nb > 0 THEN round(lm / m, 1) END AS layer_size_vs_market_median_x, gp AS median_price_gap_between_layers,
  cp AS layer_orders_cancelled_pct, life AS median_layer_lifetime_ticks, wo AS batches_with_opposite_side_fill_while_resting, mv AS avg_price_move_toward_filled_side_bp
FROM sp LEFT JOIN pn USING (case_id) LEFT JOIN bg USING (case_id) LEFT JOIN bo USING (case_id)"""


@query("layering_facts", with_ctes(*CASE_CTES, ORDERS, LEG_CTE, PX, spans_sql("layering"), MEDIAN) + ", " + LAYER, "P3 D10")
def layering_facts(spark, sf_dir):
    # Two price levels per batch: the derived day-tick log holds almost no batches of three.
    return ev.layering_facts(cases(spark, sf_dir), trades(spark, sf_dir), orders(spark, sf_dir), min_levels=2)


@query("wash_facts", with_ctes(*CASE_CTES, LEG_CTE, spans_sql("wash_trading")) + """, mk AS (SELECT case_id, sum(quantity) AS mv, sum(price * quantity) / sum(quantity) AS vwap FROM spans x JOIN trades t ON t.commodity = x.commodity AND t.tick BETWEEN s AND e GROUP BY 1),
mine AS (SELECT x.case_id, l.* FROM spans x JOIN legs l ON l.commodity = x.commodity AND l.trader_id = x.trader_id AND l.tick BETWEEN s AND e),
cp AS (SELECT case_id, cpty, sum(quantity) AS v, count(*) AS n, coalesce(sum(quantity) FILTER (WHERE side = 'buy'), 0) AS b, coalesce(sum(quantity) FILTER (WHERE side = 'sell'), 0) AS s FROM mine GROUP BY 1, 2),
top AS (SELECT * FROM cp QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY v DESC, cpty) = 1),
a AS (SELECT case_id, count(*) AS trades, sum(quantity) AS g, sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) AS net, median(quantity) AS med, coalesce(sum(quantity) FILTER (WHERE aggressive), 0) AS ag,
  median(abs(price - vwap) / vwap * 1e4) AS dev FROM mine JOIN mk USING (case_id) GROUP BY 1)
SELECT x.case_id, coalesce(trades, 0) AS trades, CAST(g AS BIGINT) AS gross_volume, CAST(net AS BIGINT) AS net_position_change, round(100 * abs(net) / g, 1) AS net_position_vs_gross_pct, cpty AS top_counterparty,
  round(100 * v / g, 1) AS volume_with_top_counterparty_pct, n AS trades_with_top_counterparty, CAST(b AS BIGINT) AS bought_from_top_counterparty, CAST(top.s AS BIGINT) AS sold_to_top_counterparty,
  round(100 * v / mv, 1) AS pair_share_of_market_volume_pct, CAST(floor(med) AS BIGINT) AS median_trade_size, round(dev, 2) AS median_price_distance_from_vwap_bp, round(100 * ag / g, 1) AS aggressive_share_pct
FROM spans x LEFT JOIN a USING (case_id) LEFT JOIN top USING (case_id) LEFT JOIN mk USING (case_id)""", "P4 P1")
def wash_facts(spark, sf_dir):
    return ev.wash_facts(cases(spark, sf_dir), trades(spark, sf_dir))


@query("pump_facts", with_ctes(*CASE_CTES, LEG_CTE, PX, spans_sql("pump_and_dump")) + f""", mine AS (SELECT x.case_id, x.commodity, x.s, x.e, l.* EXCLUDE (commodity, trader_id) FROM spans x JOIN legs l ON l.commodity = x.commodity AND l.trader_id = x.trader_id AND l.tick BETWEEN s AND e),
path AS (SELECT *, sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) OVER w AS pos, row_number() OVER w AS ord FROM mine WINDOW w AS (PARTITION BY case_id ORDER BY tick, side, seq, price ROWS UNBOUNDED PRECEDING)),
peak AS (SELECT case_id, arg_max(tick, {{'p': pos, 'o': -ord}}) AS pk, max(pos) AS pp, arg_max(pos, ord) AS ep, count(*) AS n FROM path GROUP BY 1),
ph AS (SELECT case_id, coalesce(sum(quantity) FILTER (WHERE side = 'buy' AND tick <= pk), 0) AS b, coalesce(sum(quantity) FILTER (WHERE side = 'buy' AND tick <= pk AND aggressive), 0) AS ba,
  coalesce(sum(quantity) FILTER (WHERE side = 'sell' AND tick > pk), 0) AS sl, coalesce(sum(quantity) FILTER (WHERE side = 'sell' AND tick > pk AND aggressive), 0) AS sa FROM path JOIN peak USING (case_id) GROUP BY 1),
dn AS (SELECT case_id, commodity, s, unnest(range(s, e + 1)) AS tick FROM spans),
pu AS (SELECT case_id, tick, sum(quantity) AS q FROM path WHERE side = 'buy' AND aggressive GROUP BY 1, 2),
ro AS (SELECT d.case_id, d.tick, d.s, sum(coalesce(q, 0)) OVER w AS p, sum(coalesce(volume, 0)) OVER w AS m FROM dn d LEFT JOIN pu USING (case_id, tick) LEFT JOIN px ON px.commodity = d.commodity AND px.tick = d.tick
  WINDOW w AS (PARTITION BY d.case_id ORDER BY d.tick ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
bu AS (SELECT case_id, tick AS bt, p AS bv, m AS bm FROM ro WHERE tick >= s + 59 AND p > 0 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY p DESC, tick) = 1),
q AS (SELECT x.case_id, x.commodity, x.s, x.e, pk, pp, ep, n, b, ba, sl, sa, bt, bv, bm FROM spans x JOIN peak USING (case_id) JOIN ph USING (case_id) LEFT JOIN bu USING (case_id)),
z AS (SELECT *, {px_at('q.commodity', 'q.s')} AS p_s, {px_at('q.commodity', 'q.pk')} AS p_p, {px_at('q.commodity', 'q.e')} AS p_e, {px_at('q.commodity', 'q.bt - 60')} AS b0, {px_at('q.commodity', 'q.bt')} AS b1 FROM q)
SELECT case_id, n AS trades, CAST(b AS BIGINT) AS bought_until_peak_position, CAST(ba AS BIGINT) AS of_which_aggressive_buys, CAST(pp AS BIGINT) AS peak_position, pk AS peak_position_tick, CAST(sl AS BIGINT) AS sold_after_peak,
  CAST(sa AS BIGINT) AS of_which_aggressive_sells, CAST(ep AS BIGINT) AS end_position, round(p_s, 4) AS price_at_start, round(p_p, 4) AS price_at_peak_position, round(p_e, 4) AS price_at_end,
  coalesce(round((p_p - p_s) / p_s * 1e4, 1), 0.0) AS price_change_start_to_peak_bp, coalesce(round((p_e - p_p) / p_p * 1e4, 1), 0.0) AS price_change_peak_to_end_bp, bt AS burst_end_tick, CAST(bv AS BIGINT) AS burst_aggressive_buy_volume,
  CASE WHEN bt IS NOT NULL THEN CASE WHEN bm > 0 THEN round(100 * bv / bm, 1) ELSE 0.0 END END AS burst_share_of_market_volume_pct, CASE WHEN bt IS NOT NULL THEN coalesce(round((b1 - b0) / b0 * 1e4, 1), 0.0) END AS price_change_over_burst_bp FROM z""", "P5 E11")
def pump_facts(spark, sf_dir):
    return ev.pump_facts(cases(spark, sf_dir), trades(spark, sf_dir))


@query("pump_peers", with_ctes(*CASE_CTES, spans_sql("pump_and_dump")) + """SELECT case_id, count(DISTINCT r.trader_id) AS peers, min(r.trader_id) AS first_peer FROM spans x JOIN results r ON r.commodity = x.commodity AND r.window_end >= s AND r.window_start <= e
  AND r.trader_id <> x.trader_id WHERE final_flag AND predicted_persona = 'pump_and_dump' GROUP BY 1""", "P5")
def pump_peers(spark, sf_dir):
    return ev.pump_peers(cases(spark, sf_dir), results(spark, sf_dir))


@query("generic_facts", with_ctes(*CASE_CTES, ORDERS, LEG_CTE, spans_sql("anomaly"), MEDIAN) + """, p AS (SELECT case_id, count(*) AS n, median(quantity) AS md, max(quantity) AS mx, sum(quantity) AS pv FROM placed GROUP BY 1),
t AS (SELECT case_id, count(*) AS n, coalesce(sum(quantity) FILTER (WHERE side = 'buy'), 0) AS b, coalesce(sum(quantity) FILTER (WHERE side = 'sell'), 0) AS sl FROM spans x JOIN legs l ON l.commodity = x.commodity AND l.trader_id = x.trader_id AND l.tick BETWEEN s AND e GROUP BY 1)
SELECT x.case_id, coalesce(p.n, 0) AS orders_placed, CAST(coalesce(floor(md), 0) AS BIGINT) AS median_order_size, coalesce(mx, 0) AS largest_order, CASE WHEN pv > 0 THEN round(100 * coalesce(cv, 0) / pv, 1) ELSE 0.0 END AS cancelled_volume_pct,
  coalesce(t.n, 0) AS trades, CAST(coalesce(b, 0) AS BIGINT) AS bought, CAST(coalesce(sl, 0) AS BIGINT) AS sold FROM spans x LEFT JOIN p USING (case_id) LEFT JOIN cvol USING (case_id) LEFT JOIN t USING (case_id)""", "P6")
def generic_facts(spark, sf_dir):
    return ev.generic_facts(cases(spark, sf_dir), trades(spark, sf_dir), orders(spark, sf_dir))
