"""Effect-measurement queries."""

from pyspark.sql import functions as F

from pitwarden.operators import effect as ef
from pitwarden.operators.lineage import cut
from pitwarden.plans.detection import EPI, HITS, LONG_CTES, ROWS, round_metrics
from pitwarden.plans.labelling import episodes
from pitwarden.plans.registry import query
from pitwarden.plans.shaping import half_up, r, rounded
from pitwarden.plans.sql import EPISODES, LAST_PRICE, ORDERS, TRADES, with_ctes
from pitwarden.sources import derived

PX = f"""px AS (SELECT commodity, tick, {LAST_PRICE} AS price, sum(quantity) AS volume FROM trades GROUP BY 1, 2),
ends AS (SELECT commodity, max(tick) AS last_tick, arg_max(price, tick) AS last_price FROM px GROUP BY 1)"""


def px_at(com: str, tick: str) -> str:
    return (f"(SELECT arg_max(p.price, p.tick) FROM px p WHERE p.commodity = {com} AND p.tick <= {tick} "
            f"AND {tick} <= (SELECT last_tick FROM ends n WHERE n.commodity = {com}))")


def trades(spark, sf_dir):
    return derived.staged(spark, sf_dir, "trade_log")


def orders(spark, sf_dir):
    return derived.staged(spark, sf_dir, "order_log")


SPOOF = f"""mine AS (
  SELECT e.event_id, e.commodity, o.order_id, o.side, o.quantity, o.tick, CASE WHEN right(o.order_id, 1) = 'g' THEN 'genuine' ELSE 'bait' END AS leg
  FROM episode_accounts e JOIN order_events o ON o.commodity = e.commodity AND o.trader_id = e.trader_id AND o.tick BETWEEN e.start_tick AND e.end_tick
  WHERE o.event_type = 'placed' AND e.persona IN ('spoofing', 'layering')
    AND (right(o.order_id, 1) = 'g' OR right(o.order_id, 1) = CASE WHEN persona = 'spoofing' THEN 's' ELSE 'l' END)),
done AS (SELECT commodity, order_id, max(tick) FILTER (WHERE event_type = 'cancelled') AS cancel_tick,
  sum(quantity) FILTER (WHERE event_type = 'filled') AS filled FROM order_events WHERE event_type <> 'placed' GROUP BY 1, 2),
cyc AS (SELECT event_id, m.commodity, tick, arg_min(side, order_id) AS side, coalesce(max(cancel_tick), tick + 5) AS t_end
  FROM mine m LEFT JOIN done USING (commodity, order_id) WHERE leg = 'bait' GROUP BY 1, 2, 3),
cyp AS (SELECT *, {px_at('cyc.commodity', 'cyc.tick - 1')} AS p0, {px_at('cyc.commodity', 'cyc.t_end')} AS p1 FROM cyc),
percyc AS (SELECT event_id, avg(CASE WHEN p0 > 0 THEN CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END * (p1 - p0) / p0 * 1e4 END) AS m, count(*) AS n FROM cyp GROUP BY 1),
gen AS (SELECT event_id, sum(quantity) AS g, sum(filled) AS f FROM mine LEFT JOIN done USING (commodity, order_id) WHERE leg = 'genuine' GROUP BY 1),
spoof_fx AS (SELECT e.event_id, e.persona, fake_depth AS fake_depth_share, coalesce(m, 0.0) AS favorable_move_bp,
  CASE WHEN n > 0 AND g > 0 THEN least(1.0, coalesce(f, 0) / g) ELSE 0.0 END AS genuine_fill_rate, coalesce(n, 0) AS spoof_cycles
  FROM episodes e LEFT JOIN percyc USING (event_id) LEFT JOIN gen USING (event_id) WHERE e.persona IN ('spoofing', 'layering'))"""


@query("spoof_effects", with_ctes(TRADES, ORDERS, EPISODES, PX, SPOOF) + "SELECT event_id, persona, round(fake_depth_share, 4) AS fake_depth_share, round(favorable_move_bp, 4) AS favorable_move_bp, round(genuine_fill_rate, 4) AS genuine_fill_rate, spoof_cycles FROM spoof_fx", "O1 C13")
def spoof_effects(spark, sf_dir):
    return ef.spoof_effects(episodes(spark, sf_dir), orders(spark, sf_dir), cut(ef.tick_prices(trades(spark, sf_dir))))


WASH = """wash_fx AS (SELECT e.event_id, e.persona, round(coalesce(sum(quantity) FILTER (WHERE list_contains(trader_ids, buyer_trader_id) AND list_contains(trader_ids, seller_trader_id)), 0)
    / sum(quantity), 4) AS wash_volume_share,
  CAST(coalesce(sum(quantity) FILTER (WHERE list_contains(trader_ids, buyer_trader_id) AND list_contains(trader_ids, seller_trader_id)), 0) AS BIGINT) AS wash_volume
  FROM episodes e JOIN trades t ON t.commodity = e.commodity AND t.tick BETWEEN e.start_tick AND e.end_tick WHERE e.persona = 'wash_trading' GROUP BY 1, 2)"""


@query("wash_effects", with_ctes(TRADES, EPISODES, WASH) + "SELECT * FROM wash_fx", "O2")
def wash_effects(spark, sf_dir):
    t = trades(spark, sf_dir)
    return ef.wash_effects(episodes(spark, sf_dir), t, cut(ef.tick_prices(t)))


PUMP = f"""pumps AS (SELECT * FROM episodes WHERE persona = 'pump_and_dump'),
pt AS (SELECT e.event_id, e.start_tick, e.end_tick, t.*, list_contains(trader_ids, buyer_trader_id) AS b, list_contains(trader_ids, seller_trader_id) AS s
  FROM pumps e JOIN trades t ON t.commodity = e.commodity AND t.tick BETWEEN e.start_tick AND e.end_tick),
ptick AS (SELECT event_id, tick, sum(quantity) AS vol, coalesce(sum(quantity) FILTER (WHERE b AND aggressor_side = 'buy'), 0) AS push FROM pt GROUP BY 1, 2),
pdense AS (SELECT event_id, unnest(range(start_tick, end_tick + 1)) AS tick FROM pumps),
proll AS (SELECT d.event_id, row_number() OVER (PARTITION BY d.event_id ORDER BY d.tick) AS rn, sum(coalesce(push, 0)) OVER w AS p, sum(coalesce(vol, 0)) OVER w AS m
  FROM pdense d LEFT JOIN ptick USING (event_id, tick) WINDOW w AS (PARTITION BY d.event_id ORDER BY d.tick ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
press AS (SELECT event_id, max(CASE WHEN rn >= 60 AND m > 0 THEN p / m END) AS pressure FROM proll GROUP BY 1),
pown AS (SELECT event_id, min(tick) FILTER (WHERE b AND aggressor_side = 'buy') AS t0, max(tick) FILTER (WHERE b AND aggressor_side = 'buy') AS t1,
  coalesce(sum(quantity) FILTER (WHERE b), 0) AS bq, coalesce(sum(quantity) FILTER (WHERE s), 0) AS sq,
  coalesce(sum(price * quantity) FILTER (WHERE b), 0) AS bn, coalesce(sum(price * quantity) FILTER (WHERE s), 0) AS sn FROM pt GROUP BY 1),
pq AS (SELECT e.event_id, e.persona, e.commodity, o.*EXCLUDE (event_id), pressure, last_price, least(t1 + 5, last_tick) AS z, least(end_tick, last_tick) AS en
  FROM pumps e JOIN ends USING (commodity) LEFT JOIN pown o ON o.event_id = e.event_id LEFT JOIN press r ON r.event_id = e.event_id),
pp AS (SELECT *, {px_at('pq.commodity', 'pq.t0 - 1')} AS p0, {px_at('pq.commodity', 'pq.z')} AS p1, {px_at('pq.commodity', 'pq.en')} AS mark FROM pq),
pump_fx AS (SELECT event_id, persona, CASE WHEN t0 IS NOT NULL THEN coalesce(pressure, 0.0) ELSE 0.0 END AS ignition_pressure,
  coalesce(CASE WHEN p0 > 0 THEN (p1 - p0) / p0 * 1e4 END, 0.0) AS price_lift_bp,
  CASE WHEN bn > 0 THEN (sn - bn + (bq - sq) * coalesce(mark, last_price)) / bn * 1e4 ELSE 0.0 END AS pnl_bp FROM pp)"""


@query("pump_effects", with_ctes(TRADES, EPISODES, PX, PUMP) + "SELECT event_id, persona, round(ignition_pressure, 4) AS ignition_pressure, round(price_lift_bp, 3) AS price_lift_bp, round(pnl_bp, 3) AS pnl_bp FROM pump_fx", "O3")
def pump_effects(spark, sf_dir):
    t = trades(spark, sf_dir)
    return ef.pump_effects(episodes(spark, sf_dir), t, cut(ef.tick_prices(t)))


ALL_FX = """fx AS (
  SELECT event_id, persona, round(fake_depth_share, 4) AS fake_depth_share, round(favorable_move_bp, 4) AS favorable_move_bp, round(genuine_fill_rate, 4) AS genuine_fill_rate,
    spoof_cycles, NULL::DOUBLE AS wash_volume_share, NULL::BIGINT AS wash_volume, NULL::DOUBLE AS ignition_pressure, NULL::DOUBLE AS price_lift_bp, NULL::DOUBLE AS pnl_bp FROM spoof_fx
  UNION ALL SELECT event_id, persona, NULL, NULL, NULL, NULL, wash_volume_share, wash_volume, NULL, NULL, NULL FROM wash_fx
  UNION ALL SELECT event_id, persona, NULL, NULL, NULL, NULL, NULL, NULL, round(ignition_pressure, 4), round(price_lift_bp, 3), round(pnl_bp, 3) FROM pump_fx)"""
FX_CTES = [TRADES, ORDERS, EPISODES, PX, SPOOF, WASH, PUMP, ALL_FX]


def effects(spark, sf_dir):
    return ef.episode_effects(episodes(spark, sf_dir), trades(spark, sf_dir), orders(spark, sf_dir))


@query("episode_effects", with_ctes(*FX_CTES) + "SELECT * FROM fx", "O4")
def episode_effects(spark, sf_dir):
    return effects(spark, sf_dir)


@query("effect_summary", with_ctes(*FX_CTES) + "SELECT persona, " + ", ".join(f"{r(f'median({m})', 4)} AS {m}" for m in ef.MEASURES)
       + """, count(*) AS episodes, CASE persona WHEN 'wash_trading' THEN 'wash_volume_share' WHEN 'pump_and_dump' THEN 'ignition_pressure' ELSE 'fake_depth_share' END AS primary_metric
  FROM fx GROUP BY 1""", "O4")
def effect_summary(spark, sf_dir):
    return ef.effect_summary(effects(spark, sf_dir))


PNL = f"""sess AS (
  SELECT e.event_id, e.persona, coalesce(sum(CASE WHEN list_contains(trader_ids, seller_trader_id) THEN 1 ELSE -1 END * price * quantity), 0) AS cash,
    coalesce(sum(CASE WHEN list_contains(trader_ids, buyer_trader_id) THEN 1 ELSE -1 END * quantity), 0) AS inv, coalesce(sum(price * quantity), 0) AS gross
  FROM episodes e LEFT JOIN trades t ON t.commodity = e.commodity AND list_contains(trader_ids, buyer_trader_id) <> list_contains(trader_ids, seller_trader_id) GROUP BY 1, 2),
pnl AS (SELECT s.event_id, s.persona, e.commodity, CASE WHEN gross > 0 THEN (cash + inv * last) / gross * 1e4 ELSE 0.0 END AS pnl_bp, cash + inv * last > 0 AS profitable
  FROM sess s JOIN episodes e USING (event_id) JOIN (SELECT commodity, {LAST_PRICE} AS last FROM trades GROUP BY 1) USING (commodity))"""


@query("account_pnl", with_ctes(TRADES, EPISODES, PNL) + f"SELECT event_id, persona, {r('pnl_bp', 4)} AS pnl_bp, profitable FROM pnl", "O5")
def account_pnl(spark, sf_dir):
    return rounded(ef.account_pnl(episodes(spark, sf_dir), trades(spark, sf_dir)), 4)


@query("pnl_summary", with_ctes(TRADES, EPISODES, PNL) + """SELECT persona, round(median(pnl_bp), 2) AS pnl_bp_median, round(avg(profitable::INT), 3) AS profitable_share, count(*) AS episodes FROM pnl GROUP BY 1""", "O5")
def pnl_summary(spark, sf_dir):
    return ef.pnl_summary(ef.account_pnl(episodes(spark, sf_dir), trades(spark, sf_dir)))


@query("merged_pnl", with_ctes(TRADES, EPISODES, PNL) + """, parts AS (SELECT commodity, persona, round(median(pnl_bp), 2) AS m, round(avg(profitable::INT), 3) AS s, count(*) AS n FROM pnl GROUP BY 1, 2),
rep AS (SELECT persona, m, s, unnest(range(n)) AS i FROM parts)
SELECT persona, round(quantile_cont(m, 0.5), 2) AS pnl_bp_median, round(avg(s), 3) AS profitable_share, count(*) AS episodes FROM rep GROUP BY 1""", "D11 O5")
def merged_pnl(spark, sf_dir):
    ev = episodes(spark, sf_dir)
    pnl = ef.account_pnl(ev, trades(spark, sf_dir)).join(ev.select("event_id", "commodity"), "event_id")
    parts = pnl.groupBy("commodity", "persona").agg(
        F.round(F.median("pnl_bp"), 2).alias("pnl_bp_median"), F.round(F.avg(F.col("profitable").cast("double")), 3).alias("profitable_share"), F.count(F.lit(1)).alias("episodes")
    )
    return ef.merge_pnl(parts)


EVASION = """SELECT persona, coverage, missed, delay, CASE WHEN ratio < 0.5 THEN 0.0 ELSE round((0.5::DOUBLE * coverage + 0.3::DOUBLE * missed + 0.2::DOUBLE * delay) * least(1.0, ratio), 4) END AS mutation_score FROM (
  SELECT persona, (support % 10 + 3) / 10.0::DOUBLE AS ratio, round(1.0 - caught_coverage, 4) AS coverage,
    round(greatest((events_total - caught_events_detected) / events_total, caught_weak_share), 4) AS missed, round(least(1.0, caught_latency_ticks / 300), 4) AS delay
  FROM rowm JOIN epi USING (persona))"""


@query("evasion_scores", with_ctes(*LONG_CTES, ROWS, HITS, EPI) + EVASION, "O6 O7")
def evasion_scores(spark, sf_dir):
    m = round_metrics(spark, sf_dir).withColumn("effect_ratio", (F.col("support") % 10 + 3) / F.lit(10.0))
    return ef.evasion(m).select("persona", "coverage", "missed", "delay", "mutation_score")
