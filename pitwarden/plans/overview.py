"""Market overview queries."""

from pyspark.sql import functions as F

from pitwarden.config import PERSONAS
from pitwarden.operators import overview as ov
from pitwarden.plans.alerts import RESULT_CTES, results
from pitwarden.plans.effects import orders, trades
from pitwarden.plans.labelling import episodes
from pitwarden.plans.registry import query
from pitwarden.plans.shaping import r, rounded
from pitwarden.plans.sql import EPISODES, FIRST_PRICE, LAST_PRICE, ORDERS, TRADES, with_ctes

LEGS = "legs AS (SELECT commodity, tick, quantity, buyer_trader_id AS trader_id, seller_trader_id AS cpty, 'buy' AS side FROM trades UNION ALL SELECT commodity, tick, quantity, seller_trader_id, buyer_trader_id, 'sell' FROM trades)"
KPI = """kpi AS (SELECT t.commodity, trades, volume, traders, coalesce(events, 0) AS events FROM (SELECT commodity, count(*) AS trades, CAST(sum(quantity) AS BIGINT) AS volume FROM trades GROUP BY 1) t
  JOIN (SELECT commodity, count(DISTINCT trader_id) AS traders FROM legs GROUP BY 1) USING (commodity)
  LEFT JOIN (SELECT commodity, count(*) AS events FROM episodes GROUP BY 1) USING (commodity))"""


@query("market_kpi", with_ctes(TRADES, EPISODES, LEGS, KPI) + "SELECT * FROM kpi", "R1 D9 D4")
def market_kpi(spark, sf_dir):
    return ov.market_kpi(trades(spark, sf_dir), episodes(spark, sf_dir))


BUCKETS = f"""lb AS (SELECT commodity, tick // 50 AS b, {LAST_PRICE} AS price FROM trades GROUP BY 1, 2),
lf AS (SELECT c.commodity, g.b, last_value(price IGNORE NULLS) OVER (PARTITION BY c.commodity ORDER BY g.b) AS price
  FROM (SELECT DISTINCT b FROM lb) g CROSS JOIN (SELECT DISTINCT commodity FROM lb) c LEFT JOIN lb ON lb.commodity = c.commodity AND lb.b = g.b),
buckets AS (SELECT commodity, b * 50 AS bucket, first_value(price IGNORE NULLS) OVER (PARTITION BY commodity ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price FROM lf)"""


@query("price_index", with_ctes(TRADES, BUCKETS) + f"SELECT commodity, bucket, price, {r('price / first_value(price) OVER (PARTITION BY commodity ORDER BY bucket) * 100', 4)} AS index FROM buckets", "R2 E6")
def price_index(spark, sf_dir):
    return rounded(ov.price_index(trades(spark, sf_dir)), 4)


@query("market_snapshot", with_ctes(TRADES, EPISODES, LEGS, KPI, BUCKETS) + f"SELECT commodity, first, last, trades, volume, events, {r('(last / first - 1) * 100', 4)} AS pct FROM (SELECT commodity, arg_min(price, bucket) AS first, arg_max(price, bucket) AS last FROM buckets GROUP BY 1) JOIN kpi USING (commodity)", "R3")
def market_snapshot(spark, sf_dir):
    return rounded(ov.snapshot(trades(spark, sf_dir), episodes(spark, sf_dir)), 4)


@query("return_correlation", with_ctes(TRADES, BUCKETS) + f""", rr AS (SELECT commodity, bucket, price / lag(price) OVER (PARTITION BY commodity ORDER BY bucket) - 1 AS ret FROM buckets)
SELECT x.commodity AS a, y.commodity AS b, {r('coalesce(corr(x.ret, y.ret), 0)', 5)} AS corr FROM rr x JOIN rr y USING (bucket) WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2""", "R4 D6")
def return_correlation(spark, sf_dir):
    return rounded(ov.return_correlation(trades(spark, sf_dir)), 5)


@query("events_by_persona", with_ctes(EPISODES) + "SELECT commodity, " + ", ".join(f"count(*) FILTER (WHERE persona = '{p}') AS {p}" for p in PERSONAS) + " FROM episodes GROUP BY 1", "R5 D5")
def events_by_persona(spark, sf_dir):
    return ov.events_by_persona(episodes(spark, sf_dir))


@query("event_list", with_ctes(EPISODES) + "SELECT event_id, persona, commodity, start_tick, end_tick, array_to_string(trader_ids, ',') AS accounts FROM episodes", "R13")
def event_list(spark, sf_dir):
    return ov.event_list(episodes(spark, sf_dir)).withColumn("accounts", F.array_join("trader_ids", ",")).drop("trader_ids")


@query("flow_per_bucket", with_ctes(TRADES, ORDERS) + f"""SELECT commodity, b * 60 AS tick, buy, sell, trades, coalesce(placed, 0) AS placed, coalesce(cancelled, 0) AS cancelled,
  {r('CASE WHEN buy + sell > 0 THEN (buy - sell) / (buy + sell) ELSE 0 END')} AS imbalance,
  {r('CASE WHEN coalesce(placed, 0) + coalesce(cancelled, 0) > 0 THEN cancelled / (placed + cancelled) ELSE 0 END')} AS cancel_rate, {r('coalesce(placed, 0) / trades')} AS otr
FROM (SELECT commodity, tick // 60 AS b, CAST(coalesce(sum(quantity) FILTER (WHERE aggressor_side = 'buy'), 0) AS BIGINT) AS buy,
  CAST(coalesce(sum(quantity) FILTER (WHERE aggressor_side = 'sell'), 0) AS BIGINT) AS sell, count(*) AS trades FROM trades GROUP BY 1, 2)
LEFT JOIN (SELECT commodity, tick // 60 AS b, count(*) FILTER (WHERE event_type = 'placed') AS placed, count(*) FILTER (WHERE event_type = 'cancelled') AS cancelled
  FROM order_events GROUP BY 1, 2) USING (commodity, b)""", "R6")
def flow_per_bucket(spark, sf_dir):
    return rounded(ov.flow(trades(spark, sf_dir), orders(spark, sf_dir)))


@query("order_activity", with_ctes(ORDERS) + f"""SELECT commodity, tick // 300 * 300 AS tick, count(*) FILTER (WHERE event_type = 'placed') AS submits, count(*) FILTER (WHERE event_type = 'cancelled') AS cancels,
  {r("CASE WHEN count(*) FILTER (WHERE event_type IN ('placed', 'cancelled')) > 0 THEN count(*) FILTER (WHERE event_type = 'cancelled') / count(*) FILTER (WHERE event_type IN ('placed', 'cancelled')) ELSE 0 END")} AS cancel_rate
  FROM order_events GROUP BY commodity, tick // 300""", "R7 A6")
def order_activity(spark, sf_dir):
    return rounded(ov.order_activity(orders(spark, sf_dir)))


@query("volume_profile", with_ctes(TRADES) + """, s AS (SELECT commodity, min(price) AS lo, max(price) AS hi FROM trades GROUP BY 1),
v AS (SELECT commodity, CAST(least(greatest(ceil((price - lo) / ((hi - lo) / 40)), 1), 40) AS INTEGER) AS bin, sum(quantity) AS volume FROM trades JOIN s USING (commodity) GROUP BY 1, 2)
SELECT s.commodity, CAST(g.bin AS INTEGER) AS bin, CAST(coalesce(volume, 0) AS BIGINT) AS volume FROM s CROSS JOIN range(1, 41) g(bin) LEFT JOIN v ON v.commodity = s.commodity AND v.bin = g.bin""", "R8")
def volume_profile(spark, sf_dir):
    return ov.volume_profile(trades(spark, sf_dir))


RETS = f"""f0 AS (SELECT commodity, min(tick) AS t0, max(tick) AS t1 FROM trades GROUP BY 1),
sg AS (SELECT commodity, t0, unnest(range(0, (t1 - t0) // 30 + 1)) AS i FROM f0),
sp AS (SELECT commodity, CAST(ceil((tick - t0) / 30) AS BIGINT) AS i, {LAST_PRICE} AS price FROM trades JOIN f0 USING (commodity) GROUP BY 1, 2),
path AS (SELECT g.commodity, g.i, last_value(price IGNORE NULLS) OVER (PARTITION BY g.commodity ORDER BY g.i) AS price FROM sg g LEFT JOIN sp USING (commodity, i)),
rets AS (SELECT * FROM (SELECT commodity, i, (ln(price) - ln(lag(price) OVER (PARTITION BY commodity ORDER BY i))) * 1e4 AS ret FROM path) WHERE ret IS NOT NULL)"""


@query("return_moments", with_ctes(TRADES, RETS) + f"""SELECT commodity, n, {r('mu', 4)} AS mean, {r('sd', 4)} AS std, {r('m4 / pow(sd, 4) - 3', 5)} AS excess_kurtosis FROM (
  SELECT commodity, any_value(n) AS n, any_value(mu) AS mu, any_value(sd) AS sd, avg(pow(ret - mu, 4)) AS m4 FROM rets
  JOIN (SELECT commodity, count(*) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd FROM rets GROUP BY 1) USING (commodity) GROUP BY 1)""", "R9 D6")
def return_moments(spark, sf_dir):
    from pitwarden.plans.shaping import half_up

    m = ov.return_moments(trades(spark, sf_dir))
    return m.select("commodity", "n", half_up(F.col("mean"), 4).alias("mean"), half_up(F.col("std"), 4).alias("std"), half_up(F.col("excess_kurtosis"), 5).alias("excess_kurtosis"))


@query("return_distribution", with_ctes(TRADES, RETS) + f""", s AS (SELECT commodity, count(*) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd, quantile_cont(ret, 0.005) AS lo, quantile_cont(ret, 0.995) AS hi FROM rets GROUP BY 1 HAVING count(*) > 20),
c AS (SELECT commodity, least(CAST(floor((least(greatest(ret, lo), hi) - lo) / ((hi - lo) / 40)) AS INTEGER), 39) AS bin, count(*) AS c FROM rets JOIN s USING (commodity) GROUP BY 1, 2),
g AS (SELECT *, lo + (bin + 0.5::DOUBLE) * ((hi - lo) / 40) AS centre FROM s, (SELECT CAST(unnest(range(40)) AS INTEGER) AS bin))
SELECT g.commodity, g.bin, {r('centre', 3)} AS centre, {r('coalesce(c, 0) / (n * ((hi - lo) / 40))', 8)} AS density,
  {r('exp(-0.5::DOUBLE * ((centre - mu) / sd) * ((centre - mu) / sd)) / (sd * sqrt(2 * pi()))', 8)} AS normal FROM g LEFT JOIN c ON c.commodity = g.commodity AND c.bin = g.bin""", "R9 D3")
def return_distribution(spark, sf_dir):
    from pitwarden.plans.shaping import half_up

    d = ov.return_distribution(trades(spark, sf_dir))
    return d.select("commodity", "bin", half_up(F.col("centre"), 3).alias("centre"), half_up(F.col("density"), 8).alias("density"), half_up(F.col("normal"), 8).alias("normal"))


TOP = "top AS (SELECT * FROM (SELECT commodity, trader_id, CAST(sum(quantity) AS BIGINT) AS volume, CAST(row_number() OVER (PARTITION BY commodity ORDER BY sum(quantity) DESC, trader_id) AS INTEGER) AS rank FROM legs GROUP BY 1, 2) WHERE rank <= 20)"


@query("top_accounts", with_ctes(TRADES, LEGS, TOP) + "SELECT * FROM top", "F2 E13")
def top_accounts(spark, sf_dir):
    return ov.top_accounts(trades(spark, sf_dir))


@query("activity_heatmap", with_ctes(TRADES, LEGS, TOP) + """, v AS (SELECT commodity, trader_id, tick // 300 AS b, sum(quantity) AS volume FROM legs GROUP BY 1, 2, 3)
SELECT t.commodity, t.trader_id, g.b * 300 AS bucket, CAST(coalesce(v.volume, 0) AS BIGINT) AS volume FROM top t JOIN (SELECT DISTINCT commodity, b FROM v) g USING (commodity)
LEFT JOIN v ON v.commodity = t.commodity AND v.trader_id = t.trader_id AND v.b = g.b""", "R10 F2")
def activity_heatmap(spark, sf_dir):
    return ov.activity_heatmap(trades(spark, sf_dir))


@query("market_comparison", with_ctes(*RESULT_CTES, EPISODES) + f""", px AS (SELECT commodity, tick // 60 AS b, {LAST_PRICE} AS p FROM trades GROUP BY 1, 2),
vv AS (SELECT commodity, stddev_samp(ret) * 1e4 AS v FROM (SELECT commodity, ln(p) - ln(lag(p) OVER (PARTITION BY commodity ORDER BY b)) AS ret FROM px) GROUP BY 1)
SELECT t.commodity, trades, volume, {r('(last / first - 1) * 100', 4)} AS change_pct, {r('(hi - lo) / lo * 1e4', 4)} AS range_bp, {r('v', 4)} AS volatility_bp, {r('ab / volume', 4)} AS aggressive_buy_share,
  coalesce(episodes, 0) AS episodes, coalesce(alerts, 0) AS alerts
FROM (SELECT commodity, count(*) AS trades, CAST(sum(quantity) AS BIGINT) AS volume, {FIRST_PRICE} AS first, {LAST_PRICE} AS last, max(price) AS hi, min(price) AS lo,
  sum(quantity) FILTER (WHERE aggressor_side = 'buy') AS ab FROM trades GROUP BY 1) t JOIN vv USING (commodity)
LEFT JOIN (SELECT commodity, count(*) AS episodes FROM episodes GROUP BY 1) USING (commodity) LEFT JOIN (SELECT commodity, count(*) AS alerts FROM results WHERE final_flag GROUP BY 1) USING (commodity)""", "R11")
def market_comparison(spark, sf_dir):
    return rounded(ov.compare_markets(trades(spark, sf_dir), episodes(spark, sf_dir), results(spark, sf_dir)), 4)


@query("trader_history", with_ctes(TRADES, ORDERS, LEGS) + """, o AS (SELECT commodity, trader_id, count(*) FILTER (WHERE event_type = 'placed') AS orders, count(*) FILTER (WHERE event_type = 'cancelled') AS cancels FROM order_events GROUP BY 1, 2),
p AS (SELECT commodity, trader_id, cpty, coalesce(sum(quantity) FILTER (WHERE side = 'buy'), 0) AS b, coalesce(sum(quantity) FILTER (WHERE side = 'sell'), 0) AS s, count(*) AS n FROM legs GROUP BY 1, 2, 3),
t AS (SELECT commodity, trader_id, CAST(sum(n) AS BIGINT) AS trades, CAST(sum(b) AS BIGINT) AS bought, CAST(sum(s) AS BIGINT) AS sold, count(*) AS counterparties FROM p GROUP BY 1, 2),
best AS (SELECT commodity, trader_id, string_agg(cpty, ',' ORDER BY r) AS top_counterparties FROM (SELECT *, row_number() OVER (PARTITION BY commodity, trader_id ORDER BY b + s DESC, cpty) AS r FROM p) WHERE r <= 3 GROUP BY 1, 2)
SELECT commodity, trader_id, coalesce(orders, 0) AS orders, coalesce(cancels, 0) AS cancels, coalesce(trades, 0) AS trades, coalesce(bought, 0) AS bought, coalesce(sold, 0) AS sold,
  coalesce(counterparties, 0) AS counterparties, top_counterparties, coalesce(bought, 0) - coalesce(sold, 0) AS net
FROM o FULL JOIN t USING (commodity, trader_id) LEFT JOIN best USING (commodity, trader_id)""", "R12 D4")
def trader_history(spark, sf_dir):
    return ov.trader_history(trades(spark, sf_dir), orders(spark, sf_dir))
