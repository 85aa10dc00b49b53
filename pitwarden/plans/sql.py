"""SQL text of the derived logs (see ``pitwarden.sources.derived``), as named CTEs."""

PLACE = """place AS (
  SELECT s_suppkey, r_name FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_TRADE = """l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS trade_id,
    {commodity} AS commodity, {tick} AS tick,
    floor(l_extendedprice / l_quantity * 100) / 100.0 AS price,
    CAST(l_quantity AS BIGINT) AS quantity,
    CASE WHEN o_orderkey % 2 = 1 THEN 'acct_' || (l_suppkey // 10 * 2 + 1) ELSE 'acct_' || (o_custkey // 20 * 2) END AS buyer_trader_id,
    CASE WHEN o_orderkey % 2 = 1 THEN 'acct_' || (o_custkey // 20 * 2) ELSE 'acct_' || (l_suppkey // 10 * 2 + 1) END AS seller_trader_id,
    CASE WHEN o_orderstatus = 'O' THEN 'buy' WHEN o_orderstatus = 'F' THEN 'sell'
         WHEN l_linenumber % 2 = 1 THEN 'buy' ELSE 'sell' END AS aggressor_side,
    l_orderkey * 8 + l_linenumber AS seq"""

_DAY = "CAST(date_diff('day', DATE '1995-01-01', CAST({c} AS DATE)) AS BIGINT)"

TRADES = PLACE + """, trades AS (
  SELECT * FROM (SELECT """ + _TRADE.format(commodity="r_name", tick=_DAY.format(c="l_shipdate")) + """
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN place ON l_suppkey = s_suppkey)
  WHERE buyer_trader_id <> seller_trader_id)"""

BRAND_TAPE = "trades AS (SELECT " + _TRADE.format(
    commodity="p_brand", tick=_DAY.format(c="l_shipdate") + " * 60 + l_orderkey % 60"
) + """
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

ORDERS = """base_orders AS (
  SELECT 'ord-' || o_orderkey || CASE o_orderkey % 7 WHEN 0 THEN 's' WHEN 1 THEN 'g' WHEN 2 THEN 'l' WHEN 3 THEN 'w'
           WHEN 4 THEN 'i' ELSE '' END AS order_id,
    CASE o_orderkey % 5 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' WHEN 3 THEN 'EUROPE'
         ELSE 'MIDDLE EAST' END AS commodity,
    'acct_' || (o_custkey // 20 * 2) AS trader_id,
    CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
    floor(o_totalprice / 100) / 100.0 AS price,
    CAST(CASE WHEN o_orderkey % 17 = 0 THEN 400 ELSE 10 + o_orderkey % 40 END AS BIGINT) AS quantity,
    """ + _DAY.format(c="o_orderdate") + """ AS tick, o_orderkey, o_orderstatus FROM orders),
order_events AS (
  SELECT order_id, commodity, trader_id, side, price, quantity, tick, 'placed' AS event_type FROM base_orders
  UNION ALL
  SELECT order_id, commodity, trader_id, side, price, quantity, tick + o_orderkey % 15, 'cancelled' FROM base_orders
  WHERE o_orderstatus = 'P'
  UNION ALL
  SELECT order_id, commodity, trader_id, side, price, quantity, tick + o_orderkey % 7, 'filled' FROM base_orders
  WHERE o_orderstatus = 'F')"""

QUOTES = """base_quotes AS (
  SELECT 'q-' || o_orderkey || CASE o_orderkey % 7 WHEN 0 THEN 's' WHEN 1 THEN 'g' WHEN 2 THEN 'l' ELSE '' END AS order_id,
    CASE o_orderkey % 5 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' WHEN 3 THEN 'EUROPE' ELSE 'MIDDLE EAST' END AS commodity,
    'acct_' || (o_custkey // 20 * 2) AS trader_id, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
    CASE WHEN o_orderkey % 194 = 0 THEN 2006 WHEN o_orderkey % 2 = 0 THEN 1999 - o_orderkey % 13 ELSE 2001 + o_orderkey % 11 END / 2.0::DOUBLE AS price,
    CAST(10 + o_orderkey % 40 AS BIGINT) AS quantity, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN (10 + o_orderkey % 40) // 3 ELSE 0 END AS part,
    """ + _DAY.format(c="o_orderdate") + """ AS start, o_orderkey % 3 AS part_wait,
    CASE o_orderstatus WHEN 'F' THEN 3 + o_orderkey % 7 WHEN 'P' THEN 1 + o_orderkey % 15 ELSE 20 + o_orderkey % 41 END AS wait FROM orders),
quote_changes AS (
  SELECT commodity, side, price, start AS tick, quantity AS change FROM base_quotes UNION ALL
  SELECT commodity, side, price, start + part_wait, -part FROM base_quotes WHERE part > 0 UNION ALL
  SELECT commodity, side, price, start + wait, part - quantity FROM base_quotes)"""

EPISODES = """episodes AS (
  SELECT 'ep-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS event_id, r_name AS commodity,
    CASE s_suppkey % 4 WHEN 0 THEN 'spoofing' WHEN 1 THEN 'wash_trading' WHEN 2 THEN 'pump_and_dump'
         ELSE 'layering' END AS persona,
    (s_suppkey * 37) % 2000 AS start_tick, (s_suppkey * 37) % 2000 + 60 + s_suppkey % 120 AS end_tick,
    ['acct_' || (s_suppkey // 10 * 2 + 1), 'acct_' || ((s_suppkey * 7 + 3) // 20 * 2)] AS trader_ids,
    (s_suppkey % 10) / 10.0 AS fake_depth
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
episode_accounts AS (
  SELECT DISTINCT event_id, commodity, persona, start_tick, end_tick, trader_id
  FROM (SELECT *, unnest(trader_ids) AS trader_id FROM episodes))"""

FEED = """feed AS (
  SELECT event_type AS commodity,
    CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 1440 + hour(ts) * 60 + minute(ts) AS BIGINT) AS minute,
    value AS price, event_id FROM events)"""

SCORED = """scored0 AS (
  SELECT commodity, step, trader_id, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS v,
    (CAST(substr(trader_id, 6) AS BIGINT) * 131 + step * 37 + count(*) * 11 + CAST(sum(quantity) AS BIGINT)) % 1000 AS h
  FROM (SELECT commodity, tick // 30 AS step, quantity, unnest([buyer_trader_id, seller_trader_id]) AS trader_id FROM trades)
  GROUP BY commodity, step, trader_id),
scored AS (
  SELECT commodity, step * 30 AS window_start, trader_id, step * 30 + 179 AS window_end,
    (h * 7 % 1000) / 1000.0::DOUBLE AS prob_spoofing, ((h * 13 + 250) % 1000) / 1000.0::DOUBLE AS prob_wash_trading,
    ((h * 29 + 500) % 1000) / 1000.0::DOUBLE AS prob_pump_and_dump, ((h * 43 + 750) % 1000) / 1000.0::DOUBLE AS prob_layering,
    (h * 17 % 1000) / 1000.0::DOUBLE AS prob_fake_depth, ((h * 61 + 100) % 1000) / 1000.0::DOUBLE AS iso_score,
    CAST(h % 5 AS INTEGER) AS n_dev FROM scored0)"""

LAST_PRICE = "arg_max(price, {'t': tick, 's': seq, 'p': price})"
FIRST_PRICE = "arg_min(price, {'t': tick, 's': seq, 'p': price})"


def with_ctes(*parts: str) -> str:
    """``WITH`` clause of the given CTE groups, each named once."""
    seen: list[str] = []
    for p in parts:
        if p not in seen:
            seen.append(p)
    return "WITH " + ",\n".join(seen) + "\n"
