"""Queries on the order book."""

from pitwarden.operators import book as bk
from pitwarden.plans.registry import query
from pitwarden.plans.sql import QUOTES, with_ctes
from pitwarden.sources import derived


def quotes(spark, sf_dir):
    return derived.staged(spark, sf_dir, "quote_log")


@query("near_touch_depth", with_ctes(QUOTES) + """, baits AS (SELECT * FROM base_quotes WHERE right(order_id, 1) IN ('s', 'l')),
best AS (SELECT b.commodity, b.start, (max(q.price) FILTER (WHERE q.side = 'buy') + min(q.price) FILTER (WHERE q.side = 'sell')) / 2 AS mid
  FROM (SELECT DISTINCT commodity, start FROM baits) b JOIN base_quotes q ON q.commodity = b.commodity AND q.start < b.start AND q.start + q.wait >= b.start GROUP BY 1, 2),
batch AS (SELECT commodity, trader_id, side, start AS tick, mid, count(*) AS legs, coalesce(sum(quantity) FILTER (WHERE abs(price - mid) / mid <= 0.002), 0) AS placed
  FROM baits LEFT JOIN best USING (commodity, start) GROUP BY ALL),
depth AS (SELECT b.commodity, b.trader_id, b.side, b.tick, sum(c.change) AS existing FROM batch b JOIN quote_changes c ON c.commodity = b.commodity AND c.side = b.side AND c.tick < b.tick
  WHERE CASE WHEN b.side = 'buy' THEN c.price >= mid * (1 - 0.002::DOUBLE) ELSE c.price <= mid * (1 + 0.002::DOUBLE) END GROUP BY ALL)
SELECT commodity, trader_id, side, tick, mid, legs, CAST(placed AS BIGINT) AS placed, CAST(coalesce(existing, 0) AS BIGINT) AS existing,
  CASE WHEN mid > 0 AND coalesce(existing, 0) + placed > 0 THEN placed::DOUBLE / (coalesce(existing, 0) + placed)::DOUBLE ELSE 0.0::DOUBLE END AS share
FROM batch LEFT JOIN depth USING (commodity, trader_id, side, tick)""", "O8")
def near_touch_depth(spark, sf_dir):
    return bk.near_touch_depth(quotes(spark, sf_dir))


@query("inverted_book", with_ctes(QUOTES) + """, ticks AS (SELECT DISTINCT commodity, tick FROM quote_changes),
best AS (SELECT t.commodity, t.tick, max(q.price) FILTER (WHERE q.side = 'buy') AS bid, min(q.price) FILTER (WHERE q.side = 'sell') AS ask
  FROM ticks t LEFT JOIN base_quotes q ON q.commodity = t.commodity AND q.start <= t.tick AND q.start + q.wait > t.tick GROUP BY 1, 2)
SELECT commodity, count(*) AS n_ticks, count(*) FILTER (WHERE bid IS NOT NULL AND ask IS NOT NULL) AS n_two_sided, count(*) FILTER (WHERE bid >= ask) AS n_inverted,
  min(tick) FILTER (WHERE bid >= ask) AS first_inverted, max(bid - ask) FILTER (WHERE bid >= ask) AS deepest FROM best GROUP BY 1""", "T3 O8")
def inverted_book(spark, sf_dir):
    return bk.inverted_book(quotes(spark, sf_dir))
