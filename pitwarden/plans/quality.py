"""Contract, calibration and stylized-fact queries."""

from pyspark.sql import functions as F

from pitwarden.operators import bars as bo, quality as ql
from pitwarden.operators.lineage import cut
from pitwarden.plans.effects import orders, trades
from pitwarden.plans.labelling import episodes
from pitwarden.plans.registry import query
from pitwarden.plans.shaping import r, rounded
from pitwarden.plans.sql import EPISODES, LAST_PRICE, ORDERS, TRADES, with_ctes
from pitwarden.schema import SCHEMAS

DAILY = f"daily AS (SELECT commodity, tick // 7 AS dt, {LAST_PRICE} AS close, sum(quantity) AS volume FROM trades GROUP BY 1, 2)"


def daily(spark, sf_dir):
    return cut(bo.ohlcv(trades(spark, sf_dir), 7, "at").select("commodity", "at", "close", "volume"))


@query("trade_log_violations", with_ctes(TRADES) + """SELECT * FROM (SELECT 'column seq: not in contract' AS rule, CAST(1 AS BIGINT) AS n UNION ALL
  SELECT 'trade_id: not unique', CAST(coalesce(sum(c), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM trades GROUP BY trade_id HAVING count(*) > 1) UNION ALL
  SELECT 'price: not positive', count(*) FROM trades WHERE price <= 0 UNION ALL SELECT 'quantity: not positive', count(*) FROM trades WHERE quantity <= 0) WHERE n > 0""", "T1 T2")
def trade_log_violations(spark, sf_dir):
    return ql.violations(trades(spark, sf_dir), SCHEMAS["trade_log"])


@query("order_log_violations", with_ctes(ORDERS) + """SELECT * FROM (SELECT 'tick: negative' AS rule, count(*) AS n FROM order_events WHERE tick < 0 UNION ALL
  SELECT 'event_type: unknown value', count(*) FROM order_events WHERE event_type NOT IN ('placed', 'cancelled', 'filled')) WHERE n > 0""", "T1")
def order_log_violations(spark, sf_dir):
    return ql.violations(orders(spark, sf_dir), SCHEMAS["order_log"])


@query("log_invariants", with_ctes(TRADES) + """SELECT t.commodity, CAST(sum(quantity) AS BIGINT) AS volume, count(*) FILTER (WHERE quantity <= 0) AS bad_quantity, count(*) FILTER (WHERE price <= 0) AS bad_price,
  count(*) FILTER (WHERE abs(price / 0.01::DOUBLE - round(price / 0.01::DOUBLE)) >= 1e-6) AS off_grid, count(*) FILTER (WHERE buyer_trader_id = seller_trader_id) AS self_trades, CAST(0 AS BIGINT) AS net_position,
  CAST(coalesce(any_value(d), 0) AS BIGINT) AS duplicate_ids FROM trades t LEFT JOIN (SELECT commodity, sum(c) AS d FROM (SELECT commodity, count(*) AS c FROM trades GROUP BY commodity, trade_id HAVING count(*) > 1) GROUP BY 1) USING (commodity) GROUP BY 1""", "T3")
def log_invariants(spark, sf_dir):
    return ql.log_invariants(trades(spark, sf_dir), 0.01)


@query("roll_gaps", with_ctes(TRADES, DAILY) + f"""SELECT commodity, count(*) AS rows, count(*) FILTER (WHERE close IS NULL) AS missing_closes, count(*) FILTER (WHERE abs(ch) > 0.15) AS gaps, {r('max(abs(ch))')} AS largest_gap
  FROM (SELECT *, close / lag(close) OVER (PARTITION BY commodity ORDER BY dt) - 1 AS ch FROM daily) GROUP BY 1""", "T4 E4")
def roll_gaps(spark, sf_dir):
    return rounded(ql.roll_gaps(daily(spark, sf_dir)))


PAIRS = "pairs AS (SELECT commodity, ln(close) AS y, lag(ln(close)) OVER (PARTITION BY commodity ORDER BY dt) AS x FROM daily)"


@query("ou_fit", with_ctes(TRADES, DAILY, PAIRS) + f""", m AS (SELECT commodity, count(*) + 1 AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y - x) AS drift FROM pairs WHERE x IS NOT NULL GROUP BY 1),
s AS (SELECT commodity, stddev_pop(y - (a + b * x)) AS sd FROM pairs JOIN m USING (commodity) WHERE x IS NOT NULL GROUP BY 1),
f AS (SELECT *, CASE WHEN b > 0 AND b < 1 THEN b ELSE greatest(0.01, least(0.99, b)) END AS beta FROM m JOIN s USING (commodity))
SELECT commodity, n, {r('greatest(-ln(beta), 1e-6)')} AS mean_reversion_speed, {r('exp(a / (1 - beta))', 4)} AS long_run_mean, {r('sd')} AS volatility, {r('drift')} AS drift FROM f WHERE n >= 30""", "T5 E9")
def ou_fit(spark, sf_dir):
    from pitwarden.plans.shaping import half_up

    f = ql.ou_fit(daily(spark, sf_dir))
    return f.select("commodity", "n", *[half_up(F.col(c), 4 if c == "long_run_mean" else 6).alias(c) for c in ("mean_reversion_speed", "long_run_mean", "volatility", "drift")])


@query("volume_fit", with_ctes(TRADES, DAILY) + f"SELECT commodity, count(*) AS n, {r('avg(volume)', 4)} AS mean_volume, {r('stddev_samp(volume) / avg(volume)', 4)} AS volume_cv FROM daily GROUP BY 1", "T6")
def volume_fit(spark, sf_dir):
    return rounded(ql.volume_fit(daily(spark, sf_dir)), 4)


@query("stylized_facts", with_ctes(TRADES, DAILY, ORDERS, EPISODES) + f""", r0 AS (SELECT commodity, dt, ln(close / lag(close) OVER (PARTITION BY commodity ORDER BY dt)) AS r FROM daily),
r1 AS (SELECT *, lag(r) OVER (PARTITION BY commodity ORDER BY dt) AS p FROM r0 WHERE r IS NOT NULL),
a AS (SELECT commodity, kurtosis_pop(r) AS k, count(*) AS n, corr(abs(r), abs(p)) AS ca, corr(r, p) AS cr FROM r1 GROUP BY 1),
m AS (SELECT o.commodity, o.event_type, EXISTS (SELECT 1 FROM episodes e WHERE e.commodity = o.commodity AND o.tick BETWEEN e.start_tick AND e.end_tick) AS ins FROM order_events o),
c AS (SELECT commodity, count(*) AS n_o, coalesce(count(*) FILTER (WHERE NOT ins AND event_type = 'cancelled') / nullif(count(*) FILTER (WHERE NOT ins), 0), 0) AS cn,
  coalesce(count(*) FILTER (WHERE ins AND event_type = 'cancelled') / nullif(count(*) FILTER (WHERE ins), 0), 0) AS cm FROM m GROUP BY 1)
SELECT commodity, {r('k', 4)} AS excess_kurtosis, n AS n_returns, {r('ca', 4)} AS abs_autocorr, {r('cr', 4)} AS raw_autocorr, CAST(NULL AS DOUBLE) AS maker_spread, {r('cn', 4)} AS normal_cancel_ratio, {r('cm', 4)} AS manip_cancel_ratio,
  {r('n_o / n_t', 4)} AS order_to_trade FROM a JOIN c USING (commodity) JOIN (SELECT commodity, count(*) AS n_t FROM trades GROUP BY 1) USING (commodity)""", "T7 D6")
def stylized_facts(spark, sf_dir):
    return rounded(ql.stylized_facts(daily(spark, sf_dir), trades(spark, sf_dir), orders(spark, sf_dir), episodes(spark, sf_dir)), 4)


@query("realised_volatility", with_ctes(TRADES) + " UNION ALL ".join(
    f"SELECT commodity, {h} AS horizon, {r('s')} AS realised, {r(f's / (0.02::DOUBLE / sqrt(23400 / {h}.0::DOUBLE))', 4)} AS ratio FROM (SELECT commodity, stddev_pop(r) AS s FROM (SELECT commodity, ln(p) - ln(lag(p) OVER (PARTITION BY commodity ORDER BY b)) AS r "
    f"FROM (SELECT commodity, tick // {h} AS b, {LAST_PRICE} AS p FROM trades GROUP BY 1, 2)) GROUP BY 1)" for h in (60, 300, 1800)), "T8")
def realised_volatility(spark, sf_dir):
    from pitwarden.plans.shaping import half_up

    v = ql.realised_volatility(trades(spark, sf_dir), (60, 300, 1800), 0.02)
    return v.select("commodity", "horizon", half_up(F.col("realised")).alias("realised"), half_up(F.col("ratio"), 4).alias("ratio"))


@query("bar_statistics", with_ctes(TRADES, DAILY, PAIRS) + f"""SELECT commodity, {r('v')} AS volatility, {r('m')} AS mean_reversion FROM (SELECT commodity, stddev_samp(r) AS v FROM (
  SELECT commodity, close / lag(close) OVER (PARTITION BY commodity ORDER BY dt) - 1 AS r FROM daily) GROUP BY 1) JOIN (SELECT commodity, 1 - regr_slope(y, x) AS m FROM pairs WHERE x IS NOT NULL GROUP BY 1) USING (commodity)""", "T9")
def bar_statistics(spark, sf_dir):
    return rounded(ql.bar_statistics(daily(spark, sf_dir)))


_NUM = "list_distinct(list_filter(regexp_extract_all({c}, '\\b\\d+(?:\\.\\d+)?\\b'), lambda t: NOT regexp_full_match(t, '0*\\d')))"


@query("ungrounded_numbers", f"""WITH d AS (SELECT page_id AS doc_id, html AS note, url AS facts FROM pages)
SELECT doc_id, CAST(len({_NUM.format(c='note')}) AS INTEGER) AS numbers, len(list_filter({_NUM.format(c='note')}, lambda t: NOT list_contains({_NUM.format(c='facts')}, t))) = 0 AS grounded,
  array_to_string(list_sort(list_filter({_NUM.format(c='note')}, lambda t: NOT list_contains({_NUM.format(c='facts')}, t))), ' ') AS unsupported FROM d""", "T10")
def ungrounded_numbers(spark, sf_dir):
    from pitwarden.sources.derived import table

    d = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("note"), F.col("url").alias("facts"))
    g = ql.ungrounded_numbers(d)
    return g.select("doc_id", F.size(ql.number_tokens("note")).alias("numbers"), "grounded", F.array_join("unsupported", " ").alias("unsupported"))
