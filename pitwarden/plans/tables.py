"""Storage round trips, pruned scans and time conversions."""

import uuid

from pyspark.sql import functions as F

from pitwarden.functions.exprs import price_to_grid
from pitwarden.operators.lineage import cut, ensure_checkpoint_dir
from pitwarden.plans.alerts import CASE_CTES, RESULT_CTES, alert_cases, results
from pitwarden.plans.effects import orders, trades
from pitwarden.plans.labelling import episodes
from pitwarden.plans.quality import DAILY, daily
from pitwarden.plans.registry import query
from pitwarden.plans.sql import EPISODES, ORDERS, TRADES, with_ctes
from pitwarden.sources import tables as tb

TRADE_COLS = "trade_id, commodity, tick, price, quantity, buyer_trader_id, seller_trader_id, aggressor_side"


def scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/io/{uuid.uuid4().hex}/{name}"


def order_table(spark, sf_dir):
    return orders(spark, sf_dir)


@query("parquet_round_trip", with_ctes(ORDERS) + "SELECT order_id, commodity, trader_id, side, price, quantity, tick, event_type FROM order_events", "A1 A2")
def parquet_round_trip(spark, sf_dir):
    path = tb.write_table(order_table(spark, sf_dir), scratch(spark, "orders"), "order_log")
    return tb.read_table(spark, path, "order_log")


@query("csv_round_trip", with_ctes(TRADES) + f"SELECT {TRADE_COLS} FROM trades", "A3")
def csv_round_trip(spark, sf_dir):
    path = tb.write_csv(trades(spark, sf_dir).drop("seq"), scratch(spark, "trades"))
    return tb.read_csv(spark, path, tb.struct_of("trade_log"))


@query("jsonl_round_trip", with_ctes(EPISODES) + "SELECT persona, count(*) AS n, CAST(sum(end_tick - start_tick) AS BIGINT) AS ticks FROM episodes GROUP BY 1", "A4")
def jsonl_round_trip(spark, sf_dir):
    path, ev = scratch(spark, "episodes"), episodes(spark, sf_dir)
    tb.append_jsonl(ev.filter("persona < 'q'"), path)
    tb.append_jsonl(ev.filter("persona >= 'q'"), path)
    back = tb.read_jsonl(spark, path, ev.schema)
    return back.groupBy("persona").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_tick") - F.col("start_tick")).alias("ticks"))


@query("market_scan", with_ctes(ORDERS) + "SELECT commodity, event_type, count(*) AS n, min(tick) AS first_tick, max(tick) AS last_tick FROM order_events WHERE commodity IN ('ASIA', 'EUROPE') GROUP BY 1, 2", "A5 A6")
def market_scan(spark, sf_dir):
    path = tb.write_table(order_table(spark, sf_dir), scratch(spark, "orders"), partition_by=("commodity",))
    s = tb.scan(spark, path, ["tick", "event_type", "commodity", "not_there"], commodity=["ASIA", "EUROPE"])
    return s.groupBy("commodity", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"))


@query("episode_orders", with_ctes(ORDERS, EPISODES) + "SELECT order_id, trader_id, event_type, tick FROM order_events WHERE trader_id IN (SELECT trader_id FROM episode_accounts WHERE persona IN ('spoofing', 'layering'))", "A7 C18")
def episode_orders(spark, sf_dir):
    ev = episodes(spark, sf_dir)
    return tb.episode_orders(orders(spark, sf_dir), ev).select("order_id", "trader_id", "event_type", "tick")


@query("alerted_scan", with_ctes(*RESULT_CTES) + "SELECT commodity, window_start, trader_id, predicted_persona, prob_spoofing AS spoofing_score FROM results WHERE final_flag", "A8 A9")
def alerted_scan(spark, sf_dir):
    from pitwarden.operators.ensemble import flags_table

    path = tb.write_table(flags_table(results(spark, sf_dir)), scratch(spark, "flags"), "flags")
    return spark.read.parquet(path).filter("final_flag").select("commodity", "window_start", "trader_id", "predicted_persona", F.col("persona_scores")["spoofing"].alias("spoofing_score"))


@query("wide_to_long", with_ctes(TRADES, DAILY) + "SELECT dt AS at, commodity, close, CAST(volume AS BIGINT) AS volume FROM daily WHERE dt > (SELECT max(dt) FROM daily) - 50", "A12")
def wide_to_long(spark, sf_dir):
    tickers = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    wide = daily(spark, sf_dir).groupBy("at").pivot("commodity", tickers).agg(F.first("close").alias("close"), F.first("volume").alias("volume"))
    return tb.keep_recent(tb.wide_to_long(wide, "at", tickers), "at", 50)


@query("latest_dataset", """WITH m AS (SELECT event_type AS source, 'ds_' || event_id AS dataset, ts AS fetched_at FROM events) SELECT source, arg_max(dataset, {'a': fetched_at, 'b': dataset}) AS dataset FROM m GROUP BY 1""", "A11")
def latest_dataset(spark, sf_dir):
    from pitwarden.sources.derived import table

    m = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.concat(F.lit("ds_"), F.col("event_id").cast("string")).alias("dataset"), F.col("ts").alias("fetched_at"))
    return tb.latest_dataset(m).select("source", "dataset")


@query("tick_times", with_ctes(TRADES) + "SELECT DISTINCT tick, strftime(make_timestamp((1767225600 + tick) * 1000000), '%Y-%m-%d %H:%M:%S') AS at, strftime(make_timestamp(tick * 60000000), '%Y-%m-%d %H:%M:%S') AS minute_at FROM trades", "A14")
def tick_times(spark, sf_dir):
    fmt = "yyyy-MM-dd HH:mm:ss"

    def text(c):
        return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), fmt)

    return trades(spark, sf_dir).select("tick").distinct().select("tick", text(tb.tick_to_time(F.col("tick"))).alias("at"), text(tb.minute_to_time(F.col("tick"))).alias("minute_at"))


@query("market_of_alerts", with_ctes(*RESULT_CTES) + "SELECT commodity, window_start, trader_id, 'm' || (window_start // 600) AS market FROM results WHERE final_flag", "B6")
def market_of_alerts(spark, sf_dir):
    ranges = trades(spark, sf_dir).select("commodity", F.expr("tick div 600").alias("i")).distinct().select(
        "commodity", F.concat(F.lit("m"), F.col("i").cast("string")).alias("market"), (F.col("i") * 600).alias("lo"), (F.col("i") * 600 + 599).alias("hi"))
    return tb.market_of(results(spark, sf_dir).filter("final_flag"), ranges).select("commodity", "window_start", "trader_id", "market")


@query("case_raw_rows", with_ctes(*CASE_CTES, ORDERS) + """SELECT case_id, order_id, event_type, tick, n, total FROM (SELECT c.case_id, order_id, event_type, tick, CAST(row_number() OVER (PARTITION BY c.case_id ORDER BY tick, order_id, event_type) AS INTEGER) AS n,
  count(*) OVER (PARTITION BY c.case_id) AS total FROM cases c JOIN order_events o ON o.commodity = c.commodity AND o.trader_id = c.trader_id AND o.tick BETWEEN c.start_tick AND c.end_tick) WHERE n <= 500""", "B4 B3")
def case_raw_rows(spark, sf_dir):
    from pitwarden.operators.cases import case_rows

    c = cut(alert_cases(spark, sf_dir))
    return case_rows(c, orders(spark, sf_dir)).select("case_id", "order_id", "event_type", "tick", "n", "total")


@query("prices_on_grid", with_ctes(TRADES) + "SELECT trade_id, tick, price, greatest(round(price / 0.25::DOUBLE) * 0.25::DOUBLE, 0.25::DOUBLE) AS grid_price FROM trades", "B8")
def prices_on_grid(spark, sf_dir):
    return trades(spark, sf_dir).select("trade_id", "tick", "price", price_to_grid("price", 0.25).alias("grid_price"))


@query("stored_features", with_ctes(TRADES, DAILY) + "SELECT commodity, dt AS at, close, CAST(volume AS BIGINT) AS volume, 5 AS feature_version FROM daily", "A13")
def stored_features(spark, sf_dir):
    base = scratch(spark, "daily")
    tb.versioned(spark, base, lambda: daily(spark, sf_dir))
    tb.versioned(spark, base, lambda: daily(spark, sf_dir))
    return spark.read.parquet(base)


@query("refreshed_table", with_ctes(TRADES, DAILY) + "SELECT commodity, dt AS at, close, CAST(volume AS BIGINT) AS volume FROM daily", "A13")
def refreshed_table(spark, sf_dir):
    """The daily table is stored for a part of its input, then read again after the rest of the input arrived."""
    source, base = scratch(spark, "input"), scratch(spark, "derived")
    days = daily(spark, sf_dir)

    def read():
        return tb.derived_table(spark, base, lambda: spark.read.parquet(source), [source])

    days.filter("commodity < 'B'").write.parquet(source)
    read()
    days.filter("commodity >= 'B'").write.mode("append").parquet(source)
    return read()
