"""Surveillance logs derived from the star-schema test tables.

The tables hold no order book, so trades come from line items, order events from orders
and episodes from suppliers.  One tick is one day from 1995-01-01 in the region tape and
one second (day x 60 + offset) in the brand tape.  Every definition exists twice: as
DataFrame code here and as SQL text in ``pitwarden.plans.sql``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from pitwarden.operators.lineage import ensure_checkpoint_dir, table_exists

CUSTOMER_DESK, SUPPLIER_DESK = 20, 10  # neighbouring keys that trade as one account
EPOCH = "1995-01-01"
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stored table; its schema is read from the footer once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def day_tick(c: str) -> Column:
    return F.datediff(F.col(c).cast("date"), F.lit(EPOCH).cast("date")).cast("long")


def customer_account(key: Column) -> Column:
    """The desk of a customer, with an even number; there are as many as the tables have customers for."""
    return F.concat(F.lit("acct_"), (F.floor(key / CUSTOMER_DESK) * 2).cast("string"))


def supplier_account(key: Column) -> Column:
    """The desk of a supplier, with an odd number."""
    return F.concat(F.lit("acct_"), (F.floor(key / SUPPLIER_DESK) * 2 + 1).cast("string"))


def unit_price() -> Column:
    """Whole cents, cut by floor so that every engine gets the same double."""
    return F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / F.lit(100.0)


def _trade_columns(commodity: Column, tick: Column) -> list[Column]:
    odd = F.col("o_orderkey") % 2 == 1
    owner, maker = customer_account(F.col("o_custkey")), supplier_account(F.col("l_suppkey"))
    side = (
        F.when(F.col("o_orderstatus") == "O", "buy")
        .when(F.col("o_orderstatus") == "F", "sell")
        .when(F.col("l_linenumber") % 2 == 1, "buy")
        .otherwise("sell")
    )
    return [
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("trade_id"),
        commodity.alias("commodity"),
        tick.alias("tick"),
        unit_price().alias("price"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.when(odd, maker).otherwise(owner).alias("buyer_trader_id"),
        F.when(odd, owner).otherwise(maker).alias("seller_trader_id"),
        side.alias("aggressor_side"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("seq"),
    ]


def trade_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of five regional markets; prints of an account with itself are dropped."""
    li = table(spark, sf_dir, "lineitem")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    place = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "r_name")
    )
    joined = li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(*_trade_columns(F.col("r_name"), day_tick("l_shipdate"))).filter(
        "buyer_trader_id <> seller_trader_id"
    )


def brand_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trades listed per product brand, on a one-second clock."""
    li = table(spark, sf_dir, "lineitem")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).join(pa, F.col("l_partkey") == F.col("p_partkey"))
    tick = day_tick("l_shipdate") * 60 + F.col("l_orderkey") % 60
    return joined.select(*_trade_columns(F.col("p_brand"), tick))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed, cancelled and filled events; the order id ends in an audit tag."""
    od = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    tag = (
        F.when(key % 7 == 0, "s").when(key % 7 == 1, "g").when(key % 7 == 2, "l")
        .when(key % 7 == 3, "w").when(key % 7 == 4, "i").otherwise("")
    )
    size = F.when(key % 17 == 0, F.lit(400)).otherwise(10 + key % 40).cast("long")
    price = F.floor(F.col("o_totalprice") / 100) / F.lit(100.0)
    commodity = F.element_at(F.array(*[F.lit(r) for r in REGIONS]), (key % 5 + 1).cast("int"))
    base = od.select(
        F.concat(F.lit("ord-"), key.cast("string"), tag).alias("order_id"),
        commodity.alias("commodity"),
        customer_account(F.col("o_custkey")).alias("trader_id"),
        F.when(key % 2 == 0, "buy").otherwise("sell").alias("side"),
        price.alias("price"),
        size.alias("quantity"),
        day_tick("o_orderdate").alias("tick"),
        "o_orderkey",
        "o_orderstatus",
    )
    done = F.when(F.col("o_orderstatus") == "P", F.struct(F.lit("cancelled").alias("event_type"), (key % 15).alias("wait"))).when(
        F.col("o_orderstatus") == "F", F.struct(F.lit("filled").alias("event_type"), (key % 7).alias("wait"))
    )
    placed = F.struct(F.lit("placed").alias("event_type"), F.lit(0).cast("long").alias("wait"))
    steps = F.filter(F.array(placed, done), lambda e: e.isNotNull())
    return base.withColumn("e", F.explode(steps)).select(
        "order_id", "commodity", "trader_id", "side", "price", "quantity",
        (F.col("tick") + F.col("e.wait")).alias("tick"), F.col("e.event_type").alias("event_type"),
    )


def quote_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one book per region around a price of 1,000, on a grid of half points, each with its end.

    Prices, lives and partial fills follow from the order key; every 194th order is a buy above the touch, which inverts the book.
    """
    od = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    tag = F.when(key % 7 == 0, "s").when(key % 7 == 1, "g").when(key % 7 == 2, "l").otherwise("")
    buy = key % 2 == 0
    price = F.when(key % 194 == 0, 2006).when(buy, 1999 - key % 13).otherwise(2001 + key % 11) / F.lit(2.0)
    size = (10 + key % 40).cast("long")
    part = F.when((F.col("o_orderstatus") == "F") & (key % 5 == 0), F.floor(size / 3).cast("long")).otherwise(F.lit(0).cast("long"))
    event = lambda kind, wait, q: F.struct(F.lit(kind).alias("event_type"), wait.cast("long").alias("wait"), q.alias("q"))
    end = (
        F.when(F.col("o_orderstatus") == "F", event("filled", 3 + key % 7, size - part))
        .when(F.col("o_orderstatus") == "P", event("cancelled", 1 + key % 15, size - part)).otherwise(event("cancelled", 20 + key % 41, size - part))
    )
    steps = F.filter(F.array(event("placed", F.lit(0), size), F.when(part > 0, event("partial_fill", key % 3, part)), end), lambda e: e.isNotNull())
    return od.select(
        F.concat(F.lit("q-"), key.cast("string"), tag).alias("order_id"), F.element_at(F.array(*[F.lit(r) for r in REGIONS]), (key % 5 + 1).cast("int")).alias("commodity"),
        customer_account(F.col("o_custkey")).alias("trader_id"), F.when(buy, "buy").otherwise("sell").alias("side"), price.alias("price"), day_tick("o_orderdate").alias("tick"), F.explode(steps).alias("e"),
    ).select("order_id", "commodity", "trader_id", "side", "price", F.col("e.q").alias("quantity"), (F.col("tick") + F.col("e.wait")).alias("tick"), F.col("e.event_type").alias("event_type"))


def manipulation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One episode per supplier: persona, span and two accounts follow from its key."""
    key = F.col("s_suppkey")
    place = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    persona = F.element_at(
        F.array(*[F.lit(p) for p in ("spoofing", "wash_trading", "pump_and_dump", "layering")]), (key % 4 + 1).cast("int")
    )
    start = (key * 37) % 2000
    return place.select(
        F.concat(F.lit("ep-"), F.lpad(key.cast("string"), 9, "0")).alias("event_id"),
        F.col("r_name").alias("commodity"),
        persona.alias("persona"),
        start.alias("start_tick"),
        (start + 60 + key % 120).alias("end_tick"),
        F.array(supplier_account(key), customer_account(key * 7 + 3)).alias("trader_ids"),
        F.create_map(F.lit("realised_fake_depth_share"), (key % 10 / F.lit(10.0)).cast("string")).alias("parameters"),
    )


def minute_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click events read as a quote feed: event type is the series, value the price."""
    ev = table(spark, sf_dir, "events")
    minute = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 1440
                     + F.hour("ts") * 60 + F.minute("ts")).cast("long")
    return ev.select(F.col("event_type").alias("commodity"), minute.alias("minute"), F.col("value").alias("price"), "event_id")


TASK_LEGS = 500_000  # legs of trades that one task groups

THRESHOLDS = {"spoofing": 0.9, "wash_trading": 0.92, "pump_and_dump": 0.94, "layering": 0.9, "fake_depth": 0.95}
SCORE_MIX = {
    "prob_spoofing": (7, 0), "prob_wash_trading": (13, 250), "prob_pump_and_dump": (29, 500), "prob_layering": (43, 750),
    "prob_fake_depth": (17, 0), "iso_score": (61, 100),
}


def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account windows with stand-in scores: plain arithmetic on what the account traded.

    One row per account and 30-tick step with a trade; the window reaches 180 ticks ahead. Almost every leg is a group of its
    own, so they are dealt to as many tasks as their number asks for before any grouping: left to the tasks of the join,
    the groups held by one of them would grow with the tables.
    """
    tasks = max(1, -(-2 * table(spark, sf_dir, "lineitem").count() // TASK_LEGS))
    legs = trade_log(spark, sf_dir).select(
        "commodity", F.expr("tick div 30").alias("step"), "quantity",
        F.explode(F.array("buyer_trader_id", "seller_trader_id")).alias("trader_id"),
    ).repartition(tasks, "commodity", "step", "trader_id")
    g = legs.groupBy("commodity", "step", "trader_id").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("v"))
    number = F.substring("trader_id", 6, 9).cast("long")
    g = g.withColumn("h", (number * 131 + F.col("step") * 37 + F.col("n") * 11 + F.col("v")) % 1000)
    scores = [((F.col("h") * a + b) % 1000 / F.lit(1000.0)).alias(c) for c, (a, b) in SCORE_MIX.items()]
    return g.select(
        "commodity", (F.col("step") * 30).alias("window_start"), "trader_id", (F.col("step") * 30 + 179).alias("window_end"),
        *scores, (F.col("h") % 5).cast("int").alias("n_dev"),
    )


LOGS = {
    "trade_log": trade_log,
    "brand_tape": brand_tape,
    "order_log": order_log,
    "quote_log": quote_log,
    "manipulation_events": manipulation_events,
    "scored_windows": scored_windows,
}
_staged: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def staged_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Folder of a derived log, written once per application.

    The library reads logs as stored tables; deriving one costs a three-way join that is not
    part of the query.  The copy is written again if its folder was cleared.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    path, _ = _staged.get(key, (None, None))
    if path is None or not table_exists(spark, path):
        frame = LOGS[name](spark, sf_dir)
        path = f"{ensure_checkpoint_dir(spark)}/logs/{name}-{uuid.uuid4().hex}"
        frame.write.parquet(path)
        _staged[key] = (path, frame.schema)
    return path


def staged(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived log as a stored table."""
    path = staged_path(spark, sf_dir, name)
    return spark.read.schema(_staged[spark.sparkContext.applicationId, sf_dir, name][1]).parquet(path)
