import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TRADE = "trade_id string, commodity string, tick long, price double, quantity long, buyer_trader_id string, seller_trader_id string, aggressor_side string, seq long"
ORDER = "order_id string, commodity string, trader_id string, side string, price double, quantity long, tick long, event_type string"
EVENT = "event_id string, commodity string, persona string, start_tick long, end_tick long, trader_ids array<string>, parameters map<string,string>"


@pytest.fixture(scope="session")
def make(spark):
    def trades(rows):
        return spark.createDataFrame([(f"t{i}", "gold", t, float(p), q, b, s, a, i) for i, (t, p, q, b, s, a) in enumerate(rows)], TRADE)

    def orders(rows):
        return spark.createDataFrame([(o, "gold", who, side, float(p), q, t, e) for o, who, side, p, q, t, e in rows], ORDER)

    def events(rows):
        return spark.createDataFrame([(i, "gold", p, a, z, ids, {}) for i, p, a, z, ids in rows], EVENT)

    return type("Make", (), {"trades": staticmethod(trades), "orders": staticmethod(orders), "events": staticmethod(events)})
