"""Finite feeds are closed: open windows and unmatched orders come out."""

from pyspark.sql import functions as F

from pitwarden.streaming import jobs


def stored(spark, tmp_path, name, rows, schema):
    path = str(tmp_path / name)
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("ts"))
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_last_bar_is_emitted(spark, tmp_path):
    rows = [("gold", 60, 1.0, 1, 1), ("gold", 90, 3.0, 1, 2), ("gold", 130, 2.0, 5, 3), (None, 130, 7.0, 1, 4)]
    feed = stored(spark, tmp_path, "prints", rows, "commodity string, ts long, price double, quantity long, seq long")
    got = {(r["commodity"], r["at"]): (r["open"], r["close"], r["volume"]) for r in
           jobs.run_to_end(jobs.minute_bars, feed).withColumn("at", F.unix_timestamp("bar_start")).collect()}
    assert got == {("gold", 60): (1.0, 3.0, 2), ("gold", 120): (2.0, 2.0, 5), (None, 120): (7.0, 7.0, 1)}


def test_orders_without_a_cancel_are_reported(spark, tmp_path):
    schema = "order_id string, commodity string, trader_id string, ts long"
    placed = stored(spark, tmp_path, "placed", [(i, "gold", "a", 100) for i in ("quick", "slow", "rests")], schema)
    cancelled = stored(spark, tmp_path, "cancelled", [("quick", "gold", "a", 130), ("slow", "gold", "a", 4000)], schema)
    out = jobs.run_to_end(lambda p, c: jobs.order_lifetimes(p, c, "10 minutes", "2 hours"), placed, cancelled)
    assert {r["order_id"]: r["lifetime_s"] for r in out.collect()} == {"quick": 30, "slow": None, "rests": None}


def test_empty_feed(spark, tmp_path):
    feed = stored(spark, tmp_path, "none", [], "commodity string, ts long, score double")
    assert jobs.run_to_end(jobs.alert_sessions, feed).count() == 0
