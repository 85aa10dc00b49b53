import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwarden.models import forest as fo
from pitwarden.operators import quality as ql
from pitwarden.plans import load_catalog
from pitwarden.schema import SCHEMAS
from pitwarden.sources import tables as tb


def test_contracts(make):
    good = make.trades([(1, 10, 1, "a", "b", "buy")]).drop("seq")
    assert ql.violations(good, SCHEMAS["trade_log"]).count() == 0
    bad = make.trades([(1, -10, 1, "a", "b", "hold"), (2, 5, 0, "a", "b", "buy")]).drop("seq").withColumn("trade_id", F.lit("same"))
    assert {r["rule"] for r in ql.violations(bad, SCHEMAS["trade_log"]).collect()} == {"price: not positive", "quantity: not positive", "aggressor_side: unknown value", "trade_id: not unique"}
    cancel = make.orders([("o", "a", "buy", 1, 1, 1, "cancelled")]).withColumns({"price": F.lit(None).cast("double"), "quantity": F.lit(None).cast("long"), "side": F.lit(None).cast("string")})
    assert ql.violations(cancel, SCHEMAS["order_log"]).count() == 0
    assert ql.violations(make.events([]), SCHEMAS["manipulation_events"]).count() == 0


def test_write_replaces_and_refuses(make, spark, tmp_path):
    path = str(tmp_path / "trades")
    good = make.trades([(1, 10, 1, "a", "b", "buy")]).drop("seq")
    tb.write_table(good, path, "trade_log")
    with pytest.raises(FileExistsError):
        tb.write_table(good, path, "trade_log", overwrite=False)
    with pytest.raises(ValueError):
        tb.write_table(good.withColumn("price", F.lit(-1.0)), path, "trade_log")
    assert tb.read_table(spark, path, "trade_log").first()["price"] == 10.0
    with pytest.raises(FileNotFoundError):
        tb.read_table(spark, str(tmp_path / "none"))


def test_grounding(spark):
    n = spark.createDataFrame([("moved 42.5 bp in 3 trades", "x 42.5"), ("moved 77 bp", "x 42.5")], "note string, facts string")
    assert [(r["grounded"], r["unsupported"]) for r in ql.ungrounded_numbers(n).collect()] == [(True, []), (False, ["77"])]


def test_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))] + [(600, 12.0, -12.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    forest = fo.fit_forest(df, ["a", "b"], ["id"], n_trees=40)
    s = {r["id"]: r["iso_score"] for r in fo.forest_scores(df, forest).collect()}
    assert len(s) == 601 and s[600] == max(s.values()) and min(s.values()) >= 0 and max(s.values()) <= 1


def test_catalog_is_complete():
    c = load_catalog()
    assert len(c) > 120
    # Model fits have no SQL; tests/test_trees.py and tests/test_bar_model.py check their parts.
    assert {q.name for q in c.values() if q.sql is None} <= {"forest_scores", "market_forest_scores", "detector_alerts", "detector_flags", "detector_cases", "bar_model_scores"}
    covered = {x for q in c.values() for x in q.covers}
    assert {f"I{i}" for i in range(1, 20)} <= covered and {f"M{i}" for i in range(1, 17)} <= covered


def test_derived_table_follows_its_input(spark, tmp_path):
    source, base, built = str(tmp_path / "in"), str(tmp_path / "out"), []

    def read(version=1):
        def build():
            built.append(version)
            return spark.read.parquet(source)
        return tb.derived_table(spark, base, build, [source], version)

    spark.range(3).write.parquet(source)
    first = read()
    assert read().count() == 3 and built == [1]
    spark.range(3, 5).write.mode("append").parquet(source)
    assert read().count() == 5 and built == [1, 1]
    assert first.count() == 3  # an open copy stays readable
    assert read(version=2).count() == 5 and built == [1, 1, 2]
    assert read(version=1).count() == 5 and built == [1, 1, 2]
    keep = tb.builds(spark, base).orderBy(F.desc("built_at")).first()["copy"]
    assert tb.drop_stale(spark, base, keep) == 2
    assert read(version=1).count() == 5 and built == [1, 1, 2, 1]  # a lost copy is built again


def test_a_failed_build_leaves_no_pointer(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(2).write.parquet(source)
    with pytest.raises(ZeroDivisionError):
        tb.derived_table(spark, base, lambda: 1 / 0, [source])
    assert tb.derived_table(spark, base, lambda: spark.read.parquet(source), [source]).count() == 2
