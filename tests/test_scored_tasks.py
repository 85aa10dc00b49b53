"""The groups of scored windows are dealt to tasks by the number of legs."""

from pyspark.sql import functions as F

from pitwarden.sources import derived

SMALL = "/root/testdata/sf0.001"


def test_groups_of_a_task_are_bounded(spark, monkeypatch):
    legs = 2 * derived.table(spark, SMALL, "lineitem").count()
    monkeypatch.setattr(derived, "TASK_LEGS", 1000)
    got = derived.scored_windows(spark, SMALL)
    per_task = got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert got.rdd.getNumPartitions() == -(-legs // 1000)
    assert max(r["n"] for r in per_task) <= 2000


def test_rows_do_not_depend_on_the_tasks(spark, monkeypatch):
    one = derived.scored_windows(spark, SMALL)
    want = set(map(tuple, one.collect()))
    monkeypatch.setattr(derived, "TASK_LEGS", 1000)
    got = list(map(tuple, derived.scored_windows(spark, SMALL).collect()))
    assert len(got) == len(want) and set(got) == want
