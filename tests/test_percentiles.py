from pitwarden.operators.quantiles import exact_percentiles


def test_percentiles_between_equal_values_are_that_value(spark):
    """0.9 * (1 - f) + 0.9 * f is not 0.9 for every fraction f; ties between attributions hang on that last digit."""
    values = [0.9, 0.499, 0.7, 0.149, 0.3]
    rows = [(n, v) for n in range(2, 40) for v in [values[n % 5]] * n]
    df = spark.createDataFrame(rows, "size int, v double")
    got = exact_percentiles(df, ["v"], [0.1, 0.5, 0.9], ["size"]).collect()
    assert len(got) == 3 * 38
    assert [(r["size"], r["prob"], r["value"]) for r in got if r["value"] != values[r["size"] % 5]] == []


def test_many_columns_are_counted_in_one_pass_of_sorted_batches(spark, monkeypatch):
    """an expression per value, column and rank took minutes for the forest's 54 columns."""
    from pyspark.sql import functions as F

    kind = type(spark.range(1))
    seen, whole = [], kind.agg
    monkeypatch.setattr(kind, "agg", lambda self, *f: seen.append(len(f)) or whole(self, *f))
    cols, probs = [f"c{i}" for i in range(6)], [0.1, 0.5, 0.9]
    df = spark.range(0, 40_000, 1, 3).select(*[(F.col("id") * (i + 1) % 40_009).cast("double").alias(c) for i, c in enumerate(cols)], F.lit(None).cast("double").alias("none"))
    got = {(r.column, r.prob): r.value for r in exact_percentiles(df, [*cols, "none"], probs).collect()}
    monkeypatch.undo()
    expected = df.agg(*[F.percentile(c, p).alias(f"{c}|{p}") for c in cols for p in probs]).first().asDict()
    assert {f"{c}|{p}": v for (c, p), v in got.items()} == expected
    assert seen == [4 * 7]  # the sketches; ranks within them are not aggregates of the table


def test_scaling_needs_no_lookup_by_name(spark):
    from pitwarden.models.scaling import robust_scale

    ranges = spark.createDataFrame([("a", 1.0, 2.0), ("b", 0.0, 4.0)], "column string, median double, width double")
    scaled = robust_scale(spark.createDataFrame([(5.0, 2.0, "x")], "a double, b double, k string"), ["a", "b"], ranges)
    assert scaled.columns == ["a", "b", "k"] and scaled.first()[:3] == (2.0, 0.5, "x")
    assert "map" not in scaled._jdf.queryExecution().toString().lower()
