"""Order statistics without sorting a whole column in one task or a whole history per row."""

from __future__ import annotations

from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from pitwarden.operators.lineage import cut, spread

SKETCH = 10_000  # accuracy of the sketches that bracket a rank: each is off by at most 1 / SKETCH of the rows, and a row
FEW = 3 * SKETCH  # with fewer values that row counts, and all of them are the bracket


def exact_percentiles(df: DataFrame, cols: list[str], probs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, column, prob, value): interpolated percentiles of every column, exact, missing values left out.

    One pass of mergeable sketches gives each rank a bracket; a second one counts the rows below the bracket and the
    distinct values inside, at most a few ten-thousandths of a column's different values. Only those are put in order.
    Values must be numbers other than NaN. A column without values has no rows.
    """
    by = by or []
    asked = [(i, j, c, p) for i, c in enumerate(cols) for j, p in enumerate(probs)]
    around = [min(1.0, max(0.0, p + d)) for p in probs for d in (-2 / SKETCH, 2 / SKETCH)]
    rows = df.select(*by, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    sketches = [f for i in range(len(cols)) for f in (
        F.percentile_approx(f"_{i}", around, SKETCH).alias(f"q{i}"), F.count(f"_{i}").alias(f"n{i}"), F.min(f"_{i}").alias(f"lo{i}"), F.max(f"_{i}").alias(f"hi{i}"))]
    found = rows.groupBy(*by).agg(*sketches) if by else rows.agg(*sketches)
    few = [F.when(F.col(f"n{i}") < FEW, F.flatten(F.array_repeat(F.array(f"lo{i}", f"hi{i}"), len(probs)))).otherwise(F.col(f"q{i}")).alias(f"q{i}") for i in range(len(cols))]
    brackets = cut(found.select(*by, *few, *[f"n{i}" for i in range(len(cols))]))
    if not by:
        return _percentiles_of_all(rows, brackets.first(), cols, probs)
    near = rows.join(brackets.drop(*[f"n{i}" for i in range(len(cols))]), by)

    def place(i: int, j: int) -> Column:
        return F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"), F.when((F.col(f"_{i}") >= F.col(f"q{i}")[2 * j]) & (F.col(f"_{i}") <= F.col(f"q{i}")[2 * j + 1]), F.col(f"_{i}")).alias("v"))

    inside = F.filter(F.array(*[place(i, j) for i, j, _, _ in asked]), lambda s: s.v.isNotNull())
    values = near.select(*by, F.explode(inside).alias("s")).groupBy(*by, "s.i", "s.j", "s.v").agg(F.count(F.lit(1)).alias("n"))
    below = [f for i, j, _, _ in asked for f in (F.count_if(F.col(f"_{i}") < F.col(f"q{i}")[2 * j]).alias(f"b{i}_{j}"),)]
    sizes = [F.count(f"_{i}").alias(f"n{i}") for i in range(len(cols))]
    counts = near.groupBy(*by).agg(*below, *sizes)
    names = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(c).alias("column"), F.lit(p).alias("prob"), F.col(f"b{i}_{j}").alias("below"), F.col(f"n{i}").alias("all")) for i, j, c, p in asked])
    ranks = counts.select(*by, F.explode(names).alias("x")).select(*by, "x.*").withColumn("at", (F.col("all") - 1) * F.col("prob"))
    return _interpolated(values, ranks, by)


def _percentiles_of_all(rows: DataFrame, brackets: Row, cols: list[str], probs: list[float]) -> DataFrame:
    """``exact_percentiles`` of whole columns: a task sorts each Arrow batch and counts below and inside all brackets at once."""
    live = [i for i in range(len(cols)) if brackets[f"n{i}"]]
    shipped = [(i, np.array(brackets[f"q{i}"][::2]), np.array(brackets[f"q{i}"][1::2])) for i in live]
    arrow = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64()), ("n", pa.int64())])

    def run(batches):
        under = np.zeros((len(cols), len(probs)), np.int64)
        for batch in batches:
            parts = []
            for i, lo, hi in shipped:
                v = np.sort(batch.column(i).drop_null().to_numpy(zero_copy_only=False)) + 0.0
                first, last = np.searchsorted(v, lo, "left"), np.searchsorted(v, hi, "right")
                under[i] += first
                for j in np.flatnonzero(first < last):
                    u, n = np.unique(v[first[j]:last[j]], return_counts=True)
                    parts.append((np.full(len(u), i, np.int32), np.full(len(u), j, np.int32), u, n))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts])) for k in range(4)], schema=arrow)
        at = [(i, j, int(under[i, j])) for i, _, _ in shipped for j in range(len(probs))]
        yield pa.RecordBatch.from_arrays([pa.array([a[0] for a in at], pa.int32()), pa.array([a[1] for a in at], pa.int32()), pa.nulls(len(at), pa.float64()), pa.array([a[2] for a in at], pa.int64())], schema=arrow)

    got = cut(rows.mapInArrow(run, "i int, j int, v double, n long").groupBy("i", "j", "v").agg(F.sum("n").alias("n")))
    asked = [(i, j, cols[i], float(p), brackets[f"n{i}"]) for i in live for j, p in enumerate(probs)]
    named = rows.sparkSession.createDataFrame(asked, "i int, j int, column string, prob double, all long")
    ranks = named.join(got.filter("v IS NULL").select("i", "j", F.col("n").alias("below")), ["i", "j"]).withColumn("at", (F.col("all") - 1) * F.col("prob"))
    return _interpolated(got.filter("v IS NOT NULL"), ranks, [])


def _interpolated(values: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """(by, column, prob, value) from the counted ``values`` of each bracket (by, i, j, v, n) and its ``ranks``."""
    upto = F.sum("n").over(Window.partitionBy(*by, "i", "j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = values.withColumn("upto", upto).join(ranks, [*by, "i", "j"]).withColumn("upto", F.col("below") + F.col("upto"))
    low, high = F.floor("at"), F.ceil("at")
    ends = placed.groupBy(*by, "column", "prob", "at").agg(F.min(F.when(F.col("upto") > low, F.col("v"))).alias("lo"), F.min(F.when(F.col("upto") > high, F.col("v"))).alias("hi"))
    # Between two equal values there is nothing to interpolate; the weighted sum would miss them by a rounding error.
    value = F.when((low == high) | (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(F.col("lo") * (high - F.col("at")) + F.col("hi") * (F.col("at") - low))
    return ends.select(*by, "column", "prob", value.alias("value"))


class Halves:
    """The middle of a growing list of numbers: its lower and its upper half as heaps."""

    __slots__ = ("lower", "upper")

    def __init__(self) -> None:
        self.lower: list[float] = []  # negated
        self.upper: list[float] = []

    def add(self, v: float) -> None:
        if len(self.lower) == len(self.upper):
            heappush(self.lower, -heappushpop(self.upper, v))
        else:
            heappush(self.upper, -heappushpop(self.lower, -v))

    def median(self) -> float | None:
        if not self.lower:
            return None
        return -self.lower[0] if len(self.lower) > len(self.upper) else (self.upper[0] - self.lower[0]) / 2


def running_medians(df: DataFrame, keys: list[str], order: str, value: str, prior: str, current: str) -> DataFrame:
    """(keys, order, value, prior, current): the median of the values of a series before a row, and with it.

    A row costs the logarithm of its place. A series passes one task in order; it holds one number per row of the
    series, which is a grid of steps, not of orders or trades.
    """
    given = spread(df.select(*keys, order, F.col(value).cast("double").alias(value)), *keys).sortWithinPartitions(*keys, order)
    out = StructType([*given.schema.fields, StructField(prior, DoubleType()), StructField(current, DoubleType())])
    arrow, k = to_arrow_schema(out), len(keys)

    def run(batches):
        at, halves = None, Halves()
        for batch in batches:
            before, now = [], []
            series = zip(*(batch.column(i).to_pylist() for i in range(k)), strict=True) if k else iter([()] * batch.num_rows)
            for key, v in zip(series, batch.column(k + 1).to_pylist(), strict=True):
                if key != at:
                    at, halves = key, Halves()
                before.append(halves.median())
                if v is not None:
                    halves.add(v)
                now.append(halves.median())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.float64()), pa.array(now, pa.float64())], schema=arrow)

    return given.mapInArrow(run, out)
