"""Gaps and islands: number runs of rows that touch or overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def number_islands(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    slack: int,
    order: list[str | Column] | None = None,
    out: str = "island",
) -> DataFrame:
    """Add ``out``: rows of one key belong together while start <= running max(end) + slack."""
    w = Window.partitionBy(*keys).orderBy(F.col(start), *(order or []))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach + F.lit(slack)), 1).otherwise(0)
    return df.withColumn("_opens", opens).withColumn(out, F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def number_segments(df: DataFrame, keys: list[str], at: str, max_gap: int, out: str = "segment") -> DataFrame:
    """Contiguous stretches per key, from 1; a gap above ``max_gap`` opens the next one."""
    w = Window.partitionBy(*keys).orderBy(at)
    gap = F.col(at) - F.lag(at).over(w)
    opens = F.when(gap.isNull() | (gap > max_gap), 1).otherwise(0)
    return (
        df.withColumn("_opens", opens)
        .withColumn(out, F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        .drop("_opens")
    )
