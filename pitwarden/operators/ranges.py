"""Interval joins on equi keys plus time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _bucket(c: Column, width: int) -> Column:
    return F.floor(c / width).cast("long")


def overlap_join(
    left: DataFrame, right: DataFrame, keys: list[str], l_span: tuple[str, str], r_span: tuple[str, str],
    width: int = 512, slack: int = 0, how: str = "inner",
) -> DataFrame:
    """Pairs with equal keys whose spans come within ``slack`` ticks of each other.

    Both spans are cut into buckets and joined on (keys, bucket); a pair sharing several
    buckets is kept only in the first, so it appears once.  A key holding very many rows is
    split over its buckets.  ``left_semi`` keeps each left row with at least one partner.
    """
    lo, hi = F.col(l_span[0]) - slack, F.col(l_span[1]) + slack
    near = left.withColumn("_lb", _bucket(lo, width)).withColumn("_b", F.explode(F.sequence(F.col("_lb"), _bucket(hi, width))))
    far = right.withColumn("_rb", _bucket(F.col(r_span[0]), width)).withColumn(
        "_b", F.explode(F.sequence(F.col("_rb"), _bucket(F.col(r_span[1]), width)))
    )
    cond = (F.col(l_span[0]) - slack <= F.col(r_span[1])) & (F.col(l_span[1]) + slack >= F.col(r_span[0]))
    pairs = near.join(far, [*keys, "_b"]).filter(cond & (F.col("_b") == F.greatest("_lb", "_rb"))).drop("_b", "_lb", "_rb")
    if how == "left_semi":
        return pairs.select(*left.columns).distinct()
    return pairs
