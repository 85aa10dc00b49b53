"""Rolling frames over ordered rows, with the minimum-observation guard of each."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F

from pitwarden.functions.exprs import col


def guarded(agg: Column, x: Column, spec: WindowSpec, min_periods: int) -> Column:
    value = agg.over(spec)
    if min_periods <= 1:
        return value
    return F.when(F.count(x).over(spec) >= min_periods, value)


AGGREGATES = {
    "sum": F.sum,
    "mean": F.avg,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "min": F.min,
    "max": F.max,
    "median": lambda c: F.percentile(c, 0.5),
}


def trailing(x, spec: WindowSpec, n: int, fn: str, min_periods: int | None = None, lag: int = 0) -> Column:
    """Last ``n`` rows ending ``lag`` rows back; default minimum is half the frame."""
    x = col(x)
    need = max(1, n // 2) if min_periods is None else min_periods
    frame = spec.rowsBetween(-(n - 1) - lag, -lag)
    return guarded(AGGREGATES[fn](x), x, frame, need)


def centred(x, spec: WindowSpec, n: int, fn: str = "mean") -> Column:
    """Odd-length frame around the current row, shortened at the ends."""
    h = n // 2
    return AGGREGATES[fn](col(x)).over(spec.rowsBetween(-h, h))


def forward_sum(x, spec: WindowSpec, n: int) -> Column:
    """Sum of the next ``n`` rows, current row excluded; 0 at the end."""
    return F.coalesce(F.sum(col(x)).over(spec.rowsBetween(1, n)), F.lit(0.0))


def forward_fill(x, spec: WindowSpec) -> Column:
    return F.last(col(x), ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, 0))


def back_fill(x, backwards: WindowSpec) -> Column:
    """Next value at or after the row; the window must be ordered backwards, so that its frame only grows."""
    return F.last(col(x), ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, 0))


def expanding_median(x, spec: WindowSpec, lag: int = 0) -> Column:
    return F.percentile(col(x), 0.5).over(spec.rowsBetween(Window.unboundedPreceding, -lag))


def rolling_corr(x, y, spec: WindowSpec, n: int, min_periods: int) -> Column:
    """Correlation over the last ``n`` rows; missing when either side is constant."""
    x, y = col(x), col(y)
    frame = spec.rowsBetween(-(n - 1), 0)
    sx, sy = F.stddev_samp(x).over(frame), F.stddev_samp(y).over(frame)
    ok = (F.count(x).over(frame) >= min_periods) & (sx > 0) & (sy > 0)
    return F.when(ok, F.covar_samp(x, y).over(frame) / (sx * sy))
