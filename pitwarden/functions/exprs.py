"""Column helpers: guarded division, clipping, basis points and the normal CDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_or_col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def safe_div(a: Column | str, b: Column | str, fill=0.0) -> Column:
    """a / b where b > 0, otherwise ``fill`` (also when b is missing)."""
    b = col(b)
    return F.when(b > 0, col(a) / b).otherwise(F.lit(fill))


def clip(x: Column | str, lo=None, hi=None) -> Column:
    """Clamp a present value to [lo, hi]."""
    out = col(x)
    if hi is not None:
        out = F.least(out, lit_or_col(hi))
    if lo is not None:
        out = F.greatest(out, lit_or_col(lo))
    return out


def clip_present(x: Column | str, lo=None, hi=None) -> Column:
    """Clamp, keeping a missing value missing."""
    return F.when(col(x).isNotNull(), clip(x, lo, hi))


def rnd(x: Column | str, digits: int = 0) -> Column:
    """Round half away from zero on the stored double, the way other engines do it."""
    x = col(x).cast("double")
    scale = F.lit(float(10 ** digits))
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def bp(a: Column | str, b: Column | str) -> Column:
    """Move from a to b in basis points, one decimal; 0 when either is missing or a is 0."""
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull() & (a != 0), rnd((b - a) / a * 1e4, 1)).otherwise(F.lit(0.0))


def finite(x: Column | str, fill=0.0) -> Column:
    """NaN, +-inf and missing become ``fill``."""
    x = col(x)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(fill)).otherwise(x)


# Abramowitz & Stegun 7.1.26 (absolute error below 1.5e-7).
ERF_P = 0.3275911
ERF_COEFFICIENTS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def norm_cdf(x: Column | str) -> Column:
    """Standard normal CDF; Spark has no erf."""
    x = col(x)
    u = F.abs(x) / F.lit(2.0 ** 0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * u)
    poly = F.lit(0.0)
    for a in reversed(ERF_COEFFICIENTS):
        poly = (poly + F.lit(a)) * t
    erf = F.lit(1.0) - poly * F.exp(-u * u)
    return F.lit(0.5) * (F.lit(1.0) + F.signum(x) * erf)


def argmax_name(pairs: list[tuple[str, Column]]) -> Column:
    """Name with the largest value; the first listed wins a tie."""
    best = F.greatest(*[c for _, c in pairs]) if len(pairs) > 1 else pairs[0][1]
    out = F.when(pairs[0][1] == best, F.lit(pairs[0][0]))
    for name, c in pairs[1:]:
        out = out.when(c == best, F.lit(name))
    return out


def top_abs(m: Column | str, k: int, digits: int = 4) -> Column:
    """The k entries of a map with the largest absolute value, name order on ties."""
    entries = F.transform(
        F.map_entries(col(m)),
        lambda e: F.struct((-F.abs(e["value"])).alias("rank"), e["key"].alias("key"), e["value"].alias("value")),
    )
    best = F.slice(F.array_sort(entries), 1, k)
    return F.map_from_entries(F.transform(best, lambda e: F.struct(e["key"], rnd(e["value"], digits))))


def starts_with_any(c: Column | str, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | col(c).startswith(p)
    return F.coalesce(out, F.lit(False))


def canonical_persona(c: Column | str) -> Column:
    """Map persona spellings onto the four canonical names by substring."""
    low = F.lower(col(c))
    return (
        F.when(low.contains("spoof"), "spoofing")
        .when(low.contains("wash"), "wash_trading")
        .when(low.contains("pump"), "pump_and_dump")
        .when(low.contains("layer"), "layering")
        .otherwise(low)
    )


def order_tag(c: Column | str) -> Column:
    """Trailing audit letters of an order id ('ord-17sg' -> 'sg', none -> '')."""
    return F.regexp_extract(col(c), r"-\d+([a-z]*)$", 1)


def price_to_grid(price: Column | str, tick_size: float) -> Column:
    """Nearest price on the contract grid, never below one tick."""
    return F.greatest(F.round(col(price) / F.lit(tick_size)) * F.lit(tick_size), F.lit(tick_size))
