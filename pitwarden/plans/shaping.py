"""Output shaping shared by the registered queries: rounding, in both languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def half_up(c: Column, digits: int = 6) -> Column:
    """Round half up with the same three double operations in every engine."""
    scale = F.lit(float(10 ** digits))
    return F.floor(c * scale + 0.5) / scale


# A prime number of steps per unit: short decimals never fall half-way between two steps.
GRID = 999983


def on_grid(c: Column) -> Column:
    """Nearest step of 1/GRID, for values that are short decimals and tie at any digit count."""
    return F.floor(c * float(GRID) + 0.5) / float(GRID)


def g(expr: str) -> str:
    return f"floor(CAST({expr} AS DOUBLE) * {GRID}::DOUBLE + 0.5) / {GRID}::DOUBLE"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column."""
    return df.select(*[
        half_up(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def r(expr: str, digits: int = 6) -> str:
    return f"floor(CAST({expr} AS DOUBLE) * 1e{digits} + 0.5) / 1e{digits}"


def rounded_sql(table: str, keys: str, doubles: tuple[str, ...] | list[str], digits: int = 6) -> str:
    cols = ", ".join(f"{r(c, digits)} AS {c}" for c in doubles)
    return f"SELECT {keys}, {cols} FROM {table}"
