"""Reusable column expressions: rounding, safe division, day arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def rnd(col: Column | str, scale: int) -> Column:
    """Half-away-from-zero rounding on the decimal value (PostgreSQL NUMERIC rounding).

    Doubles are first fixed to 10 decimals so engines agree on ties; the
    result stays decimal — cast at the output edge.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("decimal(38,10)"), scale)


def rnd_double(col: Column | str, scale: int) -> Column:
    return rnd(col, scale).cast("double")


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL when den is 0 or NULL (NULLIF guard)."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def pct(num: Column, den: Column, scale: int = 2) -> Column:
    """Percentage num/den*100 rounded, 0.0 when den is 0."""
    return F.coalesce(rnd_double(ratio(num, den) * 100.0, scale), F.lit(0.0))


def whole_days(start: Column, end: Column) -> Column:
    """Complete 24-hour periods from start to end (DATE_PART('day', end - start))."""
    return F.timestamp_diff("DAY", start, end).cast("int")


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def avg_days(micros: Column) -> Column:
    """Mean of microsecond spans in days; the sum is exact, whatever its order."""
    return ratio(F.sum(micros.cast("decimal(18,0)")), F.count(micros)) / MICROS_PER_DAY


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def fmt_fixed(col: Column, decimals: int) -> Column:
    """Text with ``decimals`` digits of a value rounded half-up on its decimal form first,
    so the printed digits do not depend on the engine's binary tie handling."""
    return F.format_string(f"%.{decimals}f", rnd_double(col, decimals))


def fmt_thousands(col: Column, decimals: int = 2) -> Column:
    """``1,234.56`` style text of the rounded value."""
    return F.format_number(rnd_double(col, decimals), decimals)


def grand_total(col: str) -> Column:
    """Sum of ``col`` over all rows of an *aggregated* result (a handful of groups), as a window.

    Used for shares of a total; never applied to row-level data.
    """
    return F.sum(col).over(Window.partitionBy())


def combine_single_rows(rows: list[DataFrame]) -> DataFrame:
    """Side-by-side combination of one-row aggregates from different tables, as one lazy plan.

    The rows are stacked, each with NULL in the columns of the others; the only value of
    every column is then taken.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for df in rows for c in df.columns])
