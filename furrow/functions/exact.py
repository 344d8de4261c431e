"""Exact decimal arithmetic, so results do not depend on partition order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal(value: Column, scale: int = 2, precision: int = 18) -> Column:
    return value.cast(f"decimal({precision},{scale})")


def wide(value: Column) -> Column:
    return value.cast("double")


def ratio(top: Column, bottom: Column) -> Column:
    """Double quotient; null where the divisor is zero."""
    return F.try_divide(wide(top), wide(bottom))


def half_up_price(amount: Column, units: Column) -> Column:
    """amount / units in hundredths, rounded half up by whole-number arithmetic; null without units."""
    cents = (amount * 100).cast("decimal(30,0)")
    count = F.nullif(units.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    whole = F.call_function("div", cents * 2 + count, count * 2)
    return (whole.cast("decimal(16,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")


def fit_line(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column) -> tuple[Column, Column]:
    """Least-squares slope and intercept from exact sums; null slope below two distinct x."""
    slope = ratio(n * sxy - sx * sy, n * sxx - sx * sx)
    intercept = (wide(sy) - slope * wide(sx)) / wide(n)
    return slope, intercept


def sample_std(n: Column, total: Column, squares: Column) -> Column:
    return F.when(
        n > 1, F.sqrt(F.greatest(wide(n * squares - total * total), F.lit(0.0)) / wide(n * (n - 1)))
    )
