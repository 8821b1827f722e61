"""Exact decimal rounding of ratios and averages, and display labels.

Ratios of money are rounded from whole cents with 38-digit decimal arithmetic, so the result does not
depend on binary floating point: a share of exactly 12.25 % rounds to 12.2 (half-even) and an
average of exactly 1.005 rounds to 1.01 (half-up) on every engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """decimal(_, 2) money -> whole cents (exact, 38 digits)."""
    return (amount * 100).cast("decimal(38,0)")


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def idiv(a: Column, b: Column) -> Column:
    """Integral division truncating toward zero, exact in 38 digits."""
    return _whole((a - a % b) / b)


def ratio_half_even(num: Column, den: Column, scale: int = 100, digits: int = 1) -> Column:
    """round_half_even(num / den * scale, digits) for non-negative integral num and den (up to
    34 digits). Returns a double; null when den is 0."""
    factor = 10 ** digits
    den = F.when(den != 0, _whole(den))
    n = _whole(_whole(num) * F.lit(scale * factor))
    r = _whole(n % den)
    q = _whole((n - r) / den)
    bump = (_whole(r * 2) > den) | ((_whole(r * 2) == den) & (q % 2 == 1))
    return (q + F.when(bump, F.lit(1)).otherwise(F.lit(0))).cast("double") / F.lit(float(factor))


def mean_half_up(total_cents: Column, n: Column) -> Column:
    """Average money amount to the cent, half away from zero, from the exact cent total and the
    row count. Returns a double; null when n is 0."""
    total, rows = _whole(total_cents), F.when(n > 0, _whole(n))
    q = idiv(_whole(_whole(F.abs(total) * 2) + rows), _whole(rows * 2))
    return F.when(total < 0, -q).otherwise(q).cast("double") / F.lit(100.0)


def money_label(value: Column, currency: str = "SGD", decimals: int = 0) -> Column:
    """``SGD 1,234`` style label."""
    return F.concat(F.lit(currency + " "), F.format_number(value, decimals))


def percent_label(value: Column) -> Column:
    """``12.3%`` style label."""
    return F.format_string("%.1f%%", value)
