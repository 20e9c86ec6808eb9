"""Numeric expressions shared by scores and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(col: Column, digits: int) -> Column:
    """Half-even rounding of the scaled value."""
    scale = float(10**digits)
    return F.rint(col * scale) / scale


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def band(score: Column) -> Column:
    return F.when(score >= 70, "green").when(score >= 40, "orange").otherwise("red")


def difficulty_band(difficulty: Column) -> Column:
    return F.when(difficulty < 30, "green").when(difficulty < 60, "orange").otherwise("red")


def gauge(value: Column) -> Column:
    """Value for a 0-100 gauge: missing or non-finite becomes 0, the rest is clamped."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))).otherwise(F.lit(0.0))


def fixed_text(col: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, ties to even."""
    return F.format_string(f"%.{digits}f", round_even(col, digits))


def percent_text(rate: Column) -> Column:
    return F.concat(fixed_text(rate * 100, 1), F.lit("%"))
