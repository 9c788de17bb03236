"""Numeric helpers that stay quiet under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def known(col: Column) -> Column:
    """NULL for NaN: Spark sorts NaN above every number, here it means missing."""
    return F.when(~F.isnan(col), col)


def to_number(col: Column) -> Column:
    """Parse to DOUBLE, once a row; text that is no number, and NaN, become NULL."""
    return F.nanvl(col.try_cast("double"), F.lit(None).cast("double"))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where den is 0."""
    return F.try_divide(num, den)


def change(now: Column, before: Column) -> Column:
    """Relative change, NULL where the base is 0 or missing."""
    return ratio(now, before) - F.lit(1.0)


def usable_price(col: Column) -> Column:
    """TRUE for a number above zero; never NULL."""
    return F.coalesce(to_number(col) > 0, F.lit(False))
