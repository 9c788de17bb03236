"""Calendar buckets and the tables keyed by observation frequency."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values, by frequency code (daily, weekly, monthly, quarterly, annual).
PERIODS_PER_YEAR = {"D": 252, "W": 52, "M": 12, "Q": 4, "A": 1}
ZSCORE_WINDOW = {"D": 252, "W": 104, "M": 36, "Q": 12, "A": 5}
STALE_AFTER_DAYS = {"D": 7, "W": 21, "M": 75, "Q": 200, "A": 500}

# Trailing windows in days; YTD starts on January 1.
TRAILING_DAYS = {"1D": 1, "1W": 7, "1M": 30, "3M": 91, "6M": 182, "YTD": None, "1Y": 365}

_TRUNC_UNIT = {"Q": "quarter", "M": "month", "A": "year"}


def period_start(date: Column, code: str) -> Column:
    """First calendar day of the rebalance period; unknown codes mean quarters."""
    return F.trunc(date, _TRUNC_UNIT.get(code, "quarter"))


def by_frequency(frequency: Column, table: dict[str, int], default: int) -> Column:
    """Look a frequency code up in one of the tables above."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), frequency), F.lit(default))


def window_start(last: Column, label: str) -> Column:
    """Start day of a trailing window that ends on `last`."""
    days = TRAILING_DAYS[label]
    return F.trunc(last, "year") if days is None else F.date_sub(last, days)
