"""Trailing signals over keyed series with one row per key and date.

Every window is partitioned by the series key. A partition holds one series,
which its calendar bounds; parallelism is across keys. `date` may be a timestamp:
then nothing bounds a series, and `part`, a coarser time that never falls as the
date grows, has it cut and spread over tasks (`operators.scan`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.numeric import change, ratio
from tidemark.functions.periods import PERIODS_PER_YEAR, ZSCORE_WINDOW
from tidemark.operators.align import inner_align, month_last, padded
from tidemark.operators.scan import over_blocks, running


def _ordered(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("date")


def _by_code(frequency: str, table: dict[str, int], default: int, make) -> Column:
    """CASE over the frequency codes, `make(n)` for each period count."""
    out = make(default)
    cases = [(code, n) for code, n in table.items() if n != default]
    return reduce(lambda acc, c: F.when(F.col(frequency) == c[0], make(c[1])).otherwise(acc), cases, out)


def pct_change(
    series: DataFrame,
    periods: int,
    *,
    keys: list[str],
    value: str = "value",
    out: str = "change",
    part: Column | None = None,
) -> DataFrame:
    """Relative change over `periods` rows; a gap counts as unchanged until the next value."""

    def changed(rows: DataFrame, by: list[str]) -> DataFrame:
        before = F.lag("_pad", periods).over(_ordered(by))
        return rows.withColumn(out, change(F.col("_pad"), before))

    if part is not None:
        rows = running(series, keys, ["date"], part=part, last={"_pad": F.col(value)})
        return over_blocks(rows, keys, ["date"], changed, back=periods, part=part).drop("_pad")
    return changed(series.withColumn("_pad", padded(value, keys)), keys).drop("_pad")


def yoy(
    series: DataFrame,
    *,
    keys: list[str],
    periods: int | None = None,
    frequency: str | None = None,
    value: str = "value",
    out: str = "yoy",
) -> DataFrame:
    """Year-over-year change, by a period count or by a column of frequency codes."""
    if periods:
        return pct_change(series, periods, keys=keys, value=value, out=out)
    if frequency is None:
        return pct_change(series, PERIODS_PER_YEAR["M"], keys=keys, value=value, out=out)
    w = _ordered(keys)
    rows = series.withColumn("_pad", padded(value, keys))
    before = _by_code(frequency, PERIODS_PER_YEAR, PERIODS_PER_YEAR["M"], lambda n: F.lag("_pad", n).over(w))
    return rows.withColumn(out, change(F.col("_pad"), before)).drop("_pad")


def mom(series: DataFrame, *, keys: list[str], value: str = "value", out: str = "mom") -> DataFrame:
    return pct_change(series, 1, keys=keys, value=value, out=out)


def qoq(series: DataFrame, *, keys: list[str], value: str = "value", out: str = "qoq") -> DataFrame:
    return pct_change(series, 1, keys=keys, value=value, out=out)


def _running(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Running count, sum and sum of squares of a series.

    Values are taken relative to the series' first one, so differences of the
    sums keep their digits. `_same` counts the rows since the value last changed.
    """
    w = _ordered(keys)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = series.withColumns(
        {
            "_c": F.col(value) - F.first(value, ignorenulls=True).over(upto),
            "_i": F.row_number().over(w),
            "_moved": ~F.col(value).eqNullSafe(F.lag(value).over(w)),
        }
    )
    return rows.withColumns(
        {
            "_n": F.count("_c").over(upto),
            "_s": F.coalesce(F.sum("_c").over(upto), F.lit(0.0)),
            "_q": F.coalesce(F.sum(F.col("_c") * F.col("_c")).over(upto), F.lit(0.0)),
            "_same": F.col("_i") - F.max(F.when(F.col("_moved"), F.col("_i"))).over(upto) + 1,
        }
    )


_RUNNING = ("_c", "_i", "_moved", "_n", "_s", "_q", "_same")


def _over(keys: list[str], column: str, window: int) -> Column:
    """A running sum's part inside the trailing window: linear, whatever the window's length."""
    return F.col(column) - F.coalesce(F.lag(column, window).over(_ordered(keys)), F.lit(0))


def _trailing_z(keys: list[str], window: int) -> Column:
    n, s, q = (_over(keys, c, window) for c in ("_n", "_s", "_q"))
    spread = F.sqrt(F.greatest(q - s * s / window, F.lit(0.0)) / max(window - 1, 1))
    # A window without any change has no deviation, which rounding must not hide.
    deviation = F.when((F.col("_same") < window) & F.lit(window > 1), spread)
    return F.when(n == window, ratio(F.col("_c") - s / window, deviation))


def zscore(
    series: DataFrame,
    window: int | None = None,
    *,
    keys: list[str],
    frequency: str | None = None,
    value: str = "value",
    out: str = "zscore",
    part: Column | None = None,
) -> DataFrame:
    """Distance from the trailing mean in sample standard deviations, full windows only.

    Windows come from running sums, so each row costs the same for any length.
    """
    if part is not None:
        back = window or max(*ZSCORE_WINDOW.values(), ZSCORE_WINDOW["M"])

        def scored(rows: DataFrame, by: list[str]) -> DataFrame:
            return zscore(rows, window, keys=by, frequency=frequency, value=value, out=out)

        return over_blocks(series, keys, ["date"], scored, back=back, part=part)
    rows = _running(series, keys, value)
    if window is not None:
        score = _trailing_z(keys, window)
    else:
        score = _by_code(frequency, ZSCORE_WINDOW, ZSCORE_WINDOW["M"], lambda n: _trailing_z(keys, n))
    return rows.withColumn(out, score).drop(*[c for c in _RUNNING if c != out])


def smooth(
    series: DataFrame,
    window: int,
    *,
    keys: list[str],
    value: str = "value",
    out: str = "smooth",
    part: Column | None = None,
) -> DataFrame:
    """Trailing moving average, full windows only."""
    if part is not None:

        def smoothed(rows: DataFrame, by: list[str]) -> DataFrame:
            return smooth(rows, window, keys=by, value=value, out=out)

        return over_blocks(series, keys, ["date"], smoothed, back=window, part=part)
    rows = _running(series, keys, value)
    mean = F.col(value) - F.col("_c") + _over(keys, "_s", window) / window
    return rows.withColumn(out, F.when(_over(keys, "_n", window) == window, mean)).drop(*[c for c in _RUNNING if c != out])


def diffusion(
    series: DataFrame, *, keys: list[str], panel: list[str] | None = None, value: str = "value"
) -> DataFrame:
    """Per date the share of a panel's present series that rose since its previous date.

    The previous date is the panel's, not the series': a series absent there
    counts as present but not rising. Each row knows its own previous date, so
    rows are counted by (date, own previous date) and only these counts meet
    the panel's calendar; the full grid of dates and series is never built.
    """
    panel = panel or []
    w = Window.partitionBy(*panel, *keys).orderBy("date")
    counts = (
        series.withColumn("_prev_date", F.lag("date").over(w))
        .withColumn("_prev", F.lag(value).over(w))
        .groupBy(*panel, "date", "_prev_date")
        .agg(
            F.count(F.when(F.col(value) > F.col("_prev"), True)).alias("_rose"),
            F.count(value).alias("_here"),
        )
    )
    days = Window.partitionBy(*(panel or [F.lit(0)])).orderBy("date")
    calendar = (
        counts.select(*panel, "date").distinct().withColumn("_panel_prev", F.lag("date").over(days))
    )
    on_time = F.col("_prev_date") == F.col("_panel_prev")
    return (
        counts.join(calendar, [*panel, "date"])
        .groupBy(*panel, "date")
        .agg(
            ratio(
                F.coalesce(F.sum(F.when(on_time, F.col("_rose"))), F.lit(0)).cast("double"),
                F.sum("_here").cast("double"),
            ).alias("diffusion")
        )
    )


def relative_strength(a: DataFrame, b: DataFrame, *, keys: list[str], base: float = 100.0) -> DataFrame:
    """a / b on their common dates, scaled to start at `base`."""
    return strength_of(inner_align(a, b, keys=keys), keys=keys, base=base)


def strength_of(pair: DataFrame, *, keys: list[str], base: float = 100.0) -> DataFrame:
    """a / b of rows that hold both, scaled to start at `base`; rows without one of them don't count."""
    both = pair.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    pair = both.withColumn("_ratio", ratio(F.col("a"), F.col("b")))
    whole = _ordered(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line = ratio(F.col("_ratio"), F.first("_ratio").over(whole)) * base
    return pair.select(*keys, "date", line.alias("strength"))


def rebased_pair(a: DataFrame, b: DataFrame, *, keys: list[str], base: float = 100.0) -> DataFrame:
    """Both series on their common dates, each scaled to start at `base`."""
    return rebased_of(inner_align(a, b, keys=keys), keys=keys, base=base)


def rebased_of(pair: DataFrame, *, keys: list[str], base: float = 100.0) -> DataFrame:
    """Columns a and b of rows that hold both, each scaled to start at `base`."""
    whole = _ordered(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pair = pair.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    return pair.select(
        *keys,
        "date",
        *[(ratio(F.col(c), F.first(c).over(whole)) * base).alias(c) for c in ("a", "b")],
    )


def rebased_tracks(levels: DataFrame, *, key: str = "index_id", value: str = "value", base: float = 100.0) -> DataFrame:
    """Many series scaled to `base` at the first date on which all are present.

    If there is no such date they start where any is present. A series that is
    missing at the start is scaled by its first later value.
    """
    present = levels.filter(F.col(value).isNotNull())
    width = levels.select(F.countDistinct(key)).scalar()
    starts = (
        present.groupBy("date")
        .agg(F.count(F.lit(1)).alias("_here"))
        .agg(F.coalesce(F.min(F.when(F.col("_here") == width, F.col("date"))), F.min("date")))
        .scalar()
    )
    shown = present.filter(F.col("date") >= starts)
    first = F.first(value).over(
        Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return shown.select(key, "date", (ratio(F.col(value), first) * base).alias("rebased"))


def monthly_returns(prices: DataFrame, *, keys: list[str], value: str = "value") -> DataFrame:
    """Month-end simple returns: (keys, date, ret). An empty month returns 0."""
    months = month_last(prices, keys=keys, value=value)
    return (
        pct_change(months, 1, keys=keys, value=value, out="ret")
        .filter(F.col("ret").isNotNull())
        .select(*keys, "date", "ret")
    )


def momentum(levels: DataFrame, window: int = 3, *, keys: list[str], value: str = "value") -> DataFrame:
    """Trailing `window`-month return of a level, at month end."""
    months = month_last(levels, keys=keys, value=value)
    return pct_change(months, window, keys=keys, value=value, out="momentum").select(*keys, "date", "momentum")


def monthly_yoy(series: DataFrame, *, keys: list[str], value: str = "value") -> DataFrame:
    """Year-over-year change of month-start values."""
    months = month_last(series, keys=keys, value=value, label="start", span_nulls=True)
    return yoy(months, keys=keys, value=value).select(*keys, "date", "yoy")


def ar_lags(returns: DataFrame, order: int = 3, *, keys: list[str], value: str = "ret") -> DataFrame:
    """ret_lag0 .. ret_lag{order-1}: the newest known returns."""
    w = _ordered(keys)
    lags = [F.lag(value, i).over(w).alias(f"ret_lag{i}") for i in range(order)]
    return returns.select(*keys, "date", *lags)


def indicator_detail(current: DataFrame, *, keys: list[str], frequency: str | None = None) -> DataFrame:
    """Level and year-over-year change in percent."""
    rows = yoy(current, keys=keys, frequency=frequency)
    return rows.select(*keys, "date", "value", (F.col("yoy") * 100.0).alias("yoy_pct"))
