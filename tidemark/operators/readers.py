"""Readers over the stored tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

PRICE_COLUMNS = ("close", "adj_close", "shares_out")


def _one_series(obs: DataFrame, source: str | None, series_id: str | None) -> DataFrame:
    if source is not None:
        obs = obs.filter(F.col("source") == source)
    if series_id is not None:
        obs = obs.filter(F.col("series_id") == series_id)
    return obs


def last_obs_date(obs: DataFrame) -> DataFrame:
    """Latest stored period of every series."""
    return obs.groupBy("source", "series_id").agg(F.max("date").alias("last_obs"))


def last_obs_date_of(obs: DataFrame, source: str, series_id: str) -> DataFrame:
    """Latest stored period of one series: one row, NULL if it has none."""
    return _one_series(obs, source, series_id).agg(F.max("date").alias("last_obs"))


def current_series(
    obs: DataFrame,
    source: str | None = None,
    series_id: str | None = None,
    *,
    write_order: str | None = None,
) -> DataFrame:
    """Newest vintage of each period, for all series or one.

    `max_by` keeps a NULL value if the newest vintage has one. It needs no sort
    and combines before the shuffle, so a series or period with very many
    vintages sends one row per map task.

    `obs` holds each vintage once. Raw batches of a store may hold one several
    times: `write_order` names their batch number, and the last write of the
    newest vintage is found in the same single aggregate.
    """
    return (
        _one_series(obs, source, series_id)
        .groupBy("source", "series_id", "date")
        .agg(F.max_by("value", _vintage_rank(write_order)).alias("value"))
    )


def _vintage_rank(write_order: str | None) -> Column:
    """What puts the rows of a period in order: the vintage, and the batch it was written in."""
    if write_order is None:
        return F.col("as_of")
    # One decimal orders by vintage, then by batch, for any 64-bit batch number; it hashes where a struct would sort.
    days = F.unix_date("as_of").cast("decimal(38,0)")
    return days * F.lit(Decimal(2**64)) + F.col(write_order).cast("decimal(20,0)")


def series_as_known_on(
    obs: DataFrame,
    known_date: dt.date | str,
    source: str | None = None,
    series_id: str | None = None,
    *,
    write_order: str | None = None,
) -> DataFrame:
    """Newest vintage of each period among those published by `known_date`."""
    published = obs.filter(F.col("as_of") <= F.lit(known_date).cast("date"))
    return current_series(published, source, series_id, write_order=write_order)


def validity_intervals(obs: DataFrame, *, write_order: str | None = None) -> DataFrame:
    """Each value of a period with the days on which it was the known one.

    (source, series_id, date, value, valid_from, valid_until): known from the vintage
    that brought it until the day before `valid_until`, which is NULL while it stands.
    Vintages that repeat the value before them add no row. A period has one vintage a
    day at most, so the calendar bounds a window partition.
    """
    period = ["source", "series_id", "date"]
    if write_order is not None:
        obs = obs.groupBy(*period, "as_of").agg(F.max_by("value", write_order).alias("value"))
    by_vintage = Window.partitionBy(*period).orderBy("as_of")
    first = F.row_number().over(by_vintage) == 1
    same = F.col("value").eqNullSafe(F.lag("value").over(by_vintage))
    return (
        obs.select(*period, "as_of", "value", (first | ~same).alias("_new"))
        .filter("_new")
        .select(*period, "value", F.col("as_of").alias("valid_from"), F.lead("as_of").over(by_vintage).alias("valid_until"))
    )


def series_as_known_on_dates(
    obs: DataFrame, decisions: DataFrame, *, day: str = "known_date", write_order: str | None = None
) -> DataFrame:
    """Every series as known on each of many decision dates: (known_date, source, series_id, date, value).

    The same as `series_as_known_on` for each distinct date of `decisions`, in one
    job. Dates are numbered in order; a vintage is first seen by the first decision on
    or after its day. Of vintages first seen by the same decision only the newest is
    kept, in an aggregate that combines before the shuffle, and each one left is known
    to a run of decisions that ends where the next one is seen. So vintages never meet
    dates in pairs: rows unfold into the result and nothing else. Decisions are days,
    so a calendar bounds their list. Null dates are no decisions.
    """
    at = F.col(day).cast("date")
    # One row that lists the days; nulls are left out by the aggregate.
    listed = decisions.agg(F.array_sort(F.collect_set(at)).alias("days"))
    numbered = listed.select(F.posexplode("days").alias("_nth", "known_date"), "days")
    # For each day from the first decision to the last: the number of the decision that sees it first.
    since = F.when(F.col("_nth") == 0, F.col("known_date")).otherwise(F.date_add(F.get("days", F.col("_nth") - 1), 1))
    calendar = numbered.select(
        F.col("_nth").alias("_first"), F.explode(F.sequence(since, "known_date", F.expr("interval 1 day"))).alias("as_of")
    )
    n, end = listed.select(F.size("days")).scalar(), listed.select(F.try_element_at("days", F.lit(-1))).scalar()
    period = ["source", "series_id", "date"]
    seen = (
        obs.filter(F.col("as_of") <= end)
        .join(calendar, "as_of", "left")
        .groupBy(*period, F.coalesce("_first", F.lit(0)).alias("_first"))
        .agg(F.max_by("value", _vintage_rank(write_order)).alias("value"))
    )
    until = F.coalesce(F.lead("_first").over(Window.partitionBy(*period).orderBy("_first")), n)
    runs = seen.withColumn("_until", until).select(
        *period, "value", F.explode(F.sequence(F.col("_first"), F.col("_until") - 1)).alias("_nth")
    )
    return runs.join(numbered.select("_nth", "known_date"), "_nth").select("known_date", *period, "value")


def series_catalog(meta: DataFrame) -> DataFrame:
    return meta.select(
        "source", "series_id", "metric_name", "frequency", "unit", "subsector",
        "first_obs", "last_obs", "last_fetched",
    ).orderBy("subsector", "metric_name")


def securities_list(securities: DataFrame) -> DataFrame:
    return securities.select("ticker", "name", "subsector", "from_date", "to_date").orderBy(
        "subsector", "ticker"
    )


def available_indices(index_values: DataFrame) -> DataFrame:
    return index_values.select("index_id").distinct().orderBy("index_id")


def index_levels(index_values: DataFrame, index_id: str) -> DataFrame:
    """Levels of one index by date; prunes partitions when stored by index_id."""
    return (
        index_values.filter(F.col("index_id") == index_id)
        .select("date", "level_pr", "level_tr")
        .orderBy("date")
    )


def prices_wide(prices: DataFrame, value: str, tickers: list[str]) -> DataFrame:
    """One row per date, one column per named ticker.

    The tickers are named by the caller: a pivot over all of a large universe
    would be too wide to use, and naming them saves the job that lists them.
    """
    if value not in PRICE_COLUMNS:
        raise ValueError(f"unexpected price column: {value!r}")
    return prices.groupBy("date").pivot("ticker", tickers).agg(F.first(value))


def price_coverage(prices: DataFrame) -> DataFrame:
    return (
        prices.groupBy("ticker")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
        .orderBy("last_date", "ticker")
    )


def series_bounds(obs: DataFrame) -> DataFrame:
    """First and last period of every series."""
    return obs.groupBy("source", "series_id").agg(
        F.min("date").alias("first_obs"), F.max("date").alias("last_obs")
    )


def asof_value(series: DataFrame, when: dt.date | str, *, keys: list[str], value: str = "value") -> DataFrame:
    """Last non-null value on or before `when`, for every key that has one."""
    usable = series.filter((F.col("date") <= F.lit(when).cast("date")) & F.col(value).isNotNull())
    return usable.groupBy(*keys).agg(F.max_by(value, "date").alias(value))
