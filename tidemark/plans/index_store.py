"""Stored indices, built anew only where prices came or were restated.

Beside the levels a store keeps what they are chained from: the days of each index
(growth since the period's rebalance), how each ticker's periods opened and ended, the
weights, and the usable prices of the benchmarks, each in one folder per period.
A refresh finds the periods that new batches of prices touch, reads the prices of
those periods alone, replaces their folders and chains the levels anew from the stored
days, of which there is one row for each index and day. The marks that say up to which
batch all this holds are written last, so a run that fails is made up by the next one.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.numeric import known
from tidemark.functions.periods import period_start
from tidemark.operators import index, quality
from tidemark.operators.writers import last_prints, read_batches, replace_index
from tidemark.plans.store import Store, prints
from tidemark.schemas import INDEX_DAYS, INDEX_MARKS, PERIOD_BASELINES, PERIOD_WEIGHTS, PRICE_PRINTS, TICKER_ENDS

PRICE_TABLES = ("prices", "landed_prices")
MONTHS = {"Q": 3, "M": 1, "A": 12}


def _read(spark: SparkSession, store: Store, table: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(store.path(table))


def _marks(spark: SparkSession, store: Store) -> dict | None:
    """Up to which batch of each table the stored days hold, and with which settings; None where nothing is stored."""
    try:
        row = _read(spark, store, "index_marks", INDEX_MARKS).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if row is None else row.asDict()


def _settings(members: DataFrame, baselines: DataFrame, options: dict) -> str:
    """What a change of asks for a full build: members, benchmarks and the options, told by hashes."""

    def digest(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*rows.columns))).first())

    own = members.select("index_id", "ticker", "from_date", "to_date")
    return repr((digest(own), digest(baselines.select("index_id", "ticker")), sorted(options.items())))


def _clean_rows(spark: SparkSession, store: Store, table: str) -> DataFrame:
    rows = read_batches(spark, store.path(table), PRICE_PRINTS).filter(F.col("status") == quality.CLEAN)
    return rows.select("ticker", "date", "batch")


def changed_prices(spark: SparkSession, store: Store, marks: dict, batch: int | None = None) -> DataFrame:
    """(ticker, date) of clean prices in batches that came after the marks, and in direct batch `batch`."""
    parts = [_clean_rows(spark, store, t).filter(F.col("batch") > marks[t]) for t in PRICE_TABLES]
    if batch is not None and batch <= marks["prices"]:
        parts.append(_clean_rows(spark, store, "prices").filter(F.col("batch") == batch))
    return reduce(DataFrame.unionByName, parts).drop("batch")


def _last_batches(spark: SparkSession, store: Store) -> dict[str, int]:
    found = {}
    for table in PRICE_TABLES:
        found[table] = read_batches(spark, store.path(table), PRICE_PRINTS).agg(F.max("batch")).first()[0]
    return {table: -1 if n is None else n for table, n in found.items()}


def periods_of_batch(spark: SparkSession, store: Store, batch: int, *, rebalance: str, rebalance_day: str) -> list[dt.date]:
    """Periods that a direct batch touches by what it holds now, before it is written again; a calendar bounds them."""
    if _marks(spark, store) is None:
        return []
    rows = _clean_rows(spark, store, "prices").filter(F.col("batch") == batch).drop("batch")
    ends = _read(spark, store, "index_ends", TICKER_ENDS)
    return [r[0] for r in index.touched_periods(rows, ends, rebalance=rebalance, rebalance_day=rebalance_day).collect()]


def within(periods: list[dt.date], date: Column, rebalance: str) -> Column:
    """Whether a date falls into one of the periods, as ranges that a scan of files can use."""
    months = MONTHS.get(rebalance, 3)
    ends = [_after(p, months) for p in periods]
    ranges: list[list[dt.date]] = []
    for start, end in sorted(zip(periods, ends)):
        if ranges and ranges[-1][1] == start:
            ranges[-1][1] = end
        else:
            ranges.append([start, end])
    inside = [(date >= F.lit(a)) & (date < F.lit(b)) for a, b in ranges]
    return reduce(lambda x, y: x | y, inside, F.lit(False))


def _after(start: dt.date, months: int) -> dt.date:
    month = start.month - 1 + months
    return dt.date(start.year + month // 12, month % 12 + 1, 1)


def _write(rows: DataFrame, store: Store, table: str, full: bool) -> None:
    """Replace the folders of the periods in `rows`, or the whole table."""
    (
        rows.hint("rebalance", "period")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if full else "dynamic")
        .partitionBy("period")
        .parquet(store.path(table))
    )


def update_indices(
    spark: SparkSession,
    store: Store,
    members: DataFrame,
    baselines: DataFrame,
    *,
    base_value: float = 100.0,
    base_date: dt.date | str | None = None,
    rebalance: str = "Q",
    rebalance_day: str = "flat",
    batch: int | None = None,
    rewritten: list[dt.date] | None = None,
    full: bool = False,
) -> list[dt.date] | None:
    """Bring the stored indices up to the stored prices; returns the periods built anew, None if all.

    Equal to a full build. `batch` is a direct batch just written, `rewritten` the periods
    it touched by what it held before. A store without days, other members, benchmarks or
    settings, prices that are gone from a whole period, or `full`, have all periods built.
    """
    options = {"base_date": str(base_date), "rebalance": rebalance, "rebalance_day": rebalance_day}
    settings = _settings(members, baselines, options)
    marks, last = _marks(spark, store), _last_batches(spark, store)
    full = full or marks is None or marks["settings"] != settings
    periods = None
    if not full:
        stored_ends = _read(spark, store, "index_ends", TICKER_ENDS)
        changed = changed_prices(spark, store, marks, batch)
        touched = index.touched_periods(changed, stored_ends, rebalance=rebalance, rebalance_day=rebalance_day)
        # As many as the calendar has periods.
        periods = sorted({r[0] for r in touched.collect()} | set(rewritten or []))
        if rewritten:
            start = period_start(F.col("date"), rebalance)
            there = prints(spark, store, quality.CLEAN).filter(within(periods, F.col("date"), rebalance))
            full = {r[0] for r in there.select(start).distinct().collect()} != set(periods)
    if full or periods:
        clean = prints(spark, store, quality.CLEAN)
        ends = None
        if not full:
            clean = clean.filter(within(periods, F.col("date"), rebalance))
            ends = stored_ends.filter(~F.col("period").isin(periods) & (F.col("period") < F.lit(max(periods))))
        # Kept by ticker: days, ends, weights and benchmarks all start from these rows, and their windows find them in place.
        prices = last_prints(clean, by=["ticker"]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            days = index.index_days(
                prices, members, base_date=base_date, rebalance=rebalance, rebalance_day=rebalance_day, ends=ends
            )
            weights = index.index_weights(prices, members, base_date=base_date, rebalance=rebalance)
            usable = (F.col("close") > 0) & (F.col("adj_close") > 0)
            bench = (
                prices.select("ticker", "date", known(F.col("close")).alias("close"), known(F.col("adj_close")).alias("adj_close"))
                .filter(usable)
                .join(baselines.select("index_id", "ticker"), "ticker")
            )
            _write(index.ticker_ends(prices, base_date=base_date, rebalance=rebalance, ends=ends), store, "index_ends", full)
            _write(days, store, "index_days", full)
            _write(weights.withColumn("period", period_start(F.col("rebalance_date"), rebalance)), store, "period_weights", full)
            _write(bench.withColumn("period", period_start(F.col("date"), rebalance)), store, "baseline_days", full)
        finally:
            prices.unpersist()
    if full or periods or marks["base_value"] != base_value:
        _chain(spark, store, baselines, base_value)
    row = (settings, float(base_value), last["prices"], last["landed_prices"])
    spark.createDataFrame([row], INDEX_MARKS).coalesce(1).write.mode("overwrite").parquet(store.path("index_marks"))
    return None if full else periods


def _chain(spark: SparkSession, store: Store, baselines: DataFrame, base_value: float) -> None:
    """Levels and weights of all indices from the stored days."""
    days = _read(spark, store, "index_days", INDEX_DAYS)
    own = index.index_levels(days, base_value=base_value).select("index_id", "date", "level_pr", "level_tr")
    held = _read(spark, store, "baseline_days", PERIOD_BASELINES)
    bench = index.baseline_index(held.select("ticker", "date", "close", "adj_close"), baselines, base_value=base_value)
    weights = _read(spark, store, "period_weights", PERIOD_WEIGHTS).drop("period")
    ids = days.select("index_id").unionByName(held.select("index_id")).distinct()
    replace_index(own.unionByName(bench), weights, store.path("index_values"), store.path("index_weights"), ids=ids)
