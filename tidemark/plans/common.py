"""Inputs and output helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tidemark.functions.text import index_name
from tidemark.operators import forecast, index, readers, reports, signals, universe, writers
from tidemark.schemas import SERIES_META
from tidemark.sources import driver_tables as tables

BASE_DATE = "1995-01-01"
FETCHED_AT = "2002-01-01 00:00:00"
MARKET = tables.INDEX_PREFIX


def r(col: Column | str, digits: int = 6) -> Column:
    return F.round(col, digits)


def sig(col: Column | str) -> Column:
    """Keep the leading seven digits of a double of any size."""
    return (F.col(col) if isinstance(col, str) else col).cast("float").cast("double")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.index_members(tables.securities(spark, sf_dir), MARKET)


def index_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = index.index_levels_chain(tables.prices(spark, sf_dir), members(spark, sf_dir), base_date=BASE_DATE)
    return chain.select("index_id", "date", "level_pr", "level_tr")


def index_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_weights(tables.prices(spark, sf_dir), members(spark, sf_dir), base_date=BASE_DATE)


def total_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total-return levels as (index_id, date, value)."""
    return index_levels(spark, sf_dir).select("index_id", "date", F.col("level_tr").alias("value"))


def adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted closes as (ticker, date, value)."""
    return tables.prices(spark, sf_dir).select("ticker", "date", F.col("adj_close").alias("value"))


def series_ids(spark: SparkSession, sf_dir: str) -> list[str]:
    """The catalogue's series, which become columns."""
    specs = tables.series_specs(spark, sf_dir).select("series_id").distinct().orderBy("series_id")
    return [row.series_id for row in specs.collect()]


def long_form(rows: DataFrame, keys: list[str], name: str, value: str = "value") -> DataFrame:
    """Columns other than the keys as rows, rounded."""
    columns = [c for c in rows.columns if c not in keys]
    return rows.unpivot(keys, columns, name, value).withColumn(value, r(value))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.current_series(tables.observations(spark, sf_dir))


def series_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.upsert_series_meta(
        spark.createDataFrame([], SERIES_META),
        universe.series_metadata(tables.series_specs(spark, sf_dir)),
        readers.series_bounds(tables.observations(spark, sf_dir)),
        fetched_at=FETCHED_AT,
    )


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest_weights(index_weights(spark, sf_dir), tables.securities(spark, sf_dir))


def sector_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, index_id): the index of each security's own sub-sector."""
    return tables.securities(spark, sf_dir).select(
        "ticker", index_name(MARKET, F.col("subsector")).alias("index_id")
    )


def features(
    spark: SparkSession, sf_dir: str, only: DataFrame | None = None, ledger: Observation | None = None
) -> DataFrame:
    """The design matrix of all tickers, or of those named in `only`."""
    own = adjusted(spark, sf_dir)
    return forecast.arx_features(
        own if only is None else own.join(only.select("ticker"), "ticker", "left_semi"),
        exog=forecast.exog_panel(current(spark, sf_dir)),
        exog_ids=series_ids(spark, sf_dir),
        levels=total_return(spark, sf_dir),
        sectors=sector_of(spark, sf_dir),
        market_id=MARKET,
        ledger=ledger,
    )


def stock_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.monthly_returns(adjusted(spark, sf_dir), keys=["ticker"])
