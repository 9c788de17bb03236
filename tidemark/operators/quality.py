"""Quarantine of bad prices, staleness and the health line."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions.numeric import usable_price
from tidemark.functions.periods import STALE_AFTER_DAYS, by_frequency

# The quarantine reasons.
BAD_CLOSE = "non-positive or null close"
BAD_ADJ_CLOSE = "non-positive or null adj_close"

CLEAN, REJECTED = "clean", "rejected"


def tag_prices(prices: DataFrame) -> DataFrame:
    """Add `reason`: NULL for a usable row, else what is wrong; close is named first."""
    reason = F.when(~usable_price(F.col("close")), F.lit(BAD_CLOSE)).when(
        ~usable_price(F.col("adj_close")), F.lit(BAD_ADJ_CLOSE)
    )
    return prices.withColumn("reason", reason)


def sanitize_prices(prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected); rejected rows carry their `reason`."""
    tagged = tag_prices(prices)
    clean = tagged.filter(F.col("reason").isNull()).drop("reason")
    return clean, tagged.filter(F.col("reason").isNotNull())


def price_status(tagged: DataFrame) -> DataFrame:
    """Add `status` to tagged prices, to store both kinds in one pass."""
    clean = F.col("reason").isNull()
    return tagged.withColumn("status", F.when(clean, F.lit(CLEAN)).otherwise(F.lit(REJECTED)))


def quarantine_summary(rejected: DataFrame, examples: int = 5) -> DataFrame:
    """Rejected rows per reason, with the first few tickers in name order.

    Tickers are ranked before they are gathered, so an array never holds more
    than `examples` of them.
    """
    per_ticker = rejected.groupBy("reason", "ticker").agg(F.count(F.lit(1)).alias("rows"))
    counts = per_ticker.groupBy("reason").agg(F.sum("rows").alias("rows"))
    first = Window.partitionBy("reason").orderBy("ticker")
    shown = (
        per_ticker.select("reason", "ticker")
        .withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= examples)
        .groupBy("reason")
        .agg(F.array_sort(F.collect_list("ticker")).alias("tickers"))
    )
    return counts.join(shown, "reason")


def staleness(meta: DataFrame, today: dt.date | str) -> DataFrame:
    """Add `stale`: no observation, or the last one older than its frequency allows."""
    age = F.datediff(F.lit(today).cast("date"), F.col("last_obs"))
    budget = by_frequency(F.col("frequency"), STALE_AFTER_DAYS, STALE_AFTER_DAYS["M"])
    return meta.withColumn("stale", F.coalesce(age > budget, F.lit(True)))


def health_summary(
    spark: SparkSession, meta: DataFrame, securities: DataFrame, index_values: DataFrame, prices: DataFrame
) -> DataFrame:
    """One row: how much is stored and how fresh it is."""
    n = F.count(F.lit(1))
    return spark.range(1).select(
        meta.select(n).scalar().alias("n_indicators"),
        securities.select(n).scalar().alias("n_securities"),
        index_values.select(F.countDistinct("index_id")).scalar().alias("n_indices"),
        meta.select(F.max("last_fetched")).scalar().alias("last_fetched"),
        prices.select(F.max("date")).scalar().alias("last_price"),
    )


def duplicate_keys(table: DataFrame, key: list[str]) -> DataFrame:
    """Keys held by more than one row, with their count."""
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def assert_unique_key(table: DataFrame, key: list[str]) -> DataFrame:
    """The table itself; raises if a key occurs twice."""
    if not duplicate_keys(table, key).isEmpty():
        raise ValueError(f"duplicate rows for key {key}")
    return table
