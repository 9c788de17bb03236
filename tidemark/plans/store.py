"""One store's tables: where they live and how they are read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import quality
from tidemark.operators.writers import last_prints, read_batches, read_store
from tidemark.schemas import META_KEY, PRICE_PRINTS, SECURITIES, SECURITY_KEY, SERIES_META


@dataclass(frozen=True)
class Store:
    """Where the tables of one store live, all below `root`."""

    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"


def prints(spark: SparkSession, store: Store, status: str) -> DataFrame:
    """Price rows of one status: those written by hand and those taken up from landed pulls."""
    direct, landed = (read_batches(spark, store.path(t), PRICE_PRINTS) for t in ("prices", "landed_prices"))
    return direct.unionByName(landed).filter(F.col("status") == status)


def stored_prices(spark: SparkSession, store: Store) -> DataFrame:
    return last_prints(prints(spark, store, quality.CLEAN))


def rejected_prices(spark: SparkSession, store: Store) -> DataFrame:
    return prints(spark, store, quality.REJECTED)


def stored_securities(spark: SparkSession, store: Store) -> DataFrame:
    return read_store(spark, store.path("securities"), SECURITIES, SECURITY_KEY)


def stored_series_meta(spark: SparkSession, store: Store) -> DataFrame:
    return read_store(spark, store.path("series_meta"), SERIES_META, META_KEY)
