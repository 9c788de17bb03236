"""One refresh: landed pulls and price prints to observations, prices and indices."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import quality
from tidemark.operators.universe import index_members
from tidemark.operators.writers import (
    compact,
    next_batch,
    read_batches,
    read_index_values,
    read_index_weights,
    upsert_securities,
    upsert_series_meta,
    write_batch,
    write_prints,
)
from tidemark.plans.index_store import PRICE_TABLES, periods_of_batch, update_indices
from tidemark.plans.store import Store, rejected_prices, stored_prices, stored_securities, stored_series_meta
from tidemark.schemas import (
    INGEST_STATS,
    META_KEY,
    OBSERVATION_KEY,
    OBSERVATION_REJECTS,
    OBSERVATIONS,
    PRICE_KEY,
    PRICE_PRINTS,
    SECURITIES,
    SECURITY_KEY,
    SERIES_META,
)
from tidemark.streaming.ingest import (
    incremental_ingest,
    incremental_prices,
    ingest_stats,
    stored_bounds,
    stored_observations,
)


def ingest_prices(store: Store, prices: DataFrame, batch: int, *, seq: str | None = None) -> None:
    """Store clean and rejected rows side by side, in one pass over the prices.

    See `writers.write_prints`. Rows without a fetch time count as fetched now.
    """
    rows = quality.price_status(quality.tag_prices(prices))
    if "fetched_at" not in rows.columns:
        rows = rows.withColumn("fetched_at", F.current_timestamp())
    write_prints(rows, store.path("prices"), batch, seq=seq)

def refresh(
    spark: SparkSession,
    store: Store,
    *,
    landing_path: str | None,
    prices: DataFrame | None = None,
    securities: DataFrame | None = None,
    baselines: DataFrame,
    batch: int,
    prefix: str,
    price_landing_path: str | None = None,
    specs: DataFrame | None = None,
    price_seq: str | None = None,
    fetched_at: str | None = None,
    base_value: float = 100.0,
    base_date: dt.date | str | None = None,
    rebalance: str = "Q",
    rebalance_day: str = "flat",
    full: bool = False,
) -> DataFrame:
    """Run every step and report (step, rows, errors, error).

    A bad payload or price row is counted as an error of its step and stops
    nothing else. A step that fails as a whole is reported with its error; the
    steps after it work on what is stored. Inputs that are None leave what is
    stored as it is. Prices come as a frame, or as landed pulls below
    `price_landing_path`, or both. The catalogue of `specs` is stored with the first
    and last period of each series, which the ingest keeps count of; `series_errors`
    tells the errors of each series. Indices are built anew for the periods that new
    prices touch; `full` builds all, as other members or settings do. Rebuilt indices are read back from the store, so their
    reports do not compute them again.
    """
    failed: dict[str, str] = {}

    def attempt(step: str, action) -> None:
        try:
            action()
        except Exception as error:  # noqa: BLE001  one bad source must not stop the others
            failed[step] = f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"[:500]

    def observations() -> None:
        incremental_ingest(
            spark, landing_path, store.path("observations"), store.path("observation_rejects"), store.path("_progress"),
            stats_path=store.path("ingest_stats"),
        )

    def landed_prices() -> None:
        incremental_prices(
            spark, price_landing_path, store.path("landed_prices"), store.path("_price_progress"),
            stats_path=store.path("price_stats"),
        )

    def catalogue() -> None:
        bounds = _bounds(spark, store)
        rows = upsert_series_meta(stored_series_meta(spark, store).limit(0), specs, bounds, fetched_at=fetched_at)
        write_batch(rows, store.path("series_meta"), batch)

    def names() -> None:
        rows = upsert_securities(spark.createDataFrame([], SECURITIES), _with_columns(securities, SECURITIES))
        write_batch(rows, store.path("securities"), batch)

    def indices() -> None:
        update_indices(
            spark, store, index_members(stored_securities(spark, store), prefix), baselines, base_value=base_value,
            base_date=base_date, rebalance=rebalance, rebalance_day=rebalance_day, batch=batch, rewritten=rewritten, full=full,
        )

    if landing_path is not None:
        attempt("observations", observations)
    if specs is not None:
        attempt("series_meta", catalogue)
    if securities is not None:
        attempt("securities", names)
    rewritten: list[dt.date] = []
    if prices is not None:
        # What a batch that is written again held so far is about to go.
        rewritten = periods_of_batch(spark, store, batch, rebalance=rebalance, rebalance_day=rebalance_day)
        attempt("prices", lambda: ingest_prices(store, prices, batch, seq=price_seq))
    if price_landing_path is not None:
        attempt("prices", landed_prices)
    attempt("indices", indices)

    n = F.count(F.lit(1))
    zero = F.lit(0).cast("bigint")

    def count(step: str, rows: DataFrame, errors: DataFrame | None = None, of: str | None = None) -> DataFrame:
        counted = rows.select(n.alias("rows"), zero.alias("errors"))
        if errors is not None:
            counted = counted.unionByName(errors.select(zero.alias("rows"), n.alias("errors")))
        why = failed.get(of or step)
        return counted.agg(F.sum("rows").alias("rows"), F.sum("errors").alias("errors")).select(
            F.lit(step).alias("step"),
            "rows",
            (F.col("errors") + F.lit(0 if why is None else 1)).alias("errors"),
            F.lit(why).cast("string").alias("error"),
        )

    def indexed(step: str, read) -> DataFrame:
        try:
            return count(step, read(spark, store.path(step)), of="indices")
        except AnalysisException:  # no index has been stored yet
            return count(step, spark.range(0), of="indices")

    rejects = read_batches(spark, store.path("observation_rejects"), OBSERVATION_REJECTS)
    return (
        count("observations", stored_observations(spark, store.path("observations")), rejects)
        .unionByName(count("series_meta", stored_series_meta(spark, store)))
        .unionByName(count("securities", stored_securities(spark, store)))
        .unionByName(count("prices", stored_prices(spark, store), rejected_prices(spark, store)))
        .unionByName(indexed("index_values", read_index_values))
        .unionByName(indexed("index_weights", read_index_weights))
    )


def _bounds(spark: SparkSession, store: Store) -> DataFrame:
    """First and last period of each series, from the ingest's own count, or the store where it is older than the count."""
    counted = ingest_stats(spark, store.path("ingest_stats")).filter(F.col("entries") > 0)
    if counted.isEmpty():
        return stored_bounds(spark, store.path("observations"))
    return counted.select(*META_KEY, "first_obs", "last_obs")


def series_errors(spark: SparkSession, store: Store) -> DataFrame:
    """Entries taken up and errors of each series and ticker that came by landed pulls: (source, series_id, entries, errors)."""
    counted = [ingest_stats(spark, store.path(t)).drop("first_obs", "last_obs") for t in ("ingest_stats", "price_stats")]
    return counted[0].unionByName(counted[1])


def _with_columns(rows: DataFrame, schema) -> DataFrame:
    """The schema's columns, NULL where the rows have none."""
    return rows.select(
        *[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    )


def compact_store(spark: SparkSession, store: Store, target: Store) -> None:
    """Fold every keyed table into one batch of a new store; indices are rebuilt there by the next refresh."""
    compact(spark, store.path("observations"), target.path("observations"), OBSERVATIONS, OBSERVATION_KEY)
    compact(spark, store.path("series_meta"), target.path("series_meta"), SERIES_META, META_KEY)
    compact(spark, store.path("securities"), target.path("securities"), SECURITIES, SECURITY_KEY)
    for table in PRICE_TABLES:
        _fold_prints(spark, store.path(table), target.path(table))
    last = max(0, next_batch(spark, store.path("observation_rejects")) - 1)
    rejects = read_batches(spark, store.path("observation_rejects"), OBSERVATION_REJECTS).drop("batch")
    write_batch(rejects, target.path("observation_rejects"), last)
    for stats in ("ingest_stats", "price_stats"):
        counted = ingest_stats(spark, store.path(stats)).select(*INGEST_STATS.names)
        write_batch(counted, target.path(stats), max(0, next_batch(spark, store.path(stats)) - 1))


def _fold_prints(spark: SparkSession, path: str, target: str) -> None:
    """Fold price batches into one: standing prices with their last fetch time, and all rejected rows."""
    rows = read_batches(spark, path, PRICE_PRINTS)
    clean = rows.filter(F.col("status") == quality.CLEAN)
    values = [c for c in PRICE_PRINTS.names if c not in PRICE_KEY]
    rank = F.struct("fetched_at", "batch")
    standing = clean.groupBy(*PRICE_KEY).agg(*[F.max_by(c, rank).alias(c) for c in values])
    rejected = rows.filter(F.col("status") == quality.REJECTED)
    folded = standing.select(*PRICE_PRINTS.names).unionByName(rejected.select(*PRICE_PRINTS.names))
    write_batch(folded, target, max(0, next_batch(spark, path) - 1), parts=["status"])
