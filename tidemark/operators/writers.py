"""Keyed, idempotent writes on plain Parquet.

A store is a folder of immutable batches, `batch=<number>/`. A write adds or
replaces its own batch folder and touches no other file, so a retried or
repeated write changes nothing, and a reader never loses a file under its feet.
The last batch wins per key; that is settled when reading, in an aggregate that
combines before the shuffle. `compact` folds the batches into a new folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.operators.quality import REJECTED, assert_unique_key
from tidemark.schemas import (
    INDEX_VALUES,
    INDEX_WEIGHTS,
    META_KEY,
    OBSERVATION_KEY,
    PRICE_KEY,
    PRICE_PRINTS,
    PRICES,
    SECURITY_KEY,
)

OLDEST = -(2**63)
_TEXTS = ("date_text", "close_text", "adj_close_text", "reason")


def last_per_key(rows: DataFrame, key: list[str], order: str, *, by: Sequence[str] = ()) -> DataFrame:
    """The row with the greatest `order` for every key; `order` itself is dropped.

    `by` (columns of the key) says that few rows share a key. Combining before the shuffle
    then only fills a task's memory, so rows move first, and lie by these columns after.
    """
    rows = rows.repartition(*by) if by else rows
    values = [c for c in rows.columns if c not in (*key, order)]
    return rows.groupBy(*key).agg(*[F.max_by(c, order).alias(c) for c in values])


def upsert(existing: DataFrame, batch: DataFrame, key: list[str], *, seq: str | None = None) -> DataFrame:
    """Batch rows replace existing rows of their key, the rest stays.

    `seq` orders duplicates inside the batch, the greatest wins; without it the
    batch must be unique by key.
    """
    old = existing.withColumn("_seq", F.lit(OLDEST))
    new = batch.select(*existing.columns, F.col(seq).cast("bigint").alias("_seq") if seq else F.lit(0).alias("_seq"))
    return last_per_key(old.unionByName(new), key, "_seq").select(*existing.columns)


def upsert_observations(existing: DataFrame, batch: DataFrame, *, seq: str | None = None) -> DataFrame:
    """Older vintages stay; the same vintage written again is replaced."""
    return upsert(existing, batch, OBSERVATION_KEY, seq=seq)


def upsert_prices(existing: DataFrame, batch: DataFrame, *, seq: str | None = None) -> DataFrame:
    return upsert(existing, batch, PRICE_KEY, seq=seq)


def upsert_securities(existing: DataFrame, batch: DataFrame, *, seq: str | None = None) -> DataFrame:
    """Membership dates may arrive as text; empty text means open."""
    typed = batch.withColumns(
        {c: F.nullif(F.col(c).cast("string"), F.lit("")).cast("date") for c in ("from_date", "to_date")}
    )
    return upsert(existing, typed, SECURITY_KEY, seq=seq)


def upsert_series_meta(existing: DataFrame, specs: DataFrame, bounds: DataFrame, *, fetched_at=None) -> DataFrame:
    """Refresh the catalogue rows of `specs` with first/last period and fetch time."""
    when = F.current_timestamp() if fetched_at is None else F.lit(fetched_at).cast("timestamp")
    notes = F.col("notes") if "notes" in specs.columns else F.lit(None).cast("string")
    batch = (
        specs.withColumn("notes", notes)
        .join(bounds, META_KEY, "left")
        .withColumn("last_fetched", when)
        .select(*existing.columns)
    )
    return upsert(existing, batch, META_KEY)


def write_batch(
    rows: DataFrame,
    path: str,
    batch: int,
    *,
    parts: Sequence[str] = (),
    key: list[str] | None = None,
    seq: str | None = None,
) -> None:
    """Write one batch of a store; writing the same number again replaces all of it.

    With `key` the batch holds each key once: `seq` says which of several rows
    came last, and without it a key that occurs twice is an error. So no read has
    to choose between rows of one batch.
    """
    if key is not None:
        rows = assert_unique_key(rows, key) if seq is None else last_per_key(rows, key, seq)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy(*parts).parquet(f"{path}/batch={batch}")


def write_prints(tagged: DataFrame, path: str, batch: int, *, seq: str | Column | None = None) -> None:
    """Write price rows with `reason` and `status` as one batch, clean and rejected side by side, in one pass.

    Prices may come as text. Clean rows are stored as numbers, rejected ones keep
    the text that was sent. Of several clean rows of one ticker and day the one with
    the greatest `seq` is kept; without `seq` there must be one. `fetched_at` is NULL
    where the rows have none.
    """
    rejected = F.col("status") == REJECTED

    def text(c: str) -> Column:
        return F.when(rejected, F.col(c).cast("string"))

    given = set(tagged.columns)
    typed = tagged.select(
        "ticker",
        F.col("date").cast("date").alias("date"),
        *[F.col(c).try_cast("double").alias(c) for c in ("close", "adj_close", "shares_out")],
        text("date_text" if "date_text" in given else "date").alias("date_text"),
        text("close").alias("close_text"),
        text("adj_close").alias("adj_close_text"),
        (F.col("fetched_at") if "fetched_at" in given else F.lit(None)).cast("timestamp").alias("fetched_at"),
        "reason",
        "status",
        *([(F.col(seq) if isinstance(seq, str) else seq).alias("_seq")] if seq is not None else []),
    )
    if seq is None:
        # Kept for the check and the write, so that the prices are worked out once.
        typed = typed.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            assert_unique_key(typed.filter(F.col("status") != REJECTED), PRICE_KEY)
            write_batch(typed, path, batch, parts=["status"])
        finally:
            typed.unpersist()
        return
    # A rejected row is a key of its own, so that one aggregate settles the clean ones and keeps all others.
    one = F.when(rejected, F.monotonically_increasing_id())
    # Clean rows have no texts, so these can be keys; only numbers and times are chosen, which hash by a plain `seq`.
    settled = last_per_key(typed.withColumn("_row", one), [*PRICE_KEY, "status", "_row", *_TEXTS], "_seq").drop("_row")
    write_batch(settled.select(*PRICE_PRINTS.names), path, batch, parts=["status"])


def last_prints(rows: DataFrame, *, by: Sequence[str] = PRICE_KEY) -> DataFrame:
    """The standing price of every ticker and day: the last one fetched, of those the last one written.

    A key is held once by each batch. The result lies by the columns `by`.
    """
    # One decimal orders by fetch time, then by batch; it hashes where a struct would sort.
    micros = F.coalesce(F.unix_micros("fetched_at"), F.lit(0)).cast("decimal(38,0)")
    rank = micros * F.lit(Decimal(2**64)) + F.col("batch").cast("decimal(20,0)")
    return last_per_key(rows.select(*PRICES.names, rank.alias("_rank")), PRICE_KEY, "_rank", by=by)


def next_batch(spark: SparkSession, path: str) -> int:
    """The number after the last batch of a store, 0 for an empty one."""
    numbers = read_batches(spark, path, T.StructType([])).agg(F.max("batch")).first()[0]
    return 0 if numbers is None else numbers + 1


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every row of every batch with its batch number; a store not begun yet is empty."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def read_store(spark: SparkSession, path: str, schema: T.StructType, key: list[str]) -> DataFrame:
    """All batches of a store, the last write per key."""
    return last_per_key(read_batches(spark, path, schema), key, "batch", by=key).select(*schema.names)


def compact(spark: SparkSession, path: str, target: str, schema: T.StructType, key: list[str]) -> None:
    """Fold a store into one batch of a new store folder; the old one stays untouched.

    The batch has the number of the last one folded, so whoever writes on, by
    `next_batch` or by a stream that had written before, comes after it and
    replaces none of it.
    """
    write_batch(read_store(spark, path, schema, key), target, max(0, next_batch(spark, path) - 1))


def replace_index(
    levels: DataFrame, weights: DataFrame, values_path: str, weights_path: str, *, ids: DataFrame | None = None
) -> None:
    """Replace the stored values and weights of exactly the index ids in `levels`.

    Both tables are partitioned by index_id and only the partitions written are
    overwritten. An index with levels but no weights must lose its old weights:
    every partition is written with one row without ticker, which readers skip.
    The rebalance hint gathers an index into few files and splits a large one.
    `ids` names the ids in `levels`, one row each, if that is known more cheaply
    than by building the levels once more.
    """
    ids = levels.select("index_id").distinct() if ids is None else ids.select("index_id")
    all_weights = weights.unionByName(ids, allowMissingColumns=True)
    for rows, path in ((levels, values_path), (all_weights, weights_path)):
        (
            rows.hint("rebalance", "index_id")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("index_id")
            .parquet(path)
        )


def read_index_values(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_VALUES).parquet(path)


def read_index_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_WEIGHTS).parquet(path).filter(F.col("ticker").isNotNull())
