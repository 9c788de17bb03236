"""Incremental ingest: landed files to the observation store as a stream."""

from __future__ import annotations

import hashlib

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.readers import series_bounds
from tidemark.operators.writers import next_batch, read_batches, read_store, write_batch, write_prints
from tidemark.schemas import INGEST_STATS, META_KEY, OBSERVATION_KEY, OBSERVATIONS, RAW_LANDING
from tidemark.sources.landing import fetch_rank, last_landed, parse_prices, split_payload, tag_payload


MAX_FILES_PER_BATCH = 10_000


def landing_stream(spark: SparkSession, landing_path: str, *, max_files: int = MAX_FILES_PER_BATCH) -> DataFrame:
    """Landed pulls as a stream; a long backlog is taken up in batches of `max_files`."""
    return (
        spark.readStream.schema(RAW_LANDING)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .parquet(landing_path)
    )


def first_batch(spark: SparkSession, store_path: str, checkpoint_path: str) -> int:
    """The store batch of a stream's first micro-batch, fixed once for each checkpoint.

    A stream counts its micro-batches from 0 for every new checkpoint. It writes
    after what the store held when it began, so it replaces no batch of another
    stream, of a compaction or of a writer. The number is kept beside the batches,
    in a folder that readers skip.
    """
    origin = f"{store_path}/_origins/{hashlib.sha1(checkpoint_path.encode()).hexdigest()}"
    try:
        return spark.read.schema("first long").parquet(origin).first()[0]
    except (AnalysisException, TypeError):  # none yet, or not written to the end
        first = next_batch(spark, store_path)
        spark.range(1).select(F.lit(first).cast("long").alias("first")).write.mode("overwrite").parquet(origin)
        return first


def batch_stats(tagged: DataFrame, series: str = "series_id", entry: str = "pos") -> DataFrame:
    """What tagged rows hold of each series: usable entries, errors, first and last period."""
    usable = F.col("reason").isNull() & F.col(entry).isNotNull()
    return tagged.groupBy("source", F.col(series).alias("series_id")).agg(
        F.count(F.when(usable, True)).alias("entries"),
        F.count("reason").alias("errors"),
        F.min(F.when(usable, F.col("date"))).alias("first_obs"),
        F.max(F.when(usable, F.col("date"))).alias("last_obs"),
    )


def _store_batch(store_path: str, rejects_path: str, stats_path: str | None, first: int):
    def write(pulls: DataFrame, batch_id: int) -> None:
        number = first + batch_id
        # Kept for the writes, so that files are read and parsed once.
        tagged = tag_payload(pulls).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good, bad = split_payload(tagged)
            write_batch(last_landed(good), store_path, number)
            write_batch(bad, rejects_path, number)
            if stats_path is not None:
                write_batch(batch_stats(tagged), stats_path, number)
        finally:
            tagged.unpersist()

    return write


def incremental_ingest(
    spark: SparkSession,
    landing_path: str,
    store_path: str,
    rejects_path: str,
    checkpoint_path: str,
    *,
    stats_path: str | None = None,
    max_files: int = MAX_FILES_PER_BATCH,
):
    """Take up every landed file not seen yet, then stop. Returns the finished query.

    With `stats_path` each micro-batch also writes what it held of each series, from
    the rows it has parsed anyway; `ingest_stats` adds them up.

    Each micro-batch writes its own batch folder, numbered from `first_batch` on, so
    a batch repeated after a failure replaces itself. Late data is just another
    vintage, and no watermark is needed.
    """
    first = first_batch(spark, store_path, checkpoint_path)
    write = _store_batch(store_path, rejects_path, stats_path, first)
    return _take_up(landing_stream(spark, landing_path, max_files=max_files), write, checkpoint_path)


def _take_up(pulls: DataFrame, write, checkpoint_path: str):
    query = (
        pulls.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def incremental_prices(
    spark: SparkSession,
    landing_path: str,
    prints_path: str,
    checkpoint_path: str,
    *,
    stats_path: str | None = None,
    max_files: int = MAX_FILES_PER_BATCH,
):
    """Take up every landed pull of prices not seen yet, then stop. Returns the finished query.

    Clean and rejected prices of a micro-batch go to its own batch folder. Which of
    several prices of a day stands follows from their fetch times, so pulls that
    land late do no harm, and a store built anew from the landed files is the same.
    """
    first = first_batch(spark, prints_path, checkpoint_path)

    def write(pulls: DataFrame, batch_id: int) -> None:
        # Parsed once for each write: reading landed files again costs less than keeping all rows with their texts.
        tagged = parse_prices(pulls)
        write_prints(tagged, prints_path, first + batch_id, seq=fetch_rank())
        if stats_path is not None:
            write_batch(batch_stats(tagged, "ticker"), stats_path, first + batch_id)

    return _take_up(landing_stream(spark, landing_path, max_files=max_files), write, checkpoint_path)


def ingest_stats(spark: SparkSession, stats_path: str) -> DataFrame:
    """Per series what all batches held: entries taken up, errors, first and last period. The store is not read."""
    return (
        read_batches(spark, stats_path, INGEST_STATS)
        .groupBy(*META_KEY)
        .agg(
            F.sum("entries").alias("entries"),
            F.sum("errors").alias("errors"),
            F.min("first_obs").alias("first_obs"),
            F.max("last_obs").alias("last_obs"),
        )
    )


def stored_observations(spark: SparkSession, store_path: str) -> DataFrame:
    return read_store(spark, store_path, OBSERVATIONS, OBSERVATION_KEY)


def stored_bounds(spark: SparkSession, store_path: str) -> DataFrame:
    """First and last stored period per series: the catalogue statistics."""
    return series_bounds(stored_observations(spark, store_path))
