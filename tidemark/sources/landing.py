"""Immutable landing of raw pulls, and their replay into observations."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.numeric import known
from tidemark.functions.text import path_slug
from tidemark.operators.quality import price_status, tag_prices
from tidemark.operators.writers import last_per_key
from tidemark.schemas import PAYLOAD, PRICE_KEY, PRICE_PAYLOAD, RAW_LANDING

FOLDERS = ("source_dir", "series_dir", "fetch_day")

# How a payload writes "no value".
MISSING_MARKS = (".", "")
UNREADABLE, BAD_DATE, BAD_VALUE = "unreadable payload", "bad date", "bad value"


def land_raw(pulls: DataFrame, path: str, *, by_series: bool = False) -> None:
    """Append pulls below `path`, in one folder per source and fetch day.

    `pulls` is (source, series_id, fetched_at, payload) with the payload as a
    JSON string or as a struct to serialise. `by_series` adds a folder level per
    series; leave it off for large numbers of series, where it makes tiny files.
    Folder names are made safe, the names in the rows stay as they are.
    """
    payload = F.col("payload")
    if pulls.schema["payload"].dataType.typeName() != "string":
        payload = F.to_json(payload)
    rows = pulls.select(
        "source", "series_id", "fetched_at", payload.alias("payload"),
        path_slug(F.col("source")).alias("source_dir"),
        path_slug(F.col("series_id")).alias("series_dir"),
        F.date_format("fetched_at", "yyyy-MM-dd").alias("fetch_day"),
    )
    folders = ["source_dir", "series_dir", "fetch_day"] if by_series else ["source_dir", "fetch_day"]
    rows = rows if by_series else rows.drop("series_dir")
    # Gathered by folder, so that a folder gets few files, and split again where one is large.
    rows.hint("rebalance", *folders).write.mode("append").partitionBy(*folders).parquet(path)


def read_landing(
    spark: SparkSession,
    path: str,
    *,
    source: str | None = None,
    since: dt.date | str | None = None,
    until: dt.date | str | None = None,
) -> DataFrame:
    """Landed pulls, all or those of one source and of fetch days from `since` to `until`.

    The choice is made on folder names, so other folders are not read.
    """
    layout = T.StructType([*RAW_LANDING.fields, *[T.StructField(c, T.StringType()) for c in FOLDERS]])
    rows = spark.read.schema(layout).parquet(path)
    if source is not None:
        rows = rows.filter((F.col("source_dir") == path_slug(F.lit(source))) & (F.col("source") == source))
    if since is not None:
        rows = rows.filter(F.col("fetch_day") >= str(since))
    if until is not None:
        rows = rows.filter(F.col("fetch_day") <= str(until))
    return rows.select(*RAW_LANDING.names)


def parse_payload(pulls: DataFrame) -> DataFrame:
    """One row per observation with the value's text and its parsed forms."""
    text = F.col("obs.value")
    parsed = pulls.select(
        "source",
        "series_id",
        "fetched_at",
        F.to_date("fetched_at").alias("as_of"),
        "payload",
        F.from_json("payload", PAYLOAD).alias("doc"),
    )
    listed = F.col("doc.observations")
    rows = parsed.select(
        "source", "series_id", "fetched_at", "as_of",
        _unreadable(listed, "observations").alias("unreadable"),
        F.posexplode_outer(listed).alias("pos", "obs"),
    )
    return rows.select(
        "source", "series_id", "fetched_at", "as_of", "pos", "unreadable",
        F.col("obs.date").alias("date_text"),
        F.col("obs.date").try_cast("date").alias("date"),
        text.alias("value_text"),
        (text.isNull() | text.isin(*MISSING_MARKS)).alias("marked"),
        text.try_cast("double").alias("number"),
    ).withColumn("value", F.when(~F.col("marked"), known(F.col("number"))))


def _unreadable(listed: Column, name: str) -> Column:
    """A document without the list is empty; one that is no document, or whose list is no list, is unreadable."""
    broken = F.coalesce(F.array_contains(F.json_object_keys("payload"), name), F.lit(True))
    return F.when(listed.isNull(), broken).otherwise(F.lit(False))


def _why_rejected() -> Column:
    entry = F.col("pos").isNotNull()
    return (
        F.when(F.col("unreadable"), F.lit(UNREADABLE))
        .when(entry & F.col("date").isNull(), F.lit(BAD_DATE))
        .when(entry & ~F.col("marked") & F.col("number").isNull(), F.lit(BAD_VALUE))
    )


def tag_payload(pulls: DataFrame) -> DataFrame:
    """Parsed observations with `reason`: NULL where readable."""
    return parse_payload(pulls).withColumn("reason", _why_rejected())


def split_payload(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, rejects) of tagged rows."""
    good = tagged.filter(F.col("reason").isNull() & F.col("pos").isNotNull()).select(
        "source", "series_id", "date", "as_of", "value", F.lit(True).alias("as_of_is_fetch"),
        "fetched_at", "pos",
    )
    bad = tagged.filter(F.col("reason").isNotNull()).select(
        "source", "series_id", "fetched_at", "date_text", "value_text", "reason"
    )
    return good, bad


def normalize_payload(pulls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, rejects) of landed pulls.

    The fetch day is the vintage. "." and "" and null are missing values; any
    other text that is no number goes to `rejects` with its reason.
    """
    return split_payload(tag_payload(pulls))


def last_landed(good: DataFrame) -> DataFrame:
    """One value per vintage: the later pull of a day wins, then the later entry."""
    return good.groupBy("source", "series_id", "date", "as_of").agg(
        F.max_by("value", F.struct("fetched_at", "pos")).alias("value")
    )


def replay_landing(pulls: DataFrame) -> DataFrame:
    """Rebuild the observations from every landed pull."""
    return last_landed(normalize_payload(pulls)[0])


def reject_counts(rejects: DataFrame) -> DataFrame:
    """Errors per series and reason."""
    return rejects.groupBy("source", "series_id", "reason").agg(F.count(F.lit(1)).alias("rows"))


def price_pulls(prints: DataFrame, *, source: str, seq: Column | str, fetched_at: Column | str = "fetched_at") -> DataFrame:
    """Price rows as pulls to land: one document per ticker and fetch time, its prices in the order of `seq`.

    `prints` is (ticker, date, close, adj_close, shares_out); values are sent as they are, text included.
    """
    entry = F.struct("date", "close", "adj_close", "shares_out")
    # sort_array compares natively; array_sort would interpret a lambda for every pair of entries.
    in_order = F.sort_array(F.collect_list(F.struct(F.expr(seq).alias("n") if isinstance(seq, str) else seq.alias("n"), entry.alias("e"))))
    when = F.col(fetched_at) if isinstance(fetched_at, str) else fetched_at
    # Documents are gathered whole, so lists begun before the shuffle would only be copied once more.
    return (
        prints.withColumn("fetched_at", when.cast("timestamp"))
        .repartition("ticker", "fetched_at")
        .groupBy("ticker", "fetched_at")
        .agg(in_order.getField("e").alias("prices"))
        .select(
            F.lit(source).alias("source"), F.col("ticker").alias("series_id"), "fetched_at",
            F.to_json(F.struct("prices")).alias("payload"),
        )
    )


def parse_prices(pulls: DataFrame) -> DataFrame:
    """One row per landed price with `reason`, NULL where usable: (ticker, date, close, adj_close, shares_out as text, ...).

    What makes a pull or a date unusable is named before what the quarantine finds
    wrong with the prices. A document that holds no price gives no row.
    """
    listed = F.col("doc.prices")
    rows = (
        pulls.select("source", "series_id", "fetched_at", "payload", F.from_json("payload", PRICE_PAYLOAD).alias("doc"))
        .select(
            "source", "series_id", "fetched_at", _unreadable(listed, "prices").alias("unreadable"),
            F.posexplode_outer(listed).alias("pos", "p"),
        )
        .filter(F.col("unreadable") | F.col("pos").isNotNull())
        .select(
            "source", F.col("series_id").alias("ticker"), "fetched_at", "pos", "unreadable",
            F.col("p.date").alias("date_text"), F.col("p.date").try_cast("date").alias("date"),
            *[F.col(f"p.{c}").alias(c) for c in ("close", "adj_close", "shares_out")],
        )
    )
    own = F.when(F.col("unreadable"), F.lit(UNREADABLE)).when(F.col("date").isNull(), F.lit(BAD_DATE))
    return price_status(tag_prices(rows).withColumn("reason", F.coalesce(own, F.col("reason")))).drop("unreadable")


def fetch_rank() -> Column:
    """Orders landed prices by fetch time, then by entry; one decimal hashes where a struct would sort."""
    micros = F.coalesce(F.unix_micros("fetched_at"), F.lit(-(2**63))).cast("decimal(38,0)")
    return micros * F.lit(Decimal(2**32)) + F.coalesce("pos", F.lit(0)).cast("decimal(20,0)")


def replay_prices(pulls: DataFrame) -> DataFrame:
    """Rebuild the prices from every landed pull: of a ticker's usable prices of a day the last one fetched."""
    usable = parse_prices(pulls).filter(F.col("reason").isNull())
    numbers = [F.col(c).try_cast("double").alias(c) for c in ("close", "adj_close", "shares_out")]
    return last_per_key(usable.select("ticker", "date", *numbers, fetch_rank().alias("_rank")), PRICE_KEY, "_rank")
