"""Universe membership, index naming and tagged-record lookups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import contains_any, index_name
from tidemark.operators.skew import spread_join


def universe_members(securities: DataFrame, subsector: str | None = None) -> DataFrame:
    """All members, or those of one sub-sector."""
    return securities if subsector is None else securities.filter(F.col("subsector") == subsector)


def index_members(securities: DataFrame, prefix: str) -> DataFrame:
    """(index_id, ticker, from_date, to_date): whole universe plus one index per sub-sector.

    Each security is copied in place to its own two indices, so there is no
    join and no second scan.
    """
    ids = F.array_compact(F.array(index_name(prefix), index_name(prefix, F.col("subsector"))))
    return securities.select(F.explode(ids).alias("index_id"), "ticker", "from_date", "to_date")


def is_member(day: Column, from_date: Column, to_date: Column) -> Column:
    """from_date <= day <= to_date, both inclusive; a missing bound is open."""
    after = F.coalesce(day >= from_date, F.lit(True))
    return after & F.coalesce(day <= to_date, F.lit(True))


def eligible_members(members: DataFrame, rebalances: DataFrame) -> DataFrame:
    """Members on each rebalance date of their index: (index_id, rebalance_date, ticker).

    The dates of an index fit one short array (a few per year), so each member
    row expands to its own dates and members are never paired with each other.
    The members of a large index are dealt out over several tasks.
    """
    dates = rebalances.groupBy("index_id").agg(F.collect_set("rebalance_date").alias("dates"))
    # A member's spells in one row, so that unfolding its dates repeats none of them.
    spells = members.groupBy("index_id", "ticker").agg(F.collect_set(F.struct("from_date", "to_date")).alias("spells"))
    inside = F.filter("dates", lambda d: F.exists("spells", lambda s: is_member(d, s["from_date"], s["to_date"])))
    return spread_join(spells, dates, "index_id", by="ticker").select(
        "index_id", F.explode(inside).alias("rebalance_date"), "ticker"
    )


def ticker_list(*frames: DataFrame) -> DataFrame:
    """Distinct tickers of several tables, sorted."""
    out = frames[0].select("ticker")
    for frame in frames[1:]:
        out = out.unionByName(frame.select("ticker"))
    return out.distinct().orderBy("ticker")


def series_metadata(specs: DataFrame) -> DataFrame:
    """Fill the defaults of declared series: the name is the id, the frequency monthly."""
    return specs.select(
        "source",
        "series_id",
        F.coalesce("metric_name", "series_id").alias("metric_name"),
        F.coalesce("frequency", F.lit("M")).alias("frequency"),
        "unit",
        "subsector",
    )


def records_by_rank(records: DataFrame) -> DataFrame:
    return records.orderBy("rank")


def record_by_slug(records: DataFrame, slug: str) -> DataFrame:
    """The record with this slug; an unknown slug raises KeyError."""
    found = records.filter(F.col("slug") == slug)
    if found.isEmpty():
        raise KeyError(f"unknown slug: {slug}")
    return found


def tag_filter(records: DataFrame, terms: Iterable[str], *, tags: str = "focus") -> DataFrame:
    """Records whose tags contain any of the terms, by rank; no terms keep all."""
    return records.filter(contains_any(F.col(tags), terms)).orderBy("rank")


def _grams(text: Column, n: int) -> Column:
    """All runs of n characters of a text, with repeats."""
    length = F.char_length(text)
    places = F.when(length >= n, F.sequence(F.lit(1), length - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(text, i, F.lit(n)))


def texts_containing(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """The distinct `text`s that contain any `term`, for any number of terms.

    A term's seed is the run of three characters in it that the fewest texts hold (a
    shorter term is its own); a term with a run that no text holds is dropped at once.
    Texts meet terms by an equi-join on seeds and each meeting is confirmed. So the
    work grows with the texts' lengths and the meetings on rare runs, not with texts
    x terms.
    """
    texts = texts.select("text").dropna().distinct()
    terms = terms.select("term").dropna().distinct()
    text, term = F.col("text"), F.col("term")
    every = F.array_distinct(F.concat(F.array(F.lit("")), *[_grams(text, n) for n in (1, 2, 3)]))
    held = texts.select("text", F.explode(every).alias("gram"))
    size = F.char_length(term)
    own = F.when(size >= 3, F.array_distinct(_grams(term, 3))).otherwise(F.array(term))
    asked = terms.select("term", F.size(own).alias("asked"), F.explode(own).alias("gram"))
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    seeds = (
        asked.join(counts, "gram")
        .groupBy("term", "asked")
        .agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("n", "gram")).alias("seed"))
        .filter(F.col("found") == F.col("asked"))
        .select("term", F.col("seed.gram").alias("gram"))
    )
    return held.join(seeds, "gram").filter(F.contains("text", "term")).select("text").distinct()


def tag_filter_many(records: DataFrame, terms: DataFrame, *, tags: str = "focus", term: str = "term") -> DataFrame:
    """`tag_filter` by a table of terms of any size. Null terms are none; an empty table keeps all records."""
    wanted = terms.select(F.lower(F.col(term)).alias("term")).dropna()
    joined = F.lower(F.array_join(F.col(tags), " "))
    rows = records.select(F.struct("*").alias("_record"), joined.alias("text"))
    # Records with the same tags are looked up once.
    found = texts_containing(rows.select("text"), wanted).withColumn("_hit", F.lit(True))
    none = wanted.agg(F.count(F.lit(1)) == 0).scalar()
    kept = rows.join(found, "text", "left").filter(F.coalesce("_hit", F.lit(False)) | none)
    return kept.select("_record.*").orderBy("rank")
