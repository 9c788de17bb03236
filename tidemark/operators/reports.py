"""Report queries: performance, movers, weights, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.numeric import ratio
from tidemark.functions.periods import TRAILING_DAYS, window_start
from tidemark.operators.signals import rebased_pair, relative_strength, yoy, zscore
from tidemark.operators.skew import spread_join

TAIL_LENGTH = 60

# The display order of indicator groups; others follow.
GROUP_ORDER = ("prices", "labor", "spending", "macro")


def performance_summary(levels: DataFrame, *, keys: list[str], value: str = "value") -> DataFrame:
    """Trailing returns in percent, one column per window and one row per key.

    The base of a window is the last value on or before its start. A key without
    any value has NULL in every window. The last date is found in a window by
    key and the bases in an aggregate by the same key, so levels are read and
    moved once.
    """
    known = F.when(F.col(value).isNotNull(), F.col("date"))
    rows = levels.select(*keys, "date", value).withColumn("_end", F.max(known).over(Window.partitionBy(*keys)))
    bases = [
        F.max_by(value, F.when(known <= window_start(F.col("_end"), label), F.col("date"))).alias(label)
        for label in TRAILING_DAYS
    ]
    rows = rows.groupBy(*keys).agg(F.max_by(value, known).alias("_last"), *bases)
    return rows.select(
        *keys, *[((ratio(F.col("_last"), F.col(label)) - 1.0) * 100.0).alias(label) for label in TRAILING_DAYS]
    )


def performance_table(index_values: DataFrame, *, track: str = "level_tr") -> DataFrame:
    """Trailing performance of every index."""
    return performance_summary(index_values, keys=["index_id"], value=track)


def _tracks_of_pairs(index_values: DataFrame, pairs: DataFrame, track: str) -> tuple[DataFrame, DataFrame]:
    """Both sides' levels keyed by (index_id, benchmark_id); a popular benchmark is dealt out."""
    levels = index_values.select("index_id", "date", F.col(track).alias("value"))
    keys = ["index_id", "benchmark_id"]
    own = spread_join(pairs.select(*keys), levels, "index_id", by="benchmark_id")
    bench = spread_join(
        pairs.select(*keys), levels.withColumnRenamed("index_id", "benchmark_id"), "benchmark_id", by="index_id"
    )
    return own, bench


def relative_tracks(index_values: DataFrame, pairs: DataFrame, *, track: str = "level_tr") -> DataFrame:
    """Relative strength of each (index_id, benchmark_id); above 100 the index is ahead."""
    own, bench = _tracks_of_pairs(index_values, pairs, track)
    return relative_strength(own, bench, keys=["index_id", "benchmark_id"])


def rebased_pairs(index_values: DataFrame, pairs: DataFrame, *, track: str = "level_tr") -> DataFrame:
    """Both levels of each (index_id, benchmark_id), 100 at their common start."""
    own, bench = _tracks_of_pairs(index_values, pairs, track)
    return rebased_pair(own, bench, keys=["index_id", "benchmark_id"])


def latest_weights(weights: DataFrame, securities: DataFrame) -> DataFrame:
    """Weights at each index's last rebalance; `heaviest_first` orders them."""
    last = weights.groupBy("index_id").agg(F.max("rebalance_date").alias("rebalance_date"))
    named = securities.select("ticker", "name", "subsector")
    return (
        weights.join(last, ["index_id", "rebalance_date"])
        .join(named, "ticker", "left")
        .select("index_id", "ticker", "name", "subsector", "weight")
    )


def heaviest_first(latest: DataFrame) -> DataFrame:
    return latest.orderBy("index_id", F.desc("weight"), "ticker")


def best_first(returns: DataFrame) -> DataFrame:
    return returns.orderBy("index_id", F.desc("return_pct"), "ticker")


def weights_in_percent(latest: DataFrame) -> DataFrame:
    return latest.withColumn("weight", F.round(F.col("weight") * 100, 2))


def constituent_prices(prices: DataFrame, latest: DataFrame) -> DataFrame:
    """Adjusted closes of each index's current constituents: (index_id, ticker, date, value)."""
    names = latest.select("index_id", "ticker")
    return prices.select("ticker", "date", F.col("adj_close").alias("value")).join(names, "ticker").select(
        "index_id", "ticker", "date", "value"
    )


def constituent_returns(prices: DataFrame, latest: DataFrame, window_days: int) -> DataFrame:
    """Return in percent per constituent over the window; `best_first` orders them.

    The window ends on the last price date of any ticker. Names without a price
    on or before its start, or with a base of 0, are dropped. Prices are reduced
    to one row per ticker before they meet the indices.
    """
    end = prices.select(F.max("date")).scalar()
    early = F.when(F.col("date") <= F.date_sub(end, window_days), F.col("date"))
    per_ticker = (
        prices.filter(F.col("adj_close").isNotNull())
        .groupBy("ticker")
        .agg(F.max_by("adj_close", "date").alias("_last"), F.max_by("adj_close", early).alias("_base"))
    )
    pct = (ratio(F.col("_last"), F.col("_base")) - 1.0) * 100.0
    return (
        latest.join(per_ticker, "ticker")
        .select("index_id", "ticker", "name", "subsector", pct.alias("return_pct"))
        .filter(F.col("return_pct").isNotNull())
    )


def movers_topk(returns: DataFrame, k: int = 10) -> DataFrame:
    """Best and worst k constituents per index; the lists overlap in a small index.

    Each row stands in both lists, so one pass ranks them and every task keeps
    only its own best k of each list before the shuffle.
    """
    sides = F.explode(F.array(F.lit("gainers"), F.lit("losers")))
    score = F.when(F.col("side") == "gainers", F.col("return_pct")).otherwise(-F.col("return_pct"))
    order = Window.partitionBy("index_id", "side").orderBy(F.desc("_score"), "ticker")
    return (
        returns.withColumn("side", sides)
        .withColumn("_score", score)
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= k)
        .drop("_score")
    )


def indicator_snapshot(
    current: DataFrame, *, keys: list[str], frequency: str | None = None, tail: int = TAIL_LENGTH
) -> DataFrame:
    """Latest value and its date, year-over-year change, z-score and recent tail per series.

    A tail holds at most `tail` points, picked by rank before they are gathered.
    """
    rows = current.filter(F.col("value").isNotNull())
    if frequency is None:
        scored = zscore(yoy(rows, keys=keys), 36, keys=keys)
    else:
        scored = zscore(yoy(rows, keys=keys, frequency=frequency), keys=keys, frequency=frequency)
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))
    recent = scored.withColumn("_n", newest).filter(F.col("_n") <= tail)
    at_end = F.col("_n") == 1
    points = F.array_sort(F.collect_list(F.struct("date", "value")))
    return recent.groupBy(*keys).agg(
        F.max(F.when(at_end, F.col("value"))).alias("latest"),
        F.max("date").alias("as_of"),
        F.max(F.when(at_end, F.col("yoy"))).alias("yoy"),
        F.max(F.when(at_end, F.col("zscore"))).alias("zscore"),
        points.alias("spark"),
    )


def in_group_order(rows: DataFrame, *, group: str = "subsector", then: str = "metric_name") -> DataFrame:
    """Sort by the display order of groups; unknown groups follow in name order, rows without one drop."""
    place = F.array_position(F.array(*[F.lit(g) for g in GROUP_ORDER]), F.col(group))
    known = F.when(place > 0, place).otherwise(F.lit(len(GROUP_ORDER) + 1))
    return rows.filter(F.col(group).isNotNull()).orderBy(known, group, then)
