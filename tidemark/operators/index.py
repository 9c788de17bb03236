"""Capitalisation-weighted, periodically rebalanced indices.

The index drifts with its constituents between rebalances. On the rebalance day it
stays flat, or carries what the leaving constituents gained that day. Instead of walking day by day, the level follows from sums:
within a period the index has grown to

    S(t) = 1 + sum over days u <= t, constituents j of  cap_j / F_j * (F_j(u) - F_j(u-)) / sum of caps

where cap_j and F_j are taken on the rebalance day and u- is the last day
before u on which j had a price. A day without a price adds nothing, so only
price rows that exist take part and no (date x ticker) grid is built. The level
is the base times the S of all finished periods times the S of the running one.

Big data moves once, by ticker. Everything after the first aggregate holds at
most a few rows per index and day.

A period's growth needs the prices of that period alone, and of what came before only
how each ticker's earlier periods opened and ended. So `index_days` can build some
periods and leave the others as they are stored; `index_levels` chains stored days.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.numeric import known, ratio
from tidemark.functions.periods import period_start
from tidemark.operators.universe import is_member


def _from_base(prices: DataFrame, base_date: dt.date | str | None) -> DataFrame:
    return prices if base_date is None else prices.filter(F.col("date") >= F.lit(base_date).cast("date"))


def rebalance_dates(
    prices: DataFrame, members: DataFrame, *, base_date: dt.date | str | None = None, rebalance: str = "Q"
) -> DataFrame:
    """First trading day of each period of each index: (index_id, rebalance_date).

    Prices are reduced to one row per ticker and period before they meet the members.
    """
    tickers = members.select("index_id", "ticker").distinct()
    first = (
        _from_base(prices, base_date)
        .groupBy("ticker", period_start(F.col("date"), rebalance).alias("period"))
        .agg(F.min("date").alias("date"))
    )
    return (
        first.join(tickers, "ticker")
        .groupBy("index_id", "period")
        .agg(F.min("date").alias("rebalance_date"))
        .select("index_id", "rebalance_date")
    )


def _opening_rows(
    prices: DataFrame, members: DataFrame, base_date: dt.date | str | None, rebalance: str
) -> DataFrame:
    """Each index member's first price row of each period, with the cap that may weigh.

    A member can carry weight only if this row falls on the index's rebalance
    day, so one row per ticker and period is all the weights need.
    """
    first = (
        _from_base(prices, base_date)
        .withColumn("period", period_start(F.col("date"), rebalance))
        .groupBy("ticker", "period")
        .agg(
            F.min("date").alias("date"),
            F.min_by("close", "date").alias("close"),
            F.min_by("shares_out", "date").alias("shares_out"),
        )
    )
    cap = known(F.col("close") * F.col("shares_out"))
    eligible = is_member(F.col("date"), F.col("from_date"), F.col("to_date"))
    return first.join(members, "ticker").select(
        "index_id", "ticker", "period", "date", F.when(eligible & (cap > 0), cap).alias("cap")
    )


def index_weights(
    prices: DataFrame, members: DataFrame, *, base_date: dt.date | str | None = None, rebalance: str = "Q"
) -> DataFrame:
    """Weights on every rebalance date: (index_id, rebalance_date, ticker, weight)."""
    opening = _opening_rows(prices, members, base_date, rebalance)
    # Caps are first summed per (index, period, day): that also finds the rebalance day.
    totals = (
        opening.groupBy("index_id", "period", "date")
        .agg(F.sum("cap").alias("total"))
        .groupBy("index_id", "period")
        .agg(F.min("date").alias("date"), F.min_by("total", "date").alias("total"))
    )
    return (
        opening.filter(F.col("cap").isNotNull())
        .join(totals, ["index_id", "period", "date"])
        .select(
            "index_id",
            F.col("date").alias("rebalance_date"),
            "ticker",
            ratio(F.col("cap"), F.col("total")).alias("weight"),
        )
    )


_OPENED = ("open_date", "open_cap", "open_pr", "open_tr")
_LEFT = "array<struct<open_date: date, gain_pr: double, gain_tr: double>>"


def _price_moves(prices: DataFrame, rebalance: str, ends: DataFrame | None = None) -> DataFrame:
    """Per price row: the move since the ticker's last price, and its opening row's values.

    `ends` stands in for the prices of other periods, one row for each ticker and
    period. All windows sort by ticker, period, date, so one shuffle and one sort serve them.
    """
    by_ticker = Window.partitionBy("ticker").orderBy("period", "date")
    before = by_ticker.rowsBetween(Window.unboundedPreceding, -1)
    in_period = Window.partitionBy("ticker", "period").orderBy("date")

    def opening(col: str) -> Column:
        return F.first(col).over(in_period.rowsBetween(Window.unboundedPreceding, 0))

    held = prices.select(
        "ticker",
        "date",
        period_start(F.col("date"), rebalance).alias("period"),
        known(F.col("close")).alias("close"),
        known(F.col("adj_close")).alias("adj_close"),
        known(F.col("close") * F.col("shares_out")).alias("cap"),
        F.lit(True).alias("own"),
    )
    if ends is not None:
        stood = ends.select("ticker", "date", "period", "close", "adj_close", F.struct(*_OPENED).alias("opened"), F.lit(False).alias("own"))
        held = held.unionByName(stood, allowMissingColumns=True)
    held = held.withColumns(
        {
            "last_pr": F.last("close", ignorenulls=True).over(before),
            "last_tr": F.last("adj_close", ignorenulls=True).over(before),
        }
    )
    rows = held.withColumns({"pr": F.coalesce("close", "last_pr"), "tr": F.coalesce("adj_close", "last_tr")}).withColumns(
        {"move_pr": F.col("pr") - F.col("last_pr"), "move_tr": F.col("tr") - F.col("last_tr")}
    )
    first = {f"open_{c}": opening(c) for c in ("date", "cap", "pr", "tr")}
    if ends is not None:
        first = {name: F.coalesce(F.col(f"opened.{name}"), value) for name, value in first.items()}
    return rows.select(
        "ticker", "date", "period", "own", "pr", "tr", "move_pr", "move_tr",
        (F.col("close").isNull() | F.col("adj_close").isNull()).alias("gap"),
        *[value.alias(name) for name, value in first.items()],
    )


def ticker_ends(
    prices: DataFrame, *, base_date: dt.date | str | None = None, rebalance: str = "Q", ends: DataFrame | None = None
) -> DataFrame:
    """How each ticker's periods opened and ended: one row for each ticker and period of `prices`.

    `carried` marks periods that open without a price and so lean on an earlier one.
    `ends` are those of other periods, where `prices` holds some only.
    """
    rows = _price_moves(_from_base(prices, base_date), rebalance, ends).filter("own")
    opens = F.col("date") == F.col("open_date")
    return rows.groupBy("ticker", "period").agg(
        F.max("date").alias("date"),
        F.max_by("pr", "date").alias("close"),
        F.max_by("tr", "date").alias("adj_close"),
        *[F.min_by(c, "date").alias(c) for c in _OPENED],
        F.max(opens & F.col("gap")).alias("carried"),
    )


def touched_periods(
    changed: DataFrame, ends: DataFrame, *, rebalance: str = "Q", rebalance_day: str = "flat"
) -> DataFrame:
    """Periods to build anew after the prices of `changed` (ticker, date) came or were restated.

    A period leans on the prices in it. One that opens without a price leans on the
    ticker's earlier ones too; with `rebalance_day='carry'` every period does on the
    one before. `ends` are those stored before the change.
    """
    own = changed.groupBy("ticker").agg(
        F.collect_set(period_start(F.col("date"), rebalance)).alias("periods"),
        F.min(period_start(F.col("date"), rebalance)).alias("first"),
    )
    leaning = ends.filter("carried").join(own, "ticker").filter(F.col("period") > F.col("first"))
    touched = own.select(F.explode("periods").alias("period")).unionByName(leaning.select("period")).distinct()
    if rebalance_day == "flat":
        return touched
    # The next period in which anything trades; periods are bounded by the calendar.
    all_ = ends.select("period").unionByName(touched).distinct()
    after = all_.select("period", F.lead("period").over(Window.orderBy("period")).alias("next"))
    following = after.join(touched, "period").select(F.col("next").alias("period")).dropna()
    return touched.unionByName(following).distinct()


def index_days(
    prices: DataFrame,
    members: DataFrame,
    *,
    base_date: dt.date | str | None = None,
    rebalance: str = "Q",
    rebalance_day: str = "flat",
    ends: DataFrame | None = None,
) -> DataFrame:
    """Growth since the period's rebalance, one row per index and trading day.

    Rows are summed by (index, day, opening day) first. Only then is the
    index's rebalance day known, and sums that opened on another day drop out:
    those members had no price on the rebalance day and sit the period out.

    With `rebalance_day='carry'` a period's first day also holds, by opening day,
    what the tickers' shares of their period before gained on it.
    `prices` may hold some whole periods only; `ends` then stands for the others.
    """
    if rebalance_day not in ("flat", "carry"):
        raise ValueError(f"rebalance_day must be 'flat' or 'carry', not {rebalance_day!r}")
    moves = _price_moves(_from_base(prices, base_date), rebalance, ends)
    if rebalance_day == "carry":
        by_ticker = Window.partitionBy("ticker").orderBy("period", "date")
        moves = moves.withColumns({f"past_{c}": F.lag(c).over(by_ticker) for c in _OPENED})
    moves = moves.filter("own").drop("own", "gap", "pr", "tr")
    eligible = is_member(F.col("open_date"), F.col("from_date"), F.col("to_date"))
    # The moves lie partitioned and sorted by ticker already, so a merge join leaves them in place.
    member_rows = moves.join(members.hint("merge"), "ticker")
    if rebalance_day == "carry":
        member_rows = member_rows.withColumn("leaving", F.explode(F.expr("if(date = open_date, array(false, true), array(false))")))
        member_rows = member_rows.withColumns({c: F.when(F.col("leaving"), F.col(f"past_{c}")).otherwise(F.col(c)) for c in _OPENED})
    else:
        member_rows = member_rows.withColumn("leaving", F.lit(False))
    member_rows = member_rows.withColumn("open_cap", F.when(eligible & (F.col("open_cap") > 0), F.col("open_cap")))
    opens = F.col("date") == F.col("open_date")

    def gain(track: str) -> Column:
        shares = ratio(F.col("open_cap"), F.col(f"open_{track}"))
        return F.sum(F.when(~opens, shares * F.col(f"move_{track}"))).alias(f"gain_{track}")

    def stake(track: str) -> Column:
        return F.sum(F.when(opens & F.col(f"open_{track}").isNotNull(), F.col("open_cap"))).alias(f"cap_{track}")

    sums = member_rows.groupBy("index_id", "period", "date", "open_date", "leaving").agg(
        gain("pr"), gain("tr"), stake("pr"), stake("tr")
    )
    in_period = Window.partitionBy("index_id", "period")
    on_time = (F.col("open_date") == F.col("rebalance_date")) & ~F.col("leaving")
    left = F.lit(None).cast(_LEFT)
    if rebalance_day == "carry":
        starts = F.col("date") == F.col("rebalance_date")
        gains = F.when(F.col("leaving") & starts & F.col("open_date").isNotNull(), F.struct("open_date", "gain_pr", "gain_tr"))
        left = F.collect_list(gains)  # as many as there are days in a period at most
    daily = (
        sums.withColumn("rebalance_date", F.min("date").over(in_period))
        .groupBy("index_id", "period", "rebalance_date", "date")
        .agg(
            *[
                F.sum(F.when(on_time, F.col(c))).alias(c)
                for c in ("gain_pr", "gain_tr", "cap_pr", "cap_tr")
            ],
            left.alias("left"),
        )
    )
    running = in_period.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)

    def growth(track: str) -> Column:
        gained = F.coalesce(F.sum(f"gain_{track}").over(running), F.lit(0.0))
        total = F.first(f"cap_{track}").over(running)
        return F.coalesce(F.lit(1.0) + ratio(gained, total), F.lit(1.0)).alias(f"growth_{track}")

    return daily.select(
        "index_id", "period", "rebalance_date", "date", growth("pr"), growth("tr"),
        *[F.first(f"cap_{t}").over(running).alias(f"total_{t}") for t in ("pr", "tr")], "left",
    )


def index_levels(days: DataFrame, *, base_value: float = 100.0) -> DataFrame:
    """Chain the days of whole histories: levels, with the period's growth and the day-on-day factor per track."""
    by_index = Window.partitionBy("index_id").orderBy("period", "date")
    finished = by_index.rowsBetween(Window.unboundedPreceding, -1)
    closes = F.coalesce(F.lead("period").over(by_index) != F.col("period"), F.lit(False))
    # What was gained on the next period's first day by the shares that opened with this period.
    next_left = F.lead("left").over(by_index)
    rows = days.withColumns({"_closes": closes, "_left": F.when(closes, F.filter(next_left, lambda g: g["open_date"] == F.col("rebalance_date")))})
    out = []
    for track in ("pr", "tr"):
        grown = F.col(f"growth_{track}")
        gained = ratio(F.try_element_at("_left", F.lit(1))[f"gain_{track}"], F.col(f"total_{track}"))
        rows = rows.withColumn(f"_end_{track}", grown + F.coalesce(gained, F.lit(0.0)))
        end = F.col(f"_end_{track}")
        carried = F.coalesce(F.product(F.when(F.col("_closes"), end)).over(finished), F.lit(1.0))
        starts = F.col("date") == F.col("rebalance_date")
        before, turned = F.lag(grown).over(by_index), F.coalesce(ratio(F.lag(end).over(by_index), F.lag(grown).over(by_index)), F.lit(1.0))
        out += [
            (carried * grown * base_value).alias(f"level_{track}"),
            F.when(starts, turned).otherwise(ratio(grown, before)).alias(f"factor_{track}"),
        ]
    return rows.select("index_id", "date", "rebalance_date", "growth_pr", "growth_tr", *out)


def index_levels_chain(
    prices: DataFrame,
    members: DataFrame,
    *,
    base_value: float = 100.0,
    base_date: dt.date | str | None = None,
    rebalance: str = "Q",
    rebalance_day: str = "flat",
) -> DataFrame:
    """Levels with the chain behind them: period growth and day-on-day factor per track.

    On a rebalance day the level stays `flat`, or it carries (`carry`) what the shares
    held until then gained on that day.
    """
    days = index_days(prices, members, base_date=base_date, rebalance=rebalance, rebalance_day=rebalance_day)
    return index_levels(days, base_value=base_value)


def build_index(
    prices: DataFrame,
    members: DataFrame,
    *,
    base_value: float = 100.0,
    base_date: dt.date | str | None = None,
    rebalance: str = "Q",
    rebalance_day: str = "flat",
) -> tuple[DataFrame, DataFrame]:
    """(levels, weights) of every index in `members`.

    `members` holds one row per index and ticker; `prices` one per ticker and date.
    """
    options = {"base_date": base_date, "rebalance": rebalance}
    levels = index_levels_chain(prices, members, base_value=base_value, rebalance_day=rebalance_day, **options)
    return (
        levels.select("index_id", "date", "level_pr", "level_tr"),
        index_weights(prices, members, **options),
    )


def baseline_index(prices: DataFrame, baselines: DataFrame, *, base_value: float = 100.0) -> DataFrame:
    """Each benchmark's own price history scaled to start at the base value."""
    usable = (F.col("close") > 0) & (F.col("adj_close") > 0)
    rows = (
        prices.select("ticker", "date", known(F.col("close")).alias("close"), known(F.col("adj_close")).alias("adj_close"))
        .filter(usable)
        .join(baselines.select("index_id", "ticker"), "ticker")
    )
    start = Window.partitionBy("index_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "index_id",
        "date",
        (F.lit(base_value) * F.col("close") / F.first("close").over(start)).alias("level_pr"),
        (F.lit(base_value) * F.col("adj_close") / F.first("adj_close").over(start)).alias("level_tr"),
    )


def priced_indices(
    prices: DataFrame, members: DataFrame, baselines: DataFrame, *, base_date: dt.date | str | None = None
) -> DataFrame:
    """Ids of the indices `build_all_indices` yields levels for, without building them."""
    traded = _from_base(prices, base_date).select("ticker").distinct()
    usable = prices.filter((F.col("close") > 0) & (F.col("adj_close") > 0)).select("ticker").distinct()
    own = members.select("index_id", "ticker").join(traded, "ticker", "left_semi")
    bench = baselines.select("index_id", "ticker").join(usable, "ticker", "left_semi")
    return own.unionByName(bench).select("index_id").distinct()


def build_all_indices(
    prices: DataFrame,
    members: DataFrame,
    baseline_prices: DataFrame,
    baselines: DataFrame,
    *,
    base_value: float = 100.0,
    base_date: dt.date | str | None = None,
    rebalance: str = "Q",
    rebalance_day: str = "flat",
) -> tuple[DataFrame, DataFrame]:
    """(levels, weights) of the benchmarks, the whole universe and every sub-sector."""
    levels, weights = build_index(
        prices, members, base_value=base_value, base_date=base_date, rebalance=rebalance, rebalance_day=rebalance_day
    )
    bench = baseline_index(baseline_prices, baselines, base_value=base_value)
    return levels.unionByName(bench), weights
