"""Price drops to the canonical long table, and share counts onto price dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.numeric import to_number
from tidemark.operators.align import asof_align


def canonical_prices(raw: DataFrame, tickers: DataFrame, start: dt.date | str) -> DataFrame:
    """(ticker, date, close, adj_close, shares_out) of the wanted tickers from `start` on."""
    day = F.to_date("date")
    return (
        raw.filter(day >= F.lit(start).cast("date"))
        .join(tickers.select("ticker"), "ticker", "left_semi")
        .select(
            "ticker",
            day.alias("date"),
            *[to_number(F.col(c)).alias(c) for c in ("close", "adj_close", "shares_out")],
        )
    )


def align_shares(dates: DataFrame, history: DataFrame, static: DataFrame) -> DataFrame:
    """Share count per price date: the last one reported, else the ticker's static count.

    `dates` is (ticker, date), one row each; `history` (ticker, date, seq,
    shares); `static` (ticker, shares). The static count serves a ticker only if
    its history yields nothing at all, so dates before the first report stay
    NULL for the others.
    """
    aligned = asof_align(
        dates, history, keys=["ticker"], columns=["shares"], tie="seq", left_is_unique=True
    )
    reported = F.count("shares").over(Window.partitionBy("ticker"))
    return (
        aligned.withColumn("_reported", reported)
        .join(static.select("ticker", F.col("shares").alias("_static")), "ticker", "left")
        .select(
            "ticker",
            "date",
            F.when(F.col("_reported") == 0, F.col("_static"))
            .otherwise(F.col("shares"))
            .cast("double")
            .alias("shares_out"),
        )
    )
