"""Builders and readers for small frames."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F


def day(text):
    return dt.date.fromisoformat(text)


def series(spark, rows):
    """rows of (key, 'YYYY-MM-DD', value)"""
    data = [(k, day(d), None if v is None else float(v)) for k, d, v in rows]
    return spark.createDataFrame(data, "key string, date date, value double")


def prices(spark, rows):
    """rows of (ticker, date, close, adj_close, shares_out)"""
    data = [(t, day(d) if isinstance(d, str) else d, c, a, s) for t, d, c, a, s in rows]
    return spark.createDataFrame(data, "ticker string, date date, close double, adj_close double, shares_out double")


def members(spark, rows):
    """rows of (index_id, ticker, from, to)"""
    data = [(i, t, day(f) if f else None, day(u) if u else None) for i, t, f, u in rows]
    return spark.createDataFrame(data, "index_id string, ticker string, from_date date, to_date date")


def values(frame, *cols, order="date"):
    """Rows as tuples, sorted."""
    return [tuple(r) for r in frame.orderBy(*([order] if isinstance(order, str) else order)).select(*cols).collect()]


def months(start, n):
    return [d.date() for d in pd.date_range(start, periods=n, freq="MS")]


def month_ends(start, n):
    return [d.date() for d in pd.date_range(start, periods=n, freq="ME")]


def by_key(frame, key):
    return {r[key]: r.asDict() for r in frame.collect()}


def shuffled(frame):
    return frame.repartition(4, F.rand(seed=3))
