import numpy as np
import pandas as pd
import pytest
from helpers import day, month_ends, prices, series
from pyspark.sql import functions as F

from tidemark.operators import reports

WINDOWS = ["1D", "1W", "1M", "3M", "6M", "YTD", "1Y"]


def daily(spark, key, vals, start):
    dates = pd.date_range(start, periods=len(vals))
    return series(spark, [(key, d.date().isoformat(), v) for d, v in zip(dates, vals)])


def test_performance(spark):
    vals = 100 * np.exp(0.0005 * np.arange(400))
    rows = daily(spark, "a", vals, "2023-01-01").unionByName(daily(spark, "short", [1.0, 2.0], "2024-01-03")).unionByName(daily(spark, "none", [None], "2024-01-03"))
    out = {r.key: r.asDict() for r in reports.performance_summary(rows, keys=["key"]).collect()}
    s = pd.Series(vals, index=pd.date_range("2023-01-01", periods=400))
    for label, days in (("1D", 1), ("1W", 7), ("1M", 30), ("3M", 91), ("6M", 182), ("1Y", 365)):
        base = s[: s.index[-1] - pd.Timedelta(days=days)].iloc[-1]
        assert out["a"][label] == pytest.approx((s.iloc[-1] / base - 1) * 100)
    assert out["a"]["YTD"] == pytest.approx((s.iloc[-1] / s["2024-01-01"] - 1) * 100)
    assert out["a"]["1Y"] > out["a"]["1M"] > 0
    assert out["short"]["1D"] == pytest.approx(100) and out["short"]["1W"] is None and out["short"]["YTD"] is None
    assert set(out["none"].values()) == {"none", None}


LATEST = "index_id string, ticker string, name string, subsector string, weight double"


def mover_prices(spark):
    n = 400
    dates = [d.date() for d in pd.date_range("2024-01-01", periods=n)]
    lines = {"AAA": np.linspace(100, 200, n), "BBB": np.full(n, 50.0), "CCC": np.linspace(80, 40, n)}
    rows = [(t, d, float(v), float(v), 1.0) for t, vs in lines.items() for d, v in zip(dates, vs)]
    rows += [("NEW", d, 1.0, 1.0, 1.0) for d in dates[-10:]]
    return prices(spark, rows)


def test_movers(spark):
    names = [("I", t, t.lower(), "s", 0.25) for t in ("AAA", "BBB", "CCC", "NEW")] + [("J", "CCC", "ccc", "s", 1.0)]
    latest = spark.createDataFrame(names, LATEST)
    out = reports.constituent_returns(mover_prices(spark), latest, 365)
    shown = [(r.index_id, r.ticker) for r in reports.best_first(out).collect()]
    assert shown == [("I", "AAA"), ("I", "BBB"), ("I", "CCC"), ("J", "CCC")]
    top = reports.movers_topk(out, 2)
    got = {(r.index_id, r.side): [] for r in top.collect()}
    for r in top.orderBy("index_id", "side", "position").collect():
        got[(r.index_id, r.side)].append(r.ticker)
    assert got == {("I", "gainers"): ["AAA", "BBB"], ("I", "losers"): ["CCC", "BBB"], ("J", "gainers"): ["CCC"], ("J", "losers"): ["CCC"]}


def test_latest_weights(spark):
    rows = [("I", day("2020-01-01"), "A", 1.0), ("I", day("2020-04-01"), "A", 0.123456), ("I", day("2020-04-01"), "B", 0.876544), ("J", day("2020-01-01"), "A", 1.0)]
    weights = spark.createDataFrame(rows, "index_id string, rebalance_date date, ticker string, weight double")
    secs = spark.createDataFrame([("A", "a", "s")], "ticker string, name string, subsector string")
    out = reports.heaviest_first(reports.latest_weights(weights, secs))
    assert [(r.index_id, r.ticker, r.name) for r in out.collect()] == [("I", "B", None), ("I", "A", "a"), ("J", "A", "a")]
    assert [r.weight for r in reports.weights_in_percent(out).collect()] == [87.65, 12.35, 100.0]


def test_snapshot(spark):
    vals = np.linspace(100, 200, 70)
    rows = [("a", d.isoformat(), float(v)) for d, v in zip(month_ends("2018-01-31", 70), vals)] + [("a", "2030-01-01", None)]
    row = reports.indicator_snapshot(series(spark, rows), keys=["key"]).collect()[0]
    assert row.latest == 200 and row.as_of == month_ends("2018-01-31", 70)[-1]
    assert row.yoy == pytest.approx(vals[-1] / vals[-13] - 1)
    tail = pd.Series(vals[-36:])
    assert row.zscore == pytest.approx((vals[-1] - tail.mean()) / tail.std())
    assert len(row.spark) == 60 and [p.value for p in row.spark] == pytest.approx(list(vals[-60:]))


def test_snapshot_window_follows_the_frequency(spark):
    vals = list(np.arange(1.0, 31.0) ** 2)
    s = series(spark, [("q", d.isoformat(), v) for d, v in zip(month_ends("2018-01-31", 30), vals)]).withColumn("f", F.lit("Q"))
    row = reports.indicator_snapshot(s, keys=["key", "f"], frequency="f").collect()[0]
    tail = pd.Series(vals[-12:])
    assert row.zscore == pytest.approx((vals[-1] - tail.mean()) / tail.std())
    assert row.yoy == pytest.approx(vals[-1] / vals[-5] - 1)


def test_group_order(spark):
    meta = spark.createDataFrame([("zebra", "z"), ("macro", "m"), ("apple", "a"), ("prices", "p"), (None, "n"), ("labor", "l")], "subsector string, metric_name string")
    assert [r.subsector for r in reports.in_group_order(meta).collect()] == ["prices", "labor", "macro", "apple", "zebra"]


def test_performance_columns(spark):
    frame = spark.createDataFrame([("I", day("2020-01-01"), 1.0, 1.0)], "index_id string, date date, level_pr double, level_tr double")
    assert reports.performance_table(frame).columns == ["index_id", *WINDOWS]
