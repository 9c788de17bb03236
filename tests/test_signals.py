import numpy as np
import pandas as pd
import pytest
from helpers import day, months, series, shuffled, values
from pyspark.sql import functions as F

from tidemark.operators import align, leadlag, signals

K = ["key"]


def monthly(spark, key, vals, start="2020-01-01"):
    return series(spark, [(key, d.isoformat(), v) for d, v in zip(months(start, len(vals)), vals)])


def column(frame, name, order="date"):
    return [v for (v,) in values(frame, name, order=order)]


def test_yoy(spark):
    out = column(signals.yoy(monthly(spark, "a", range(100, 113)), keys=K, periods=12), "yoy")
    assert out[0] is None and out[12] == pytest.approx(0.12)


def test_yoy_by_frequency(spark):
    rows = monthly(spark, "q", [100, 0, 0, 0, 110]).withColumn("f", F.lit("Q")).unionByName(
        monthly(spark, "a", [100, 150]).withColumn("f", F.lit("A"))
    ).unionByName(monthly(spark, "u", range(1, 14)).withColumn("f", F.lit(None).cast("string")))
    out = signals.yoy(rows, keys=K, frequency="f")
    last = {r.key: r.yoy for r in out.groupBy("key").agg(F.max_by("yoy", "date").alias("yoy")).collect()}
    assert last == {"q": pytest.approx(0.1), "a": pytest.approx(0.5), "u": pytest.approx(12.0)}


def test_changes_carry_the_last_value_over_gaps(spark):
    vals = [100, None, 110, None, None, 121]
    got = column(signals.mom(monthly(spark, "a", vals), keys=K), "mom")
    want = pd.Series(vals, dtype=float).ffill().pct_change(fill_method=None)
    assert [None if v is None else round(v, 9) for v in got] == [None if np.isnan(v) else round(v, 9) for v in want]
    assert column(signals.qoq(monthly(spark, "a", [0, 5]), keys=K), "qoq") == [None, None]


def test_zscore_and_smooth_need_a_full_window(spark):
    s = monthly(spark, "a", [1, 2, 3, 4, 5])
    assert column(signals.zscore(s, 3, keys=K), "zscore") == [None, None, 1.0, 1.0, 1.0]
    assert column(signals.smooth(s, 3, keys=K), "smooth") == [None, None, 2.0, 3.0, 4.0]
    gap = monthly(spark, "a", [1, 2, None, 4, 5, 6])
    assert column(signals.smooth(gap, 3, keys=K), "smooth") == [None] * 5 + [5.0]
    flat = monthly(spark, "a", [7, 7, 7])
    assert column(signals.zscore(flat, 3, keys=K), "zscore") == [None] * 3


def test_signals_do_not_mix_keys(spark):
    both = shuffled(monthly(spark, "a", range(1, 30)).unionByName(monthly(spark, "b", range(100, 71, -1))))
    out = signals.zscore(both, 5, keys=K)
    one = signals.zscore(monthly(spark, "b", range(100, 71, -1)), 5, keys=K)
    assert column(out.filter("key = 'b'"), "zscore") == column(one, "zscore")


def test_diffusion_against_the_grid(spark):
    rng = np.random.default_rng(5)
    dates = pd.bdate_range("2020-01-01", periods=30)
    wide = pd.DataFrame(rng.normal(size=(30, 6)).round(1), index=dates, columns=list("abcdef"))
    wide = wide.mask(rng.random(wide.shape) < 0.3)
    wide.iloc[7] = np.nan
    rows = [(k, d.date().isoformat(), None if np.isnan(v) else v) for d, r in wide.iterrows() for k, v in r.items() if not np.isnan(v) or k == "a"]
    got = values(signals.diffusion(shuffled(series(spark, rows)), keys=K), "date", "diffusion")
    with np.errstate(invalid="ignore"):
        want = (wide.diff() > 0).sum(axis=1) / wide.notna().sum(axis=1)
    assert [d for d, _ in got] == [d.date() for d in dates]
    assert [v for _, v in got] == [None if np.isnan(v) else pytest.approx(v) for v in want]


def test_relative_strength(spark):
    a = series(spark, [("p", "2020-01-01", 100), ("p", "2020-01-02", 110), ("p", "2020-01-03", 121), ("q", "2020-01-01", 5), ("q", "2020-01-02", 6)])
    b = series(spark, [("p", d, 100) for d in ("2020-01-01", "2020-01-02", "2020-01-03")] + [("q", "2020-01-02", 3), ("q", "2020-01-03", 3), ("z", "2021-01-01", 1)])
    out = signals.relative_strength(a, b, keys=K)
    assert column(out.filter("key = 'p'"), "strength") == pytest.approx([100, 110, 121])
    assert values(out.filter("key = 'q'"), "date", "strength") == [(day("2020-01-02"), 100.0)]
    assert out.filter("key = 'z'").count() == 0
    pair = signals.rebased_pair(a, b, keys=K).filter("key = 'p'")
    assert values(pair, "a", "b")[-1] == (pytest.approx(121), pytest.approx(100))


def test_rebased_tracks(spark):
    rows = series(spark, [("x", "2020-01-01", 1), ("x", "2020-01-02", 2), ("x", "2020-01-03", 4), ("y", "2020-01-02", 10), ("y", "2020-01-03", 15)])
    out = signals.rebased_tracks(rows, key="key")
    assert values(out, "key", "date", "rebased", order=["key", "date"]) == [
        ("x", day("2020-01-02"), 100.0), ("x", day("2020-01-03"), 200.0), ("y", day("2020-01-02"), 100.0), ("y", day("2020-01-03"), 150.0),
    ]
    apart = series(spark, [("x", "2020-01-01", 2), ("y", "2020-01-02", 4), ("y", "2020-01-03", 8)])
    assert column(signals.rebased_tracks(apart, key="key"), "rebased") == [100.0, 100.0, 200.0]


def test_month_grid_and_returns(spark):
    s = series(spark, [("a", "2020-01-10", 9), ("a", "2020-01-31", 10), ("a", "2020-02-15", None), ("a", "2020-04-05", 12), ("b", "2020-02-01", 1)])
    grid = align.month_last(s, keys=K)
    assert values(grid.filter("key = 'a'"), "date", "value") == [
        (day("2020-01-31"), 10.0), (day("2020-02-29"), None), (day("2020-03-31"), None), (day("2020-04-30"), 12.0),
    ]
    ret = signals.monthly_returns(s, keys=K)
    assert values(ret, "key", "date", "ret") == [
        ("a", day("2020-02-29"), 0.0), ("a", day("2020-03-31"), 0.0), ("a", day("2020-04-30"), pytest.approx(0.2)),
    ]
    starts = align.month_last(s, keys=K, label="start", span_nulls=True)
    assert starts.filter("key = 'a'").count() == 4
    lags = signals.ar_lags(ret, 2, keys=K)
    assert values(lags, "ret_lag0", "ret_lag1")[-1] == (pytest.approx(0.2), 0.0)


def test_asof(spark):
    left = series(spark, [("k", "2020-01-10", 1), ("k", "2020-01-20", 2), ("k", "2020-02-10", 3)])
    right = series(spark, [("k", "2020-01-01", 10), ("k", "2020-02-01", 20)]).withColumnRenamed("value", "ind")
    for unique in (False, True):
        out = align.asof_align(left, right, keys=K, columns=["ind"], left_is_unique=unique)
        assert values(out, "value", "ind") == [(1.0, 10.0), (2.0, 10.0), (3.0, 20.0)]


def test_asof_keeps_nulls_and_the_last_duplicate(spark):
    left = series(spark, [("k", "2020-01-01", 1), ("k", "2020-01-05", 5), ("k", "2020-01-09", 9)])
    right = spark.createDataFrame(
        [("k", day("2020-01-02"), 1.0, 1), ("k", day("2020-01-05"), 2.0, 1), ("k", day("2020-01-05"), None, 2)],
        "key string, date date, ind double, seq int",
    )
    out = align.asof_align(left, right, keys=K, columns=["ind", "seq"], tie="seq")
    assert values(out, "ind", "seq") == [(None, None), (None, 2), (None, 2)]


@pytest.mark.parametrize("unique", [False, True])
def test_asof_against_pandas_with_a_hot_key(spark, unique):
    rng = np.random.default_rng(3)
    days = pd.date_range("2020-01-01", periods=120)
    n = 90 if unique else 3000
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcd"), n))
    left = pd.DataFrame({"key": key, "date": rng.choice(days, n), "row": range(n)})
    if unique:
        left = left.drop_duplicates(["key", "date"])
    right = pd.DataFrame({"key": rng.choice(["hot", "a", "b"], 200), "date": rng.choice(days, 200), "ind": rng.normal(size=200)})
    right = right.drop_duplicates(["key", "date"])
    right.loc[::7, "ind"] = np.nan
    want = pd.merge_asof(left.sort_values("date"), right.sort_values("date"), on="date", by="key").sort_values("row")
    ldf = spark.createDataFrame(left.assign(date=left.date.dt.date))
    rdf = spark.createDataFrame(
        [(k, d.date(), None if np.isnan(v) else float(v)) for k, d, v in right.itertuples(index=False)], "key string, date date, ind double"
    )
    got = align.asof_align(ldf, rdf, keys=K, columns=["ind"], left_is_unique=unique).orderBy("row").toPandas()
    assert len(got) == len(left)
    assert np.array_equal(got["ind"].to_numpy(dtype=float), want["ind"].to_numpy(dtype=float), equal_nan=True)


def test_outer_align(spark):
    a = series(spark, [("k", "2020-01-01", 1), ("k", "2020-01-02", 2)])
    b = series(spark, [("k", "2020-01-02", 3), ("k", "2020-01-03", None)])
    assert values(align.outer_align(a, b, keys=K), "a", "b") == [(1.0, None), (2.0, 3.0), (None, None)]


def ll(spark, frames, **options):
    """frames: {name: pandas Series of values}; the first is the indicator of every pair."""
    ind, *targets = frames
    rename = lambda k, c: series(spark, frames[k]).withColumnRenamed("key", c)
    tgt = rename(targets[0], "target")
    for t in targets[1:]:
        tgt = tgt.unionByName(rename(t, "target"))
    pairs = spark.createDataFrame([(ind, t) for t in targets], "indicator string, target string")
    return leadlag.lead_lag(rename(ind, "indicator"), tgt, pairs, **options)


def rows(name, vals, start="2015-01-01"):
    return [(name, d.isoformat(), None if v is None or np.isnan(v) else float(v)) for d, v in zip(months(start, len(vals)), vals)]


def test_lead_lag_finds_the_planted_lead(spark):
    x = pd.Series(np.random.default_rng(0).normal(size=60))
    out = ll(spark, {"i": rows("i", x), "t": rows("t", x.shift(2))}, max_lag=6)
    rep = leadlag.honesty_report(out, keys=["indicator", "target"]).collect()[0]
    assert rep.best_lag == 2 and rep.best_corr > 0.99 and rep.best_n == 58
    assert not rep.small_sample and rep.combinations_tested == 13 and len(rep.warnings) == 1


def test_lead_lag_against_pandas(spark):
    rng = np.random.default_rng(8)
    x = pd.Series(rng.normal(size=40), index=pd.date_range("2015-01-01", periods=40, freq="MS"))
    y = pd.Series(rng.normal(size=45), index=pd.date_range("2014-06-01", periods=45, freq="MS"))
    x[rng.random(40) < 0.2] = np.nan
    out = ll(spark, {"i": rows("i", x), "t": rows("t", y, "2014-06-01"), "flat": rows("flat", [1.0] * 30)}, max_lag=5)
    got = {(r.target, r.lag): (r.corr, r.n) for r in out.collect()}
    frame = pd.DataFrame({"a": x, "b": y}).dropna(how="all")
    for lag in range(-5, 6):
        pair = pd.DataFrame({"a": frame.a.shift(lag), "b": frame.b}).dropna()
        corr, n = got[("t", lag)]
        assert n == len(pair) and corr == pytest.approx(pair.a.corr(pair.b))
        assert got[("flat", lag)][0] is None


def test_lead_lag_without_enough_pairs(spark):
    out = ll(spark, {"i": rows("i", [1.0, 2.0]), "t": rows("t", [3.0, 5.0]), "none": []}, max_lag=2)
    got = {(r.target, r.lag): (r.corr, r.n) for r in out.collect()}
    assert got == {**{("t", k): (None, max(0, 2 - abs(k))) for k in range(-2, 3)}, **{("none", k): (None, 0) for k in range(-2, 3)}}
    rep = {r.target: r for r in leadlag.honesty_report(out, keys=["target"]).collect()}
    assert rep["none"].best_lag is None and rep["none"].small_sample


def test_honesty_counts_and_ties(spark):
    ramp = rows("i", np.arange(40.0))
    out = ll(spark, {"i": ramp, "t": [("t", d, v) for _, d, v in ramp]}, max_lag=12)
    rep = leadlag.honesty_report(out, keys=["target"], n_indicators_tested=10).collect()[0]
    assert rep.combinations_tested == 250 and rep.small_sample
    assert any("combinations tested" in w for w in rep.warnings) and len(rep.warnings) == 3
    tied = spark.createDataFrame([("t", lag, c, 50) for lag, c in ((-2, 0.5), (0, 0.1), (2, -0.5))], "target string, lag int, corr double, n long")
    assert leadlag.honesty_report(tied, keys=["target"]).collect()[0].best_lag == -2


def test_matrix(spark):
    tied = spark.createDataFrame([("i", "t", lag, lag / 10, 50) for lag in range(-1, 2)], "indicator string, target string, lag int, corr double, n long")
    assert leadlag.lead_lag_matrix(tied, 1).collect()[0].asDict() == {
        "indicator": "i", "target": "t", "lag_m1": -0.1, "lag_p0": 0.0, "lag_p1": 0.1,
    }
