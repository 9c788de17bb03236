import math

import numpy as np
import pandas as pd
import pytest
from helpers import by_key, day, month_ends, series, shuffled, values

from tidemark.operators import forecast


def price_frame(spark, returns_by_ticker, start="2000-01-31"):
    rows = []
    for ticker, r in returns_by_ticker.items():
        level = 100 * np.cumprod(1 + np.concatenate([[0.0], r]))
        rows += [(ticker, d.isoformat(), float(v)) for d, v in zip(month_ends(start, len(level)), level)]
    return series(spark, rows).withColumnRenamed("key", "ticker")


def refit(X, y, min_train, l2):
    """Ridge as least squares on an augmented system, refitted for every month."""
    out = []
    for i in range(min_train, len(X)):
        mean, sd = X[:i].mean(axis=0), X[:i].std(axis=0)
        sd = np.where(sd < 1e-12, 1.0, sd)
        Z = (X[:i] - mean) / sd
        A = np.vstack([Z, math.sqrt(l2) * np.eye(X.shape[1])])
        b = np.concatenate([y[:i] - y[:i].mean(), np.zeros(X.shape[1])])
        coef = np.linalg.lstsq(A, b, rcond=None)[0]
        out.append(y[:i].mean() + (X[i] - mean) / sd @ coef)
    return np.array(out)


def random_features(spark, tickers, n, k, offset=0.0, constant=False):
    rng = np.random.default_rng(4)
    data, frames = [], {}
    for t in tickers:
        X = rng.normal(size=(n, k)) * np.arange(1, k + 1) + offset
        if constant:
            X[:, 0] = 3.25
        y = X @ rng.normal(size=k) * 0.1 + rng.normal(size=n)
        frames[t] = (X, y)
        data += [(t, d, *map(float, X[i]), float(y[i])) for i, d in enumerate(month_ends("2000-01-31", n))]
    cols = ", ".join(f"f{i} double" for i in range(k))
    return spark.createDataFrame(data, f"ticker string, date date, {cols}, target double"), frames


@pytest.mark.parametrize("offset,constant", [(0.0, False), (1e4, False), (0.0, True)])
def test_walk_forward_equals_a_refit_per_month(spark, offset, constant):
    features, frames = random_features(spark, ["a", "b", "c"], 70, 5, offset, constant)
    got = forecast.walk_forward(shuffled(features), min_train=20, l2=3.0)
    for t, (X, y) in frames.items():
        pred = [v for (v,) in values(got.filter(got.ticker == t), "pred")]
        assert np.allclose(pred, refit(X, y, 20, 3.0), rtol=1e-7, atol=1e-9)
        assert [v for (v,) in values(got.filter(got.ticker == t), "actual")] == pytest.approx(list(y[20:]))


def test_too_little_history_gives_nothing(spark):
    features, _ = random_features(spark, ["a"], 20, 2)
    assert forecast.walk_forward(features, min_train=20).count() == 0
    assert forecast.walk_forward(features, min_train=19).count() == 1


def test_predictions_ignore_the_future(spark):
    features, _ = random_features(spark, ["a"], 50, 3)
    cut = features.filter("date <= '2003-06-30'")
    full = dict(values(forecast.walk_forward(features, min_train=20), "date", "pred"))
    part = dict(values(forecast.walk_forward(cut, min_train=20), "date", "pred"))
    assert part and all(full[d] == pytest.approx(v, rel=1e-12) for d, v in part.items())


def test_next_month_is_the_target(spark):
    r = np.linspace(0.01, 0.02, 60)
    rows = values(forecast.arx_features(price_frame(spark, {"a": r}, "2010-01-31"), ar_order=2), "date", "ret_lag0", "ret_lag1", "target")
    assert rows[0][0] == day("2010-03-31")
    assert [x[1] for x in rows] == pytest.approx(list(r[1:-1]))
    assert [x[2] for x in rows] == pytest.approx(list(r[:-2]))
    assert [x[3] for x in rows] == pytest.approx(list(r[2:]))


def test_features_against_pandas(spark):
    rng = np.random.default_rng(11)
    n = 60
    stocks = {t: rng.normal(0, 0.05, n) for t in ("a", "b", "c")}
    px = price_frame(spark, stocks)
    idx = pd.date_range("2000-01-31", periods=n + 1, freq="ME")
    level = {i: pd.Series(np.cumprod(1 + rng.normal(0, 0.03, n + 1)), index=idx) for i in ("ALL", "ALL_X")}
    level["ALL_X"] = level["ALL_X"].iloc[:40]
    levels = series(spark, [(i, d.date().isoformat(), float(v)) for i, s in level.items() for d, v in s.items()]).withColumnRenamed("key", "index_id")
    exog = {
        "long": pd.Series(rng.normal(100, 1, n), index=pd.date_range("1999-01-01", periods=n, freq="MS")),
        "short": pd.Series(rng.normal(100, 1, 30), index=pd.date_range("1999-06-01", periods=30, freq="MS")),
    }
    exog["long"].iloc[25] = np.nan
    ex = series(spark, [(k, d.date().isoformat(), v) for k, s in exog.items() for d, v in s.dropna().items()]).withColumnRenamed("key", "series_id")
    sectors = spark.createDataFrame([("a", "ALL_X"), ("b", "ALL_NONE")], "ticker string, index_id string")
    got = forecast.arx_features(px, exog=ex, exog_ids=["long", "short"], levels=levels, sectors=sectors, market_id="ALL")
    assert forecast.feature_names(got) == ["ret_lag0", "ret_lag1", "ret_lag2", "exog_long", "exog_short", "sector_mom", "market_mom"]

    wide = pd.DataFrame(exog).resample("ME").last().ffill()
    ex_yoy = (wide / wide.shift(12) - 1).shift(1)
    for t, r in stocks.items():
        months = idx[1:]
        want = pd.DataFrame({f"ret_lag{i}": pd.Series(r, index=months).shift(i) for i in range(3)})
        for c in ("long", "short"):
            want[f"exog_{c}"] = ex_yoy[c].reindex(months, method="ffill")
        mom = {i: (s / s.shift(3) - 1).reindex(months, method="ffill") for i, s in level.items()}
        want["sector_mom"] = mom["ALL_X"] if t == "a" else 0.0
        want["market_mom"] = mom["ALL"]
        want["target"] = pd.Series(r, index=months).shift(-1)
        want = want.dropna()
        rows = values(got.filter(got.ticker == t), "date", *want.columns)
        assert [x[0] for x in rows] == [d.date() for d in want.index]
        assert np.allclose([x[1:] for x in rows], want.to_numpy(), rtol=1e-9, atol=1e-12)


def ar1(phi, n, sd, seed):
    rng = np.random.default_rng(seed)
    r = np.zeros(n)
    for i in range(1, n):
        r[i] = phi * r[i - 1] + rng.normal(0, sd)
    return r


def test_signal_is_found_and_noise_is_not(spark):
    px = price_frame(spark, {"signal": ar1(0.5, 240, 0.02, 0), "noise": ar1(0.0, 240, 0.02, 7)})
    bt = forecast.backtest_stocks(px, min_train=24, l2=1.0)
    tickers = spark.createDataFrame([("signal",), ("noise",), ("none",)], "ticker string")
    m = by_key(forecast.forecast_metrics(bt, tickers), "ticker")
    assert m["signal"]["n"] > 100 and m["signal"]["beats_baseline"]
    assert m["signal"]["hit_rate"] > 0.5 and m["signal"]["oos_r2"] > 0
    assert m["noise"]["n"] > 100 and m["noise"]["oos_r2"] < 0.05
    assert m["none"] == {"ticker": "none", "n": 0, "rmse": None, "rmse_baseline": None, "oos_r2": None, "hit_rate": None, "beats_baseline": False}


def test_metrics_by_hand(spark):
    d = month_ends("2020-01-31", 4)
    rows = [("a", d[0], 1.0, 2.0), ("a", d[1], -1.0, 2.0), ("a", d[2], 5.0, 0.0), ("a", d[3], 0.0, 1.0), ("z", d[0], 1.0, 0.0)]
    bt = spark.createDataFrame(rows, "ticker string, date date, pred double, actual double")
    m = by_key(forecast.forecast_metrics(bt, bt.select("ticker").distinct()), "ticker")
    assert m["a"]["rmse"] == pytest.approx(math.sqrt(36 / 4)) and m["a"]["rmse_baseline"] == pytest.approx(1.5)
    assert m["a"]["oos_r2"] == pytest.approx(1 - 36 / 9) and m["a"]["hit_rate"] == pytest.approx(1 / 3)
    assert m["z"]["oos_r2"] is None and m["z"]["hit_rate"] is None and not m["z"]["beats_baseline"]


def test_leaderboard(spark):
    px = price_frame(spark, {"signal": ar1(0.5, 120, 0.02, 0), "noise": ar1(0.0, 120, 0.02, 7)})
    bt = forecast.backtest_stocks(px, min_train=24, l2=1.0)
    names = spark.createDataFrame([("signal", "Signal Inc", "s")], "ticker string, name string, subsector string")
    board = forecast.forecast_leaderboard(bt, spark.createDataFrame([("noise",), ("new",), ("signal",)], "ticker string"), names)
    assert [(r.ticker, r.name) for r in board.collect()] == [("signal", "Signal Inc"), ("noise", "noise"), ("new", "new")]
    total = forecast.leaderboard_summary(board).collect()[0]
    assert total.stocks == 3 and total.beats == sum(r.beats_baseline for r in board.collect())


def test_many_features_plan_and_run(spark):
    """200 features: the plan is that of two, and predictions are those of a refit."""
    features, frames = random_features(spark, ["a", "b"], 45, 200)
    few, _ = random_features(spark, ["a"], 45, 2)
    plans = [forecast.walk_forward(f)._jdf.queryExecution().executedPlan().toString() for f in (features, few)]
    assert all("Window" not in p for p in plans)
    assert len({tuple(p.count(node) for node in ("Exchange", "Sort", "FlatMapGroups", "Project")) for p in plans}) == 1
    got = forecast.walk_forward(features, min_train=36, l2=5.0)
    for t, (X, y) in frames.items():
        pred = [v for (v,) in values(got.filter(got.ticker == t), "pred")]
        assert np.allclose(pred, refit(X, y, 36, 5.0), rtol=1e-6, atol=1e-8)


def test_new_months_from_a_stored_state(spark, tmp_path):
    """State after part of the history, then the new months alone: as a walk over all of it. New tickers start empty."""
    features, _ = random_features(spark, ["a", "b", "late"], 70, 4, offset=50.0)
    cut = "2003-06-30"
    old = features.filter(f"date <= '{cut}' and ticker != 'late'")
    path = str(tmp_path / "state")
    forecast.gram_state(shuffled(old)).write.parquet(path)
    state = spark.read.parquet(path)
    want = dict(values(forecast.walk_forward(features, min_train=20).withColumn("k", forecast.F.concat("ticker", "date")), "k", "pred", order="k"))
    for new in (features, features.filter(f"date > '{cut}' or ticker = 'late'")):
        got = forecast.walk_forward_on(shuffled(new), state, min_train=20)
        rows = dict(values(got.withColumn("k", forecast.F.concat("ticker", "date")), "k", "pred", order="k"))
        expected = {k: v for k, v in want.items() if k.startswith("late") or k[1:] > cut}
        assert set(rows) == set(expected)
        assert all(rows[k] == pytest.approx(v, rel=1e-9) for k, v in expected.items())
    # The state moves on by the new months alone, and stands still where there is nothing new.
    after = {r["ticker"]: r for r in forecast.gram_state(features, state).collect()}
    whole = {r["ticker"]: r for r in forecast.gram_state(features).collect()}
    assert set(after) == set(whole) == {"a", "b", "late"}
    for t, r in whole.items():
        assert after[t]["last_date"] == r["last_date"]
        assert np.allclose(after[t]["sums"], r["sums"], rtol=1e-9, atol=1e-9)
    again = forecast.gram_state(old, state).collect()
    assert {r["ticker"]: r["last_date"] for r in again} == {"a": day(cut), "b": day(cut)}
    assert forecast.walk_forward_on(old, state, min_train=20).count() == 0
    with pytest.raises(Exception, match="features"):
        forecast.walk_forward_on(features.drop("f3"), state).collect()


def test_states_of_parts_merge():
    rng = np.random.default_rng(3)
    rows = rng.normal(100.0, 1.0, (60, 4))
    whole, a, b = (forecast.Gram.empty(rows[k]) for k in (0, 0, 25))
    for gram, some in ((whole, rows), (a, rows[:25]), (b, rows[25:])):
        gram.before_each(some)
    assert np.allclose(a.merged(b).sums, whole.sums, rtol=1e-10, atol=1e-8)
    assert np.allclose(b.moved(rows[3]).moved(rows[25]).sums, b.sums, rtol=1e-9, atol=1e-8)
    x = rng.normal(100.0, 1.0, (1, 3)) - whole.origin[:3]
    one, two = (forecast.ridge_fits(g.sums[None], x, 2.0)[0] for g in (whole, a.merged(b)))
    assert one == pytest.approx(two)


def test_walk_in_portions_equals_one(spark, monkeypatch):
    features, _ = random_features(spark, ["a"], 60, 3)
    rows = np.array([[r.f0, r.f1, r.f2, r.target] for r in features.orderBy("date").collect()])
    fits = []
    for cells in (4_000_000, 25, 130):
        monkeypatch.setattr(forecast, "_CELLS", cells)
        fits.append(forecast._walk(rows, forecast.Gram.empty(rows[0]), 20, 1.0))
    for other in fits[1:]:
        assert other[0] == 20 and all(np.allclose(x, y) for x, y in zip(fits[0][1:], other[1:]))


def test_empty_features(spark):
    features, _ = random_features(spark, ["a"], 5, 2)
    none = features.limit(0)
    assert forecast.walk_forward(none).count() == 0 and forecast.gram_state(none).count() == 0
    assert forecast.walk_forward_on(none, forecast.gram_state(features)).count() == 0


def test_indicator_features_have_one_window_for_any_number_of_series(spark):
    exog = series(spark, [("s0", d.isoformat(), 1.0 + k) for k, d in enumerate(month_ends("2000-01-31", 20))]).withColumnRenamed("key", "series_id")
    plans = [
        forecast.exog_features(exog, [f"s{k}" for k in range(n)])._jdf.queryExecution().executedPlan().toString() for n in (1, 60)
    ]
    assert plans[0].count("Window ") == plans[1].count("Window ")
    wide = forecast.exog_features(exog, [f"s{k}" for k in range(60)])
    rows = wide.orderBy("date").collect()
    assert len(rows) == 20 and len(wide.columns) == 61
    assert rows[13]["exog_s0"] == pytest.approx(13 / 1 - 1) and rows[12]["exog_s0"] is None and rows[13]["exog_s59"] is None
    assert forecast.exog_features(exog.limit(0), ["s0"]).collect() == []
