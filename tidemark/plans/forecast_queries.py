"""Registered queries: forecasting."""

from __future__ import annotations

from pyspark.sql import Observation, Window, functions as F

from tidemark.operators import forecast
from tidemark.plans import common as c
from tidemark.plans.oracle import r, sql
from tidemark.session import new_workspace
from tidemark.sources import driver_tables as tables


def exog_panel(spark, sf_dir):
    return forecast.exog_panel(c.current(spark, sf_dir))


def exog_features(spark, sf_dir):
    """One row per month and series of the catalogue, whatever series that has."""
    out = forecast.exog_features(forecast.exog_panel(c.current(spark, sf_dir)), c.series_ids(spark, sf_dir))
    return c.long_form(out, ["date"], "feature")


def arx_features(spark, sf_dir):
    """One row per ticker, month and feature; the target is named as one."""
    return c.long_form(c.features(spark, sf_dir), ["ticker", "date"], "feature")


def dropped_rows(spark, sf_dir):
    """Months that the complete-case rule drops, counted while the features are stored."""
    ledger = Observation("dropped rows")
    c.features(spark, sf_dir, ledger=ledger).write.parquet(new_workspace(spark, "features"))
    return forecast.dropped_rows(spark, ledger)


def walk_forward(spark, sf_dir):
    rows = forecast.walk_forward(c.features(spark, sf_dir))
    return rows.select("ticker", "date", c.r("pred").alias("pred"), c.r("actual").alias("actual"))


def ridge_coefficients(spark, sf_dir):
    """Every fit's coefficients, one row per feature, and its intercept."""
    rows = forecast.walk_forward(c.features(spark, sf_dir), coefficients=True)
    return rows.select("ticker", "date", c.r("intercept", 5).alias("intercept"), F.explode("coef").alias("feature", "coef")).withColumn(
        "coef", c.r("coef", 5)
    )


def walk_forward_ar1(spark, sf_dir):
    """One feature, last month's return: small enough to be followed in SQL."""
    rows = forecast.backtest_stocks(c.adjusted(spark, sf_dir), ar_order=1)
    return rows.select("ticker", "date", c.r("pred").alias("pred"), c.r("actual").alias("actual"))


def _naive(spark, sf_dir):
    """A predictor SQL can follow: next month repeats this month."""
    lags = c.stock_returns(spark, sf_dir)
    nxt = F.lead("ret").over(Window.partitionBy("ticker").orderBy("date"))
    rows = lags.select("ticker", "date", F.col("ret").alias("pred"), nxt.alias("actual"))
    return rows.filter(F.col("actual").isNotNull())


def _naive_metrics(spark, sf_dir):
    tickers = tables.securities(spark, sf_dir).select("ticker")
    return forecast.forecast_metrics(_naive(spark, sf_dir), tickers)


def forecast_metrics(spark, sf_dir):
    rows = _naive_metrics(spark, sf_dir)
    for name in ("rmse", "rmse_baseline", "oos_r2", "hit_rate"):
        rows = rows.withColumn(name, c.r(name))
    return rows


def forecast_leaderboard(spark, sf_dir):
    """Only the current constituents are modelled; the indices behind the features still hold all members."""
    members = c.latest(spark, sf_dir).filter(F.col("index_id") == c.MARKET).select("ticker")
    tested = forecast.walk_forward(c.features(spark, sf_dir, only=members))
    board = forecast.forecast_leaderboard(tested, members, tables.securities(spark, sf_dir))
    for name in ("rmse", "rmse_baseline", "oos_r2", "hit_rate"):
        board = board.withColumn(name, c.r(name))
    return board


def leaderboard_summary(spark, sf_dir):
    out = forecast.leaderboard_summary(_naive_metrics(spark, sf_dir))
    return out.withColumn("avg_hit_rate", c.r("avg_hit_rate"))


_NAIVE = """
    , naive AS MATERIALIZED (
        SELECT * FROM (SELECT ticker, date, ret AS pred, lead(ret) OVER (PARTITION BY ticker ORDER BY date) AS actual
                       FROM ret)
        WHERE actual IS NOT NULL),
    scored AS MATERIALIZED (
        SELECT ticker, count(pred) AS n, sqrt(sum((actual - pred) ** 2) / nullif(count(pred), 0)) AS rmse,
               sqrt(sum(actual ** 2) / nullif(count(pred), 0)) AS rmse_baseline,
               1 - sum((actual - pred) ** 2) / nullif(sum(actual ** 2), 0) AS oos_r2,
               avg(CASE WHEN actual <> 0 THEN CASE WHEN sign(pred) = sign(actual) THEN 1.0 ELSE 0.0 END END) AS hit_rate
        FROM sec LEFT JOIN naive USING (ticker) GROUP BY ticker)"""

_AR1 = f"""
    SELECT ticker, date,
           {r("sy / n + (x - sx / n) / sd * ((sxy - sx * sy / n) / sd / (n + 10))")} AS pred, {r("y")} AS actual
    FROM (SELECT ticker, date, x, y, count(*) OVER w AS n, avg(x) OVER w * count(*) OVER w AS sx,
                 avg(y) OVER w * count(*) OVER w AS sy, sum(x * y) OVER w AS sxy, stddev_pop(x) OVER w AS sd
          FROM (SELECT ticker, date, ret AS x, lead(ret) OVER (PARTITION BY ticker ORDER BY date) AS y FROM ret)
          WHERE y IS NOT NULL
          WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    WHERE n >= 36"""

# Features by name, for complete rows: those with every feature that the catalogue asks for.
_DESIGN = """
    , months AS MATERIALIZED (
        SELECT a.ticker, a.date, a.m, a.ret AS ret_lag0, lag(a.ret) OVER w AS ret_lag1, lag(a.ret, 2) OVER w AS ret_lag2,
               lead(a.ret) OVER w AS target, 'ALL_' || upper(sec.subsector) AS sector_id
        FROM ret a JOIN sec USING (ticker) WINDOW w AS (PARTITION BY a.ticker ORDER BY a.m)),
    named AS MATERIALIZED (
        SELECT ticker, date, unnest(['ret_lag0', 'ret_lag1', 'ret_lag2', 'target']) AS feature,
               unnest([ret_lag0, ret_lag1, ret_lag2, target]) AS value FROM months
        UNION ALL
        SELECT k.ticker, k.date, 'exog_' || k.series_id, e.x
        FROM (SELECT ticker, date, m, series_id FROM months CROSS JOIN (SELECT DISTINCT series_id FROM spec)) k
        ASOF LEFT JOIN exog e ON k.series_id = e.series_id AND k.m >= e.m
        UNION ALL
        SELECT a.ticker, a.date, 'sector_mom', s.momentum
        FROM months a ASOF LEFT JOIN mom s ON a.sector_id = s.index_id AND a.m >= s.m
        UNION ALL
        SELECT a.ticker, a.date, 'market_mom', k.momentum
        FROM months a ASOF LEFT JOIN (SELECT * FROM mom WHERE index_id = 'ALL') k ON a.m >= k.m),
    design AS MATERIALIZED (
        SELECT ticker, date, feature, value FROM named
        QUALIFY count(value) OVER (PARTITION BY ticker, date) = count(*) OVER (PARTITION BY ticker, date))"""

# Ridge by hand: covariances over the earlier rows of each ticker, one Gauss-Jordan step per
# feature on the standardised matrix. The ridge makes it positive definite, so no pivoting.
_RIDGE = f"""
    {_DESIGN},
    cells AS MATERIALIZED (
        SELECT ticker, date, feature, value AS x, max(value) FILTER (feature = 'target') OVER (PARTITION BY ticker, date) AS y
        FROM design),
    x AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY feature) AS i FROM cells WHERE feature <> 'target'),
    moments AS MATERIALIZED (
        SELECT a.ticker, a.date, a.i, b.i AS j, a.feature, a.x, a.y, count(*) OVER w AS n, covar_pop(a.x, b.x) OVER w AS c,
               covar_pop(a.x, a.y) OVER w AS cy, avg(a.x) OVER w AS mx, avg(a.y) OVER w AS my,
               CASE WHEN min(a.x) OVER w < max(a.x) OVER w THEN stddev_pop(a.x) OVER w END AS si,
               CASE WHEN min(b.x) OVER w < max(b.x) OVER w THEN stddev_pop(b.x) OVER w END AS sj
        FROM x a JOIN x b USING (ticker, date)
        WINDOW w AS (PARTITION BY a.ticker, a.i, b.i ORDER BY a.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    lines AS MATERIALIZED (
        SELECT ticker, date, i, any_value(feature) AS feature, any_value(y) AS y, any_value(my) AS my, any_value(mx) AS mx,
               any_value(x) AS x, any_value(si) AS s,
               list_append(list(coalesce(n * c / (si * sj), 0) + CASE WHEN i = j THEN 10 ELSE 0 END ORDER BY j),
                           any_value(coalesce(n * cy / si, 0))) AS line
        FROM moments WHERE n >= 36 GROUP BY ticker, date, i),
    solved AS (
        WITH RECURSIVE step AS (
            SELECT 0 AS p, ticker, date, list(line ORDER BY i) AS a FROM lines GROUP BY ticker, date
            UNION ALL
            SELECT p + 1, ticker, date, list_transform(a, lambda row, i: CASE WHEN i = p + 1 THEN row
                ELSE list_transform(row, lambda v, j: v - row[p + 1] / a[p + 1][p + 1] * a[p + 1][j]) END)
            FROM step WHERE p < len(a))
        SELECT ticker, date, a FROM step WHERE p = len(a)),
    coefs AS MATERIALIZED (
        SELECT ticker, date, i, feature, y, my, mx, x, coalesce(a[i][len(a) + 1] / a[i][i] / s, 0) AS coef
        FROM lines JOIN solved USING (ticker, date)),
    fits AS MATERIALIZED (
        SELECT ticker, date, any_value(my) + sum((x - mx) * coef) AS pred, any_value(y) AS actual,
               any_value(my) - sum(mx * coef) AS intercept
        FROM coefs GROUP BY ticker, date)"""

_BOARD = f"""
    {_RIDGE},
    board AS MATERIALIZED (
        SELECT ticker, count(pred) AS n, sqrt(sum((actual - pred) ** 2) / nullif(count(pred), 0)) AS rmse,
               sqrt(sum(actual ** 2) / nullif(count(pred), 0)) AS rmse_baseline,
               1 - sum((actual - pred) ** 2) / nullif(sum(actual ** 2), 0) AS oos_r2,
               avg(CASE WHEN actual <> 0 THEN CASE WHEN sign(pred) = sign(actual) THEN 1.0 ELSE 0.0 END END) AS hit_rate
        FROM (SELECT ticker FROM lastw WHERE index_id = 'ALL') LEFT JOIN fits USING (ticker) GROUP BY ticker)
    SELECT ticker, coalesce(name, ticker) AS name, subsector, n, {r('rmse')} AS rmse, {r('rmse_baseline')} AS rmse_baseline,
           {r('oos_r2')} AS oos_r2, {r('hit_rate')} AS hit_rate, coalesce(rmse < rmse_baseline, false) AS beats_baseline
    FROM board LEFT JOIN sec USING (ticker) ORDER BY board.oos_r2 DESC NULLS LAST, ticker"""

_MODEL = ("ret", "sec", "exog", "mom", "spec")

QUERIES = {
    "exog_panel": (exog_panel, sql("SELECT series_id, date, value FROM cur", "cur")),
    "exog_features": (
        exog_features,
        sql(
            f"""SELECT last_day(i.m) AS date, 'exog_' || series_id AS feature, {r('x')} AS value
                FROM (SELECT DISTINCT m, s.series_id FROM exog CROSS JOIN spec s) i LEFT JOIN exog USING (m, series_id)""",
            "exog", "spec",
        ),
    ),
    "arx_features": (
        arx_features,
        sql(
            f"{_DESIGN} SELECT ticker, date, feature, {r('value')} AS value FROM design",
            "ret", "sec", "exog", "mom", "spec",
        ),
    ),
    "dropped_rows": (
        dropped_rows,
        sql(
            f"""{_DESIGN}, placed AS MATERIALIZED (
                    SELECT *, CASE WHEN feature LIKE 'ret_lag%' THEN 0 WHEN feature LIKE 'exog_%' THEN 1
                                   WHEN feature = 'sector_mom' THEN 2 WHEN feature = 'market_mom' THEN 3 ELSE 4 END AS place
                    FROM named)
                SELECT feature, coalesce(n, 0) AS dropped, (SELECT count(*) FROM months) AS rows
                FROM (SELECT DISTINCT feature FROM named) LEFT JOIN (
                    SELECT feature, count(*) AS n FROM (
                        SELECT * FROM placed WHERE value IS NULL
                        QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY place, feature) = 1)
                    GROUP BY feature) USING (feature)""",
            *_MODEL,
        ),
    ),
    "walk_forward_ar1": (walk_forward_ar1, sql(_AR1, "ret")),
    "walk_forward": (
        walk_forward,
        sql(f"{_RIDGE} SELECT ticker, date, {r('pred')} AS pred, {r('actual')} AS actual FROM fits", *_MODEL),
    ),
    "ridge_coefficients": (
        ridge_coefficients,
        sql(
            f"""{_RIDGE} SELECT ticker, date, {r('intercept', 5)} AS intercept, feature, {r('coef', 5)} AS coef
                FROM coefs JOIN fits USING (ticker, date)""",
            *_MODEL,
        ),
    ),
    "forecast_leaderboard": (forecast_leaderboard, sql(_BOARD, *_MODEL, "lastw")),
    "forecast_metrics": (
        forecast_metrics,
        sql(
            f"""{_NAIVE} SELECT ticker, n, {r('rmse')} AS rmse, {r('rmse_baseline')} AS rmse_baseline,
                {r('oos_r2')} AS oos_r2, {r('hit_rate')} AS hit_rate,
                coalesce(rmse < rmse_baseline, false) AS beats_baseline FROM scored""",
            "ret", "sec",
        ),
    ),
    "leaderboard_summary": (
        leaderboard_summary,
        sql(
            f"""{_NAIVE} SELECT count(*) AS stocks, count(*) FILTER (rmse < rmse_baseline) AS beats,
                {r('avg(hit_rate)')} AS avg_hit_rate FROM scored""",
            "ret", "sec",
        ),
    ),
}
