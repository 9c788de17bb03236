"""Registered queries: alignment, signals, lead-lag."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import align, leadlag, signals
from tidemark.plans import common as c
from tidemark.plans.oracle import r, sql
from tidemark.sources import driver_tables as tables

MAX_LAG = 12


def asof_align(spark, sf_dir):
    """Each order line with the share count known on its shipping day."""
    lines = tables.raw_prints(spark, sf_dir).select("ticker", "date", "l_orderkey", "l_linenumber")
    return align.asof_align(
        lines, tables.share_counts(spark, sf_dir), keys=["ticker"], columns=["shares"], tie="seq",
        left_is_unique=True,  # few lines of a ticker share a day
    )


def asof_indicator(spark, sf_dir):
    """Index levels with the market's monthly order value per segment, as of each day."""
    levels = c.total_return(spark, sf_dir).filter(F.col("index_id") == c.MARKET)
    series = F.explode(F.array(*[F.lit(s) for s in c.series_ids(spark, sf_dir)])).alias("series_id")
    left = levels.select(series, "date", F.col("value").alias("level"))
    right = c.current(spark, sf_dir).select("series_id", "date", "value")
    return align.asof_align(
        left, right, keys=["series_id"], columns=["value"], left_is_unique=True
    ).select("series_id", "date", c.sig("level").alias("level"), "value")


def asof_known(spark, sf_dir):
    """Each day of the market index with the newest order month known then, per segment, as known then."""
    days = c.total_return(spark, sf_dir).filter(F.col("index_id") == c.MARKET).select("date")
    series = F.explode(F.array(*[F.lit(s) for s in c.series_ids(spark, sf_dir)])).alias("series_id")
    vintages = tables.observations(spark, sf_dir).select("series_id", "date", "as_of", "value")
    return align.asof_known(days.select(series, "date"), vintages, keys=["series_id"])


def _stock_with_sector(spark, sf_dir):
    """(ticker, date, a, b): each stock's adjusted close next to its sector index."""
    # By (index, day) and not by index alone: a sector may hold a third of all stocks.
    return (
        c.adjusted(spark, sf_dir)
        .join(c.sector_of(spark, sf_dir), "ticker")
        .withColumnRenamed("value", "a")
        .join(c.total_return(spark, sf_dir).withColumnRenamed("value", "b"), ["index_id", "date"])
        .select("ticker", "date", "a", "b")
    )


def relative_strength(spark, sf_dir):
    return signals.strength_of(_stock_with_sector(spark, sf_dir), keys=["ticker"]).select(
        "ticker", "date", c.sig("strength").alias("strength")
    )


def rebased_pair(spark, sf_dir):
    return signals.rebased_of(_stock_with_sector(spark, sf_dir), keys=["ticker"]).select(
        "ticker", "date", c.sig("a").alias("a"), c.sig("b").alias("b")
    )


def outer_align(spark, sf_dir):
    base = tables.prices(spark, sf_dir).select("ticker", "date", F.col("close").alias("value"))
    counts = (
        tables.share_counts(spark, sf_dir).groupBy("ticker", "date").agg(F.max_by("shares", "seq").alias("value"))
    )
    return align.outer_align(base, counts, keys=["ticker"])


def subsector_tracks(spark, sf_dir):
    levels = c.total_return(spark, sf_dir).filter(F.col("index_id") != c.MARKET)
    return signals.rebased_tracks(levels).select("index_id", "date", c.sig("rebased").alias("rebased"))


def month_last(spark, sf_dir):
    return align.month_last(c.adjusted(spark, sf_dir), keys=["ticker"])


def yoy(spark, sf_dir):
    rows = c.current(spark, sf_dir).join(
        c.series_meta(spark, sf_dir).select("source", "series_id", "frequency"), ["source", "series_id"]
    )
    return signals.yoy(rows, keys=["source", "series_id"], frequency="frequency").select(
        "source", "series_id", "date", c.r("yoy").alias("yoy")
    )


def mom(spark, sf_dir):
    out = signals.mom(c.adjusted(spark, sf_dir), keys=["ticker"])
    return out.select("ticker", "date", c.r("mom").alias("mom"))


def qoq(spark, sf_dir):
    out = signals.qoq(c.current(spark, sf_dir), keys=["source", "series_id"])
    return out.select("source", "series_id", "date", c.r("qoq").alias("qoq"))


def zscore(spark, sf_dir):
    out = signals.zscore(c.adjusted(spark, sf_dir), 20, keys=["ticker"])
    return out.select("ticker", "date", c.r("zscore").alias("zscore"))


def smooth(spark, sf_dir):
    out = signals.smooth(c.adjusted(spark, sf_dir), 20, keys=["ticker"])
    return out.select("ticker", "date", c.r("smooth", 4).alias("smooth"))


def diffusion(spark, sf_dir):
    """Share of each sector's stocks that rose on the day."""
    rows = c.adjusted(spark, sf_dir).join(c.sector_of(spark, sf_dir), "ticker")
    out = signals.diffusion(rows, keys=["ticker"], panel=["index_id"])
    return out.select("index_id", "date", c.r("diffusion").alias("diffusion"))


def monthly_returns(spark, sf_dir):
    return c.stock_returns(spark, sf_dir).select("ticker", "date", c.r("ret").alias("ret"))


def momentum(spark, sf_dir):
    out = signals.momentum(c.total_return(spark, sf_dir), 3, keys=["index_id"])
    return out.select("index_id", "date", c.r("momentum").alias("momentum"))


def monthly_yoy(spark, sf_dir):
    out = signals.monthly_yoy(c.adjusted(spark, sf_dir), keys=["ticker"])
    return out.select("ticker", "date", c.r("yoy").alias("yoy"))


def ar_lags(spark, sf_dir):
    out = signals.ar_lags(c.stock_returns(spark, sf_dir), 3, keys=["ticker"])
    return out.select("ticker", "date", *[c.r(f"ret_lag{i}").alias(f"ret_lag{i}") for i in range(3)])


def indicator_detail(spark, sf_dir):
    out = signals.indicator_detail(c.current(spark, sf_dir), keys=["source", "series_id"])
    return out.select("source", "series_id", "date", "value", c.r("yoy_pct", 4).alias("yoy_pct"))


def _sector_pairs(spark, sf_dir):
    return c.sector_of(spark, sf_dir).select(F.col("ticker").alias("indicator"), F.col("index_id").alias("target"))


def _lead_lag(spark, sf_dir):
    """Every stock's monthly returns against those of its sector index."""
    stocks = c.stock_returns(spark, sf_dir).select(F.col("ticker").alias("indicator"), "date", F.col("ret").alias("value"))
    sectors = signals.monthly_returns(c.total_return(spark, sf_dir), keys=["index_id"]).select(
        F.col("index_id").alias("target"), "date", F.col("ret").alias("value")
    )
    return leadlag.lead_lag(stocks, sectors, _sector_pairs(spark, sf_dir), max_lag=MAX_LAG)


def lead_lag(spark, sf_dir):
    return _lead_lag(spark, sf_dir).withColumn("corr", c.r("corr"))


def _indicators_vs_market(spark, sf_dir):
    """Year-over-year changes of the monthly indicators against the whole index."""
    ind = signals.monthly_yoy(
        c.current(spark, sf_dir), keys=["series_id"]
    ).select(F.col("series_id").alias("indicator"), "date", F.col("yoy").alias("value"))
    market = c.total_return(spark, sf_dir).filter(F.col("index_id") == c.MARKET)
    tgt = signals.monthly_yoy(market, keys=["index_id"]).select(
        F.col("index_id").alias("target"), "date", F.col("yoy").alias("value")
    )
    # Not a bare literal, which would turn the join on the target into a product.
    target = F.when(F.col("series_id").isNotNull(), F.lit(c.MARKET))
    pairs = tables.series_specs(spark, sf_dir).select(F.col("series_id").alias("indicator"), target.alias("target"))
    return leadlag.lead_lag(ind, tgt, pairs, max_lag=MAX_LAG)


def lead_lag_matrix(spark, sf_dir):
    wide = leadlag.lead_lag_matrix(_indicators_vs_market(spark, sf_dir), MAX_LAG)
    return wide.select("indicator", "target", *[c.r(n).alias(n) for n in wide.columns if n.startswith("lag_")])


def honesty_report(spark, sf_dir):
    tested = _sector_pairs(spark, sf_dir).select(F.countDistinct("indicator"))
    out = leadlag.honesty_report(
        _lead_lag(spark, sf_dir), keys=["indicator", "target"], n_indicators_tested=tested
    )
    return out.withColumns(
        {"best_corr": c.r("best_corr"), "warnings": F.array_join("warnings", " | ")}
    )


def _ll(ind: str, tgt: str, pair: str) -> str:
    """Self join on shifted row numbers over the outer-joined dates of each pair."""
    return f"""
    merged AS MATERIALIZED (
        SELECT indicator, target, coalesce(a.m, b.m) AS m, a.v AS ind, b.v AS tgt
        FROM (SELECT p.indicator, p.target, x.m, x.v FROM {pair} p JOIN {ind} x USING (indicator) WHERE x.v IS NOT NULL) a
        FULL JOIN (SELECT p.indicator, p.target, x.m, x.v FROM {pair} p JOIN {tgt} x USING (target) WHERE x.v IS NOT NULL) b
        USING (indicator, target, m)),
    numbered AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY indicator, target ORDER BY m) AS rn FROM merged),
    lagged AS MATERIALIZED (
        SELECT p.indicator, p.target, l.lag, j.x, j.y
        FROM {pair} p CROSS JOIN (SELECT unnest(generate_series(-12, 12)) AS lag) l
        LEFT JOIN (SELECT t.indicator, t.target, t.rn - i.rn AS lag, i.ind AS x, t.tgt AS y
                   FROM numbered t JOIN numbered i ON t.indicator = i.indicator AND t.target = i.target
                     AND t.rn - i.rn BETWEEN -12 AND 12
                   WHERE i.ind IS NOT NULL AND t.tgt IS NOT NULL) j
          ON j.indicator = p.indicator AND j.target = p.target AND j.lag = l.lag),
    ll AS MATERIALIZED (
        SELECT indicator, target, lag,
               CASE WHEN count(x) >= 3 THEN covar_pop(y, x) / nullif(stddev_pop(x) * stddev_pop(y), 0) END AS corr,
               count(x) AS n
        FROM lagged GROUP BY indicator, target, lag)"""


_STOCK_LL = (
    """, pr AS MATERIALIZED (SELECT ticker AS indicator, 'ALL_' || upper(subsector) AS target FROM sec),
    stk AS MATERIALIZED (SELECT ticker AS indicator, m, ret AS v FROM ret),
    ixr AS MATERIALIZED (SELECT index_id AS target, m, ret AS v FROM mom), """
    + _ll("stk", "ixr", "pr")
)
_SEGMENT_LL = (
    """, pr AS MATERIALIZED (SELECT series_id AS indicator, 'ALL' AS target FROM spec),
    seg AS MATERIALIZED (
        SELECT series_id AS indicator, m, pad / lag(pad, 12) OVER (PARTITION BY series_id ORDER BY m) - 1 AS v
        FROM (SELECT series_id, m, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY m) AS pad
              FROM (SELECT s.series_id, s.m, c.value
                    FROM (SELECT series_id, cast(unnest(generate_series(min(date), max(date), interval 1 month)) AS date) AS m
                          FROM cur GROUP BY series_id) s
                    LEFT JOIN cur c ON c.series_id = s.series_id AND c.date = s.m))),
    ixy AS MATERIALIZED (
        SELECT index_id AS target, m, pad / lag(pad, 12) OVER (PARTITION BY index_id ORDER BY m) - 1 AS v
        FROM ilev WHERE index_id = 'ALL'), """
    + _ll("seg", "ixy", "pr")
)


_HONESTY = f"""
    SELECT indicator, target, best_lag::integer AS best_lag, {r('best_corr')} AS best_corr, best_n, combos AS combinations_tested,
           min_n < 30 AS small_sample,
           concat_ws(' | ',
             CASE WHEN min_n < 30 THEN 'Small effective sample (<30) at one or more lags; correlations unstable.' END,
             CASE WHEN combos > 20 THEN combos || ' indicator x lag combinations tested; expect spurious '
               || '''significant'' hits by chance. Prefer a pre-registered hypothesis.' END,
             'Exploratory only -- not a predictive or trading signal.') AS warnings
    FROM (SELECT indicator, target, count(*) * (SELECT count(*) FROM (SELECT DISTINCT ticker FROM sec)) AS combos, min(n) AS min_n
          FROM ll GROUP BY ALL)
    LEFT JOIN (SELECT indicator, target, lag AS best_lag, corr AS best_corr, n AS best_n FROM ll
               WHERE corr IS NOT NULL
               QUALIFY row_number() OVER (PARTITION BY indicator, target ORDER BY abs(corr) DESC, lag) = 1)
    USING (indicator, target)"""

_MATRIX = (
    "SELECT indicator, target, "
    + ", ".join(
        f"{r(f'max(corr) FILTER (lag = {lag})')} AS lag_{'m' if lag < 0 else 'p'}{abs(lag)}"
        for lag in range(-MAX_LAG, MAX_LAG + 1)
    )
    + " FROM ll GROUP BY indicator, target"
)

_PAIR = """
    SELECT x.ticker, x.date, x.adj_close AS a, l.level_tr AS b
    FROM px x JOIN sec s USING (ticker) JOIN lev l ON l.index_id = 'ALL_' || upper(s.subsector) AND l.date = x.date"""

QUERIES = {
    "asof_align": (
        asof_align,
        sql(
            """SELECT p.ticker, p.date, p.l_orderkey, p.l_linenumber, h.shares
               FROM line p ASOF LEFT JOIN (
                   SELECT ticker, date, shares FROM counts) h
               ON p.ticker = h.ticker AND p.date >= h.date""",
            "line", "counts",
        ),
    ),
    "asof_indicator": (
        asof_indicator,
        sql(
            """SELECT s.series_id, l.date, cast(cast(l.level_tr AS float) AS double) AS level, c.value
               FROM (SELECT date, level_tr FROM lev WHERE index_id = 'ALL') l CROSS JOIN spec s
               ASOF LEFT JOIN cur c ON c.series_id = s.series_id AND l.date >= c.date""",
            "lev", "spec", "cur",
        ),
    ),
    "asof_known": (
        asof_known,
        sql(
            """SELECT d.series_id, d.date, best.date AS period, best.value AS value
               FROM (SELECT DISTINCT date, series_id FROM (SELECT date FROM px) CROSS JOIN spec) d
               ASOF LEFT JOIN (
                   SELECT series_id, as_of, max({'date': date, 'as_of': as_of, 'value': value}) OVER (
                       PARTITION BY series_id ORDER BY as_of RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best
                   FROM obs) o
               ON d.series_id = o.series_id AND d.date >= o.as_of""",
            "px", "spec", "obs",
        ),
    ),
    "relative_strength": (
        relative_strength,
        sql(
            f"""SELECT ticker, date, cast(cast(a / b / first_value(a / b) OVER w * 100 AS float) AS double) AS strength
                FROM ({_PAIR}) WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
            "px", "sec", "lev",
        ),
    ),
    "rebased_pair": (
        rebased_pair,
        sql(
            f"""SELECT ticker, date, cast(cast(a / first_value(a) OVER w * 100 AS float) AS double) AS a,
                       cast(cast(b / first_value(b) OVER w * 100 AS float) AS double) AS b
                FROM ({_PAIR}) WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
            "px", "sec", "lev",
        ),
    ),
    "outer_align": (
        outer_align,
        sql(
            """SELECT ticker, date, x.close AS a, h.shares AS b FROM px x
               FULL JOIN counts h USING (ticker, date)""",
            "px", "counts",
        ),
    ),
    "subsector_tracks": (
        subsector_tracks,
        sql(
            """SELECT index_id, date, cast(cast(level_tr / first_value(level_tr) OVER w * 100 AS float) AS double) AS rebased
               FROM lev WHERE index_id <> 'ALL' AND date >= (
                   SELECT min(date) FROM (SELECT date FROM lev WHERE index_id <> 'ALL' GROUP BY date
                     HAVING count(*) = (SELECT count(DISTINCT index_id) FROM lev WHERE index_id <> 'ALL')))
               WINDOW w AS (PARTITION BY index_id ORDER BY date)""",
            "lev",
        ),
    ),
    "month_last": (month_last, sql("SELECT ticker, date, v AS value FROM mpr", "mpr")),
    "yoy": (
        yoy,
        sql(
            f"""SELECT source, series_id, date,
                       {r("value / (CASE WHEN frequency = 'Q' THEN lag(value, 4) OVER w ELSE lag(value, 12) OVER w END) - 1")} AS yoy
                FROM cur JOIN spec USING (source, series_id)
                WINDOW w AS (PARTITION BY source, series_id ORDER BY date)""",
            "cur", "spec",
        ),
    ),
    "mom": (
        mom,
        sql(
            f"""SELECT ticker, date, {r('adj_close / lag(adj_close) OVER w - 1')} AS mom
                FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
            "px",
        ),
    ),
    "qoq": (
        qoq,
        sql(
            f"""SELECT source, series_id, date, {r('value / lag(value) OVER w - 1')} AS qoq
                FROM cur WINDOW w AS (PARTITION BY source, series_id ORDER BY date)""",
            "cur",
        ),
    ),
    "zscore": (
        zscore,
        sql(
            f"""SELECT ticker, date, CASE WHEN count(adj_close) OVER w = 20 THEN
                       {r('(adj_close - avg(adj_close) OVER w) / nullif(stddev_samp(adj_close) OVER w, 0)')} END AS zscore
                FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
            "px",
        ),
    ),
    "smooth": (
        smooth,
        sql(
            f"""SELECT ticker, date, CASE WHEN count(adj_close) OVER w = 20 THEN {r('avg(adj_close) OVER w', 4)} END AS smooth
                FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
            "px",
        ),
    ),
    "diffusion": (
        diffusion,
        sql(
            f"""SELECT index_id, date, {r('cast(sum(CASE WHEN v - pv > 0 THEN 1 ELSE 0 END) AS double) / nullif(count(v), 0)')} AS diffusion
                FROM (SELECT g.index_id, g.ticker, g.date, x.adj_close AS v,
                             lag(x.adj_close) OVER (PARTITION BY g.index_id, g.ticker ORDER BY g.date) AS pv
                      FROM (SELECT d.index_id, s.ticker, d.date FROM days d
                            JOIN sec s ON d.index_id = 'ALL_' || upper(s.subsector)) g
                      LEFT JOIN px x USING (ticker, date))
                GROUP BY index_id, date""",
            "days", "sec", "px",
        ),
    ),
    "monthly_returns": (monthly_returns, sql(f"SELECT ticker, date, {r('ret')} AS ret FROM ret", "ret")),
    "momentum": (momentum, sql(f"SELECT index_id, date, {r('momentum')} AS momentum FROM mom", "mom")),
    "monthly_yoy": (
        monthly_yoy,
        sql(
            f"""SELECT ticker, m AS date, {r('pad / lag(pad, 12) OVER (PARTITION BY ticker ORDER BY m) - 1')} AS yoy
                FROM mpr""",
            "mpr",
        ),
    ),
    "ar_lags": (
        ar_lags,
        sql(
            f"""SELECT ticker, date, {r('ret')} AS ret_lag0, {r('lag(ret) OVER w')} AS ret_lag1,
                       {r('lag(ret, 2) OVER w')} AS ret_lag2
                FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
            "ret",
        ),
    ),
    "indicator_detail": (
        indicator_detail,
        sql(
            f"""SELECT source, series_id, date, value, {r('(value / lag(value, 12) OVER w - 1) * 100', 4)} AS yoy_pct
                FROM cur WINDOW w AS (PARTITION BY source, series_id ORDER BY date)""",
            "cur",
        ),
    ),
    "lead_lag": (
        lead_lag,
        sql(
            f"{_STOCK_LL} SELECT indicator, target, lag::integer AS lag, {r('corr')} AS corr, n FROM ll", "sec", "ret", "mom"
        ),
    ),
    "lead_lag_matrix": (lead_lag_matrix, sql(f"{_SEGMENT_LL} {_MATRIX}", "spec", "cur", "ilev")),
    "honesty_report": (honesty_report, sql(f"{_STOCK_LL} {_HONESTY}", "sec", "ret", "mom")),
}
