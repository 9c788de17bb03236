"""Registered queries: index construction and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import index, readers, reports, universe
from tidemark.plans import common as c
from tidemark.plans.oracle import r, sig, sql
from tidemark.sources import driver_tables as tables

WINDOW_DAYS = 365


def _shown(levels):
    return levels.select(
        "index_id", "date", c.sig("level_pr").alias("level_pr"), c.sig("level_tr").alias("level_tr")
    )


def build_index(spark, sf_dir):
    return _shown(c.index_levels(spark, sf_dir))


def index_levels_chain(spark, sf_dir):
    chain = index.index_levels_chain(
        tables.prices(spark, sf_dir), c.members(spark, sf_dir), base_date=c.BASE_DATE
    )
    numbers = ["growth_pr", "growth_tr", "factor_pr", "factor_tr"]
    return chain.select("index_id", "date", "rebalance_date", *[c.sig(x).alias(x) for x in numbers])


def baseline_index(spark, sf_dir):
    return _shown(index.baseline_index(tables.baseline_prices(spark, sf_dir), tables.baselines(spark, sf_dir)))


def _all_levels(spark, sf_dir):
    levels, _ = index.build_all_indices(
        tables.prices(spark, sf_dir), c.members(spark, sf_dir),
        tables.baseline_prices(spark, sf_dir), tables.baselines(spark, sf_dir), base_date=c.BASE_DATE,
    )
    return levels


def build_all_indices(spark, sf_dir):
    return _shown(_all_levels(spark, sf_dir))


def _weights(spark, sf_dir, rebalance="Q"):
    rows = index.index_weights(
        tables.prices(spark, sf_dir), c.members(spark, sf_dir), base_date=c.BASE_DATE, rebalance=rebalance
    )
    return rows.withColumn("weight", c.sig("weight"))


def target_weights(spark, sf_dir):
    """Monthly rebalances."""
    return _weights(spark, sf_dir, "M")


def rebalance_dates(spark, sf_dir):
    """Quarterly, monthly and annual dates of every index."""
    px, mem = tables.prices(spark, sf_dir), c.members(spark, sf_dir)
    parts = [
        index.rebalance_dates(px, mem, base_date=c.BASE_DATE, rebalance=code).withColumn("code", F.lit(code))
        for code in ("Q", "M", "A")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def eligible_members(spark, sf_dir):
    mem = c.members(spark, sf_dir)
    dates = index.rebalance_dates(tables.prices(spark, sf_dir), mem, base_date=c.BASE_DATE)
    return universe.eligible_members(mem, dates)


def _benchmark_pairs(spark, sf_dir):
    ids = tables.baselines(spark, sf_dir).select(F.col("index_id").alias("benchmark_id"))
    return ids.select(F.when(F.col("benchmark_id").isNotNull(), F.lit(c.MARKET)).alias("index_id"), "benchmark_id")


def relative_track(spark, sf_dir):
    """The whole index against every benchmark."""
    rows = reports.relative_tracks(_all_levels(spark, sf_dir), _benchmark_pairs(spark, sf_dir))
    return rows.withColumn("strength", c.sig("strength"))


def rebased_benchmarks(spark, sf_dir):
    rows = reports.rebased_pairs(
        _all_levels(spark, sf_dir), _benchmark_pairs(spark, sf_dir), track="level_pr"
    )
    return rows.withColumns({"a": c.sig("a"), "b": c.sig("b")})


def available_indices(spark, sf_dir):
    return readers.available_indices(_all_levels(spark, sf_dir))


def index_levels(spark, sf_dir):
    one = readers.index_levels(c.index_levels(spark, sf_dir), c.MARKET)
    return one.select("date", c.sig("level_pr").alias("level_pr"), c.sig("level_tr").alias("level_tr"))


def latest_weights(spark, sf_dir):
    return c.latest(spark, sf_dir).withColumn("weight", c.sig("weight"))


def weights_in_percent(spark, sf_dir):
    return reports.weights_in_percent(c.latest(spark, sf_dir))


_WINDOWS = ["1D", "1W", "1M", "3M", "6M", "YTD", "1Y"]


def performance_summary(spark, sf_dir):
    out = reports.performance_summary(c.adjusted(spark, sf_dir), keys=["ticker"])
    return out.select("ticker", *[c.r(w, 4).alias(w) for w in _WINDOWS])


def performance_table(spark, sf_dir):
    out = reports.performance_table(_all_levels(spark, sf_dir))
    return out.select("index_id", *[c.r(w, 4).alias(w) for w in _WINDOWS])


def _returns(spark, sf_dir):
    return reports.constituent_returns(tables.prices(spark, sf_dir), c.latest(spark, sf_dir), WINDOW_DAYS)


def constituent_returns(spark, sf_dir):
    return _returns(spark, sf_dir).withColumn("return_pct", c.r("return_pct", 4))


def movers_topk(spark, sf_dir):
    return reports.movers_topk(_returns(spark, sf_dir)).withColumn("return_pct", c.r("return_pct", 4))


def constituent_prices(spark, sf_dir):
    return reports.constituent_prices(tables.prices(spark, sf_dir), c.latest(spark, sf_dir))


def indicator_snapshot(spark, sf_dir):
    rows = c.current(spark, sf_dir).join(
        c.series_meta(spark, sf_dir).select("source", "series_id", "frequency"), ["source", "series_id"]
    )
    out = reports.indicator_snapshot(rows, keys=["source", "series_id", "frequency"], frequency="frequency")
    return out.select(
        "source", "series_id", "latest", "as_of", c.r("yoy").alias("yoy"), c.r("zscore").alias("zscore"),
        F.size("spark").cast("bigint").alias("tail_n"), F.col("spark")[0]["date"].alias("tail_start"),
        F.col("spark")[0]["value"].alias("tail_first"),
    )


def group_order(spark, sf_dir):
    """The catalogue in display order, with its place made visible."""
    rows = reports.in_group_order(c.series_meta(spark, sf_dir))
    return rows.select("series_id", "subsector")


def _performance(key: str, value: str, source: str) -> str:
    starts = {
        "1D": "d - 1", "1W": "d - 7", "1M": "d - 30", "3M": "d - 91", "6M": "d - 182",
        "YTD": "cast(date_trunc('year', d) AS date)", "1Y": "d - 365",
    }
    cells = ", ".join(
        f"{r(f'(any_value(v) / nullif(arg_max({value}, date) FILTER (date <= {start}), 0) - 1) * 100', 4)} AS \"{label}\""
        for label, start in starts.items()
    )
    return f"""SELECT {key}, {cells} FROM {source}
               JOIN (SELECT {key}, max(date) AS d, arg_max({value}, date) AS v FROM {source} GROUP BY {key})
               USING ({key}) GROUP BY {key}"""


def _levels_sql(source: str) -> str:
    return f"SELECT index_id, date, {sig('level_pr')} AS level_pr, {sig('level_tr')} AS level_tr FROM {source}"


_MONTHLY_WEIGHTS = f"""
    SELECT index_id, k AS rebalance_date, ticker,
           {sig('close * shares_out / sum(close * shares_out) OVER (PARTITION BY index_id, k)')} AS weight
    FROM (SELECT *, min(date) OVER (PARTITION BY index_id, date_trunc('month', date)) AS k FROM mpx)
    WHERE date = k AND (from_date IS NULL OR from_date <= k) AND (to_date IS NULL OR k <= to_date)"""

_MOVERS = f"""
    SELECT index_id, ticker, name, subsector, {r('return_pct', 4)} AS return_pct, position::integer AS position, side
    FROM (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY return_pct DESC, ticker) AS position,
                 'gainers' AS side FROM cret
          UNION ALL
          SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY return_pct, ticker), 'losers' FROM cret)
    WHERE position <= 10"""

_SNAPSHOT = f"""
    SELECT source, series_id, arg_max(value, date) AS latest, max(date) AS as_of,
           {r('arg_max(yoy, date)')} AS yoy, {r('arg_max(z, date)')} AS zscore,
           count(*) AS tail_n, min(date) AS tail_start, arg_min(value, date) AS tail_first
    FROM (SELECT source, series_id, date, value, frequency,
                 value / (CASE WHEN frequency = 'Q' THEN lag(value, 4) OVER w ELSE lag(value, 12) OVER w END) - 1 AS yoy,
                 CASE WHEN frequency = 'Q'
                      THEN CASE WHEN count(value) OVER q = 12 THEN (value - avg(value) OVER q) / nullif(stddev_samp(value) OVER q, 0) END
                      ELSE CASE WHEN count(value) OVER m = 36 THEN (value - avg(value) OVER m) / nullif(stddev_samp(value) OVER m, 0) END
                 END AS z,
                 row_number() OVER (PARTITION BY source, series_id ORDER BY date DESC) AS n
          FROM cur JOIN spec USING (source, series_id)
          WINDOW w AS (PARTITION BY source, series_id ORDER BY date),
                 q AS (PARTITION BY source, series_id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
                 m AS (PARTITION BY source, series_id ORDER BY date ROWS BETWEEN 35 PRECEDING AND CURRENT ROW))
    WHERE n <= 60 GROUP BY source, series_id"""

QUERIES = {
    "build_index": (build_index, sql(_levels_sql("lev"), "lev")),
    "index_levels_chain": (
        index_levels_chain,
        sql(
            f"""SELECT index_id, date, k AS rebalance_date, {sig('g_pr')} AS growth_pr, {sig('g_tr')} AS growth_tr,
                       {sig('f_pr')} AS factor_pr, {sig('f_tr')} AS factor_tr FROM chain""",
            "chain",
        ),
    ),
    "index_weights": (
        _weights,
        sql(f"SELECT index_id, k AS rebalance_date, ticker, {sig('weight')} AS weight FROM wt", "wt"),
    ),
    "target_weights": (target_weights, sql(_MONTHLY_WEIGHTS, "mpx")),
    "rebalance_dates": (
        rebalance_dates,
        sql(
            " UNION ALL ".join(
                f"""SELECT index_id, min(date) AS rebalance_date, '{code}' AS code
                    FROM mpx GROUP BY index_id, date_trunc('{unit}', date)"""
                for code, unit in (("Q", "quarter"), ("M", "month"), ("A", "year"))
            ),
            "mpx",
        ),
    ),
    "eligible_members": (
        eligible_members,
        sql(
            """SELECT mem.index_id, k AS rebalance_date, ticker FROM mem JOIN reb
               ON mem.index_id = reb.index_id AND coalesce(from_date <= k, true) AND coalesce(k <= to_date, true)""",
            "mem", "reb",
        ),
    ),
    "baseline_index": (baseline_index, sql(_levels_sql("base"), "base")),
    "build_all_indices": (
        build_all_indices,
        sql(f"{_levels_sql('lev')} UNION ALL {_levels_sql('base')}", "lev", "base"),
    ),
    "relative_track": (
        relative_track,
        sql(
            f"""SELECT 'ALL' AS index_id, benchmark_id, date,
                       {sig('a / b / first_value(a / b) OVER w * 100')} AS strength
                FROM (SELECT base.index_id AS benchmark_id, date, l.level_tr AS a, base.level_tr AS b
                      FROM base JOIN (SELECT * FROM lev WHERE index_id = 'ALL') l USING (date))
                WINDOW w AS (PARTITION BY benchmark_id ORDER BY date)""",
            "lev", "base",
        ),
    ),
    "rebased_benchmarks": (
        rebased_benchmarks,
        sql(
            f"""SELECT 'ALL' AS index_id, benchmark_id, date, {sig('a / first_value(a) OVER w * 100')} AS a,
                       {sig('b / first_value(b) OVER w * 100')} AS b
                FROM (SELECT base.index_id AS benchmark_id, date, l.level_pr AS a, base.level_pr AS b
                      FROM base JOIN (SELECT * FROM lev WHERE index_id = 'ALL') l USING (date))
                WINDOW w AS (PARTITION BY benchmark_id ORDER BY date)""",
            "lev", "base",
        ),
    ),
    "available_indices": (
        available_indices,
        sql("SELECT index_id FROM days UNION SELECT index_id FROM base ORDER BY index_id", "days", "base"),
    ),
    "index_levels": (
        index_levels,
        sql(
            f"""SELECT date, {sig('level_pr')} AS level_pr, {sig('level_tr')} AS level_tr
                FROM lev WHERE index_id = 'ALL' ORDER BY date""",
            "lev",
        ),
    ),
    "latest_weights": (
        latest_weights,
        sql(
            f"""SELECT index_id, ticker, name, subsector, {sig('weight')} AS weight
                FROM lastw LEFT JOIN sec USING (ticker)""",
            "lastw", "sec",
        ),
    ),
    "weights_in_percent": (
        weights_in_percent,
        sql(
            """SELECT index_id, ticker, name, subsector, round(weight * 100, 2) AS weight
               FROM lastw LEFT JOIN sec USING (ticker)""",
            "lastw", "sec",
        ),
    ),
    "constituent_prices": (
        constituent_prices,
        sql("SELECT index_id, ticker, date, adj_close AS value FROM lastw JOIN px USING (ticker)", "lastw", "px"),
    ),
    "performance_summary": (performance_summary, sql(_performance("ticker", "adj_close", "px"), "px")),
    "performance_table": (
        performance_table,
        sql(
            _performance("index_id", "level_tr", "(SELECT * FROM lev UNION ALL SELECT * FROM base)"),
            "lev", "base",
        ),
    ),
    "constituent_returns": (
        constituent_returns,
        sql(f"SELECT index_id, ticker, name, subsector, {r('return_pct', 4)} AS return_pct FROM cret", "cret"),
    ),
    "movers_topk": (movers_topk, sql(_MOVERS, "cret")),
    "indicator_snapshot": (indicator_snapshot, sql(_SNAPSHOT, "cur", "spec")),
    "group_order": (
        group_order,
        sql(
            """SELECT series_id, subsector FROM meta
               ORDER BY CASE subsector WHEN 'prices' THEN 1 WHEN 'labor' THEN 2 WHEN 'spending' THEN 3
                                       WHEN 'macro' THEN 4 ELSE 5 END, subsector, metric_name""",
            "meta",
        ),
    ),
}
