"""Registered queries: many decision dates, long histories, landed prices, incremental indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import align, index, readers, signals, universe, writers
from tidemark.plans import common as c, refresh as refresh_plan
from tidemark.plans.oracle import r, sig, sql
from tidemark.plans.refresh import refresh
from tidemark.plans.store import Store
from tidemark.schemas import PRICES
from tidemark.session import new_workspace
from tidemark.sources import driver_tables as tables, landing
from tidemark.streaming import ingest

TRAIL = 50


def series_as_known_on_dates(spark, sf_dir):
    """Every monthly series as known in the middle of each month."""
    return readers.series_as_known_on_dates(tables.observations(spark, sf_dir), tables.decision_days(spark, sf_dir))


def validity_intervals(spark, sf_dir):
    return readers.validity_intervals(tables.observations(spark, sf_dir))


def _by_day():
    return F.to_date("date")


def event_asof(spark, sf_dir):
    """Each event with the newest purchase of the whole market until then: one key, cut by day."""
    events = tables.event_series(spark, sf_dir)
    bought = events.filter(F.col("event_type") == "purchase").select("date", "value", F.col("date").alias("bought_at"))
    return align.asof_align(
        events.select("event_type", "date"), bought, keys=[], columns=["value", "bought_at"], part=_by_day()
    )


def event_change(spark, sf_dir):
    """Change of each event's value over 10 events of its type; gaps count as unchanged."""
    out = signals.pct_change(tables.event_series(spark, sf_dir), 10, keys=["event_type"], part=_by_day())
    return out.select("event_type", "date", c.r("change", 5).alias("change"))


def event_zscore(spark, sf_dir):
    out = signals.zscore(tables.event_series(spark, sf_dir).dropna(), TRAIL, keys=["event_type"], part=_by_day())
    return out.select("event_type", "date", c.r("zscore").alias("zscore"))


def event_smooth(spark, sf_dir):
    out = signals.smooth(tables.event_series(spark, sf_dir).dropna(), TRAIL, keys=["event_type"], part=_by_day())
    return out.select("event_type", "date", c.r("smooth").alias("smooth"))


def _price_store(spark, sf_dir, rounds):
    """Prices landed and taken up in rounds of the given conditions: the store."""
    root = new_workspace(spark, "prices")
    store = Store(f"{root}/store")
    pulls = tables.price_landing(spark, sf_dir)
    for some in rounds:
        landing.land_raw(pulls.filter(some), f"{root}/raw")
        ingest.incremental_prices(
            spark, f"{root}/raw", store.path("landed_prices"), store.path("_price_progress"), stats_path=store.path("price_stats")
        )
    return root, store


def _two_rounds():
    late = F.col("fetched_at") >= F.lit("1998-01-01").cast("timestamp")
    return late, ~late


def landed_prices(spark, sf_dir):
    """Prices taken up from landed pulls by a stream in two rounds, the later months first."""
    return refresh_plan.stored_prices(spark, _price_store(spark, sf_dir, _two_rounds())[1])


def replay_prices(spark, sf_dir):
    """Prices rebuilt from the landed files alone."""
    path = new_workspace(spark, "replay-prices")
    landing.land_raw(tables.price_landing(spark, sf_dir), path)
    return landing.replay_prices(landing.read_landing(spark, path, source="PX"))


def rebuilt_prices(spark, sf_dir):
    """A store built anew by one stream over what two rounds had landed."""
    root, _ = _price_store(spark, sf_dir, _two_rounds())
    again = Store(f"{root}/again")
    ingest.incremental_prices(spark, f"{root}/raw", again.path("landed_prices"), again.path("_price_progress"))
    return refresh_plan.stored_prices(spark, again)


def landed_price_errors(spark, sf_dir):
    """Entries and errors of each ticker, counted as its pulls were taken up."""
    return refresh_plan.series_errors(spark, _price_store(spark, sf_dir, _two_rounds())[1])


def ingest_stats(spark, sf_dir):
    """Entries, errors and bounds of each series after three rounds of landed pulls."""
    root = new_workspace(spark, "stats")
    pulls, day = tables.broken_landing(spark, sf_dir), F.to_date("fetched_at")
    first, last = F.lit("2024-01-10").cast("date"), F.lit("2024-02-10").cast("date")
    for some in (day <= first, (day > first) & (day <= last), day > last):
        landing.land_raw(pulls.filter(some), f"{root}/raw")
        ingest.incremental_ingest(
            spark, f"{root}/raw", f"{root}/observations", f"{root}/rejects", f"{root}/progress", stats_path=f"{root}/stats"
        )
    return ingest.ingest_stats(spark, f"{root}/stats")


def carried_levels(spark, sf_dir):
    """All indices with the rebalance day's return carried into the level."""
    levels, _ = index.build_index(
        tables.prices(spark, sf_dir), c.members(spark, sf_dir), base_date=c.BASE_DATE, rebalance_day="carry"
    )
    return levels.select("index_id", "date", c.sig("level_pr").alias("level_pr"), c.sig("level_tr").alias("level_tr"))


def incremental_indices(spark, sf_dir):
    """Stored levels after a full build, a batch of new quarters and a late restatement of one old quarter."""
    root = new_workspace(spark, "incremental")
    store = Store(f"{root}/store")
    # Replayed once and kept: each batch takes its part.
    landing.replay_prices(tables.price_landing(spark, sf_dir)).write.parquet(f"{root}/replayed")
    px = spark.read.schema(PRICES).parquet(f"{root}/replayed")
    late = F.col("date") >= F.lit("2000-01-01").cast("date")
    hit = F.col("date").between("1997-04-01", "1997-06-30") & (F.col("ticker").cast("bigint") % 3 == 0)
    again = px.filter(hit).withColumns({k: F.col(k) * 1.5 for k in ("close", "adj_close")})
    secs, none = tables.securities(spark, sf_dir), tables.baselines(spark, sf_dir).limit(0)
    for batch, rows in enumerate((px.filter(~late), px.filter(late), again)):
        refresh(
            spark, store, landing_path=None, prices=rows, securities=secs if batch == 0 else None, baselines=none,
            batch=batch, prefix=c.MARKET, base_date=c.BASE_DATE,
        )
    levels = writers.read_index_values(spark, store.path("index_values"))
    return levels.select("index_id", "date", c.sig("level_pr").alias("level_pr"), c.sig("level_tr").alias("level_tr"))


def tag_filter_many(spark, sf_dir):
    """Records that hold any of a table of terms: two for each part, across tags, and one that is nowhere."""
    part = tables.table(spark, sf_dir, "part")
    odd = F.col("p_partkey") % 7 == 3
    crossing = F.concat(F.expr("substring(p_name, 4)"), F.lit(" "), F.substring("p_type", 1, 3))
    terms = part.select(
        F.explode(
            F.array(F.when(odd, crossing), F.upper(F.concat(F.col("p_name"), F.col("p_partkey").cast("string"))), F.lit(None))
        ).alias("term")
    )
    return universe.tag_filter_many(tables.tagged_records(spark, sf_dir), terms).select("slug", "rank", "name")


_EVENTS = """
    WITH ev AS MATERIALIZED (
        SELECT event_type, ts AS date,
               CASE WHEN cast(round(value * 100) AS bigint) % 2 = 1 THEN cast(round(value * 100) AS bigint) / 100 END AS value
        FROM events)"""

_TRAIL = f"""
    WINDOW w AS (PARTITION BY event_type ORDER BY date ROWS BETWEEN {TRAIL - 1} PRECEDING AND CURRENT ROW)"""

_CLEAN = "SELECT ticker, date, close, adj_close, shares_out FROM cleanpx"

QUERIES = {
    "landed_prices": (landed_prices, sql(_CLEAN, "cleanpx")),
    "replay_prices": (replay_prices, sql(_CLEAN, "cleanpx")),
    "rebuilt_prices": (rebuilt_prices, sql(_CLEAN, "cleanpx")),
    "landed_price_errors": (
        landed_price_errors,
        sql(
            """SELECT 'PX' AS source, ticker AS series_id, sum(ok)::bigint AS entries, sum(bad)::bigint AS errors
               FROM (SELECT ticker, CASE WHEN l_tax IN (0.0, 0.08) OR l_discount IN (0.0, 0.1) THEN 0 ELSE 1 END AS ok, 1 - ok AS bad
                     FROM line
                     UNION ALL SELECT cast(s_suppkey AS varchar), 0, 1 FROM supplier WHERE s_suppkey % 10 = 3)
               GROUP BY ticker""",
            "line",
        ),
    ),
    "carried_levels": (
        carried_levels,
        sql(f"SELECT index_id, date, {sig('level_pr')} AS level_pr, {sig('level_tr')} AS level_tr FROM levc", "levc"),
    ),
    "incremental_indices": (
        incremental_indices,
        sql(
            f"SELECT index_id, date, {sig('level_pr')} AS level_pr, {sig('level_tr')} AS level_tr FROM lev",
            "lev", prices="restated",
        ),
    ),
    "tag_filter_many": (
        tag_filter_many,
        """WITH terms AS MATERIALIZED (
               SELECT DISTINCT lower(unnest([CASE WHEN p_partkey % 7 = 3 THEN substr(p_name, 4) || ' ' || substr(p_type, 1, 3) END,
                                             p_name || p_partkey])) AS term FROM part)
           SELECT cast(p_partkey AS varchar) AS slug, cast(p_partkey + 1 AS integer) AS rank, p_name AS name
           FROM part WHERE EXISTS (SELECT 1 FROM terms WHERE contains(lower(p_name || ' ' || p_type), term)) ORDER BY rank""",
    ),
    "ingest_stats": (
        ingest_stats,
        sql(
            """SELECT source, series_id, count(*) + 1 AS entries, 3::bigint AS errors, min(date) AS first_obs,
                      date '2030-01-01' AS last_obs
               FROM landed GROUP BY source, series_id""",
            "landed",
        ),
    ),
    "series_as_known_on_dates": (
        series_as_known_on_dates,
        sql(
            """SELECT known_date, source, series_id, date, value
               FROM (SELECT DISTINCT cast(date_trunc('month', o_orderdate) AS date) + 14 AS known_date FROM orders)
               JOIN obs ON as_of <= known_date
               QUALIFY row_number() OVER (PARTITION BY known_date, source, series_id, date ORDER BY as_of DESC) = 1""",
            "obs",
        ),
    ),
    "validity_intervals": (
        validity_intervals,
        sql(
            """SELECT source, series_id, date, value, as_of AS valid_from,
                      lead(as_of) OVER (PARTITION BY source, series_id, date ORDER BY as_of) AS valid_until
               FROM (SELECT * FROM obs
                     WINDOW w AS (PARTITION BY source, series_id, date ORDER BY as_of)
                     QUALIFY value IS DISTINCT FROM lag(value) OVER w OR row_number() OVER w = 1)""",
            "obs",
        ),
    ),
    "event_asof": (
        event_asof,
        f"""{_EVENTS} SELECT e.event_type, e.date, p.value, p.date AS bought_at
            FROM ev e ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'purchase') p ON e.date >= p.date""",
    ),
    "event_change": (
        event_change,
        f"""{_EVENTS} SELECT event_type, date, {r('pad / lag(pad, 10) OVER w - 1', 5)} AS change
            FROM (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY date) AS pad FROM ev)
            WINDOW w AS (PARTITION BY event_type ORDER BY date)""",
    ),
    "event_zscore": (
        event_zscore,
        f"""{_EVENTS} SELECT event_type, date, CASE WHEN count(value) OVER w = {TRAIL} THEN
                {r('(value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0)')} END AS zscore
            FROM ev WHERE value IS NOT NULL {_TRAIL}""",
    ),
    "event_smooth": (
        event_smooth,
        f"""{_EVENTS} SELECT event_type, date, CASE WHEN count(value) OVER w = {TRAIL} THEN {r('avg(value) OVER w')} END AS smooth
            FROM ev WHERE value IS NOT NULL {_TRAIL}""",
    ),
}
