"""Registered queries: sources, readers, writers, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import index, quality, readers, universe, writers
from tidemark.plans import common as c
from tidemark.plans.oracle import sig, sql
from tidemark.plans import refresh as refresh_plan
from tidemark.plans.refresh import Store, refresh
from tidemark.schemas import OBSERVATIONS, PRICE_KEY, PRICES, SECURITIES
from tidemark.session import new_workspace
from tidemark.sources import driver_tables as tables, landing, prices as price_source
from tidemark.streaming import ingest

KNOWN_ON = "1998-06-30"
TODAY = "2001-10-15"


def normalize_payload(spark, sf_dir):
    good, _ = landing.normalize_payload(tables.landing(spark, sf_dir))
    return good.select("source", "series_id", "date", "as_of", "value", "as_of_is_fetch")


def land_raw(spark, sf_dir):
    path = new_workspace(spark, "landing")
    landing.land_raw(tables.landing(spark, sf_dir), path)
    pulls = landing.read_landing(spark, path)
    return landing.parse_payload(pulls).select("source", "series_id", "as_of", "date", "value")


def replay_landing(spark, sf_dir):
    path = new_workspace(spark, "replay")
    landing.land_raw(tables.landing(spark, sf_dir), path, by_series=True)
    return landing.replay_landing(landing.read_landing(spark, path))


def incremental_ingest(spark, sf_dir):
    """Two rounds: the first weeks are landed and taken up, then the rest."""
    root = new_workspace(spark, "ingest")
    pulls = tables.landing(spark, sf_dir)
    early = F.col("fetched_at") < F.lit("2024-01-16").cast("timestamp")
    for part in (pulls.filter(early), pulls.filter(~early)):
        landing.land_raw(part, f"{root}/raw")
        ingest.incremental_ingest(
            spark, f"{root}/raw", f"{root}/observations", f"{root}/rejects", f"{root}/progress"
        )
    return ingest.stored_observations(spark, f"{root}/observations")


def _prints_as_sent(spark, sf_dir):
    """Unchecked prints of all stocks and the benchmarks' prices, all as text, with their order."""
    own = tables.raw_prints(spark, sf_dir)
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    # Lines that share a number are told apart by what they say.
    seq = F.struct(number.alias("n"), F.col("shares_out").alias("q"), F.col("cents").alias("c"), F.col("off").alias("o"))
    line = own.select("ticker", "date", "close", "adj_close", "shares_out", seq.alias("seq"))
    none = F.struct(
        F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("q"), F.lit(0).cast("bigint").alias("c"), F.lit(0.0).alias("o")
    )
    bench = tables.baseline_prices(spark, sf_dir).select(
        "ticker", "date", *[F.col(c).cast("string").alias(c) for c in ("close", "adj_close")], "shares_out", none.alias("seq")
    )
    return line.unionByName(bench)


def _refreshed(spark, sf_dir):
    """A refresh of a new store from landed pulls and unchecked prints: the store and its report."""
    root = new_workspace(spark, "refresh")
    landing.land_raw(tables.landing(spark, sf_dir), f"{root}/raw")
    specs = tables.daily_series(spark, sf_dir).select("source", "series_id").distinct().select(
        "*", F.col("series_id").alias("metric_name"), F.lit("D").alias("frequency"), F.lit("USD").alias("unit"),
        F.lit("spending").alias("subsector"),
    )
    store = Store(f"{root}/store")
    report = refresh(
        spark, store, landing_path=f"{root}/raw", prices=_prints_as_sent(spark, sf_dir),
        securities=tables.securities(spark, sf_dir), baselines=tables.baselines(spark, sf_dir), specs=specs,
        batch=1, prefix=c.MARKET, price_seq="seq", fetched_at=c.FETCHED_AT, base_date=c.BASE_DATE,
    )
    return store, report


def run_refresh(spark, sf_dir):
    return _refreshed(spark, sf_dir)[1]


def refreshed_levels(spark, sf_dir):
    """Stored levels of every index after a refresh."""
    rows = writers.read_index_values(spark, _refreshed(spark, sf_dir)[0].path("index_values"))
    return rows.select("index_id", "date", c.sig("level_pr").alias("level_pr"), c.sig("level_tr").alias("level_tr"))


def refreshed_weights(spark, sf_dir):
    rows = writers.read_index_weights(spark, _refreshed(spark, sf_dir)[0].path("index_weights"))
    return rows.select("index_id", "rebalance_date", "ticker", c.sig("weight").alias("weight"))


def refreshed_catalogue(spark, sf_dir):
    """The stored catalogue after a refresh, with what is stale by it."""
    store, _ = _refreshed(spark, sf_dir)
    return quality.staleness(refresh_plan.stored_series_meta(spark, store), "2024-06-01").select(
        "source", "series_id", "frequency", "first_obs", "last_obs", "last_fetched", "stale"
    )


def refreshed_health(spark, sf_dir):
    """The health line of a refreshed store."""
    store, _ = _refreshed(spark, sf_dir)
    return quality.health_summary(
        spark, refresh_plan.stored_series_meta(spark, store), refresh_plan.stored_securities(spark, store),
        writers.read_index_values(spark, store.path("index_values")), refresh_plan.stored_prices(spark, store),
    )


def canonical_prices(spark, sf_dir):
    wanted = universe.ticker_list(tables.securities(spark, sf_dir), tables.baselines(spark, sf_dir))
    raw = tables.raw_prints(spark, sf_dir).withColumn("date", F.col("date").cast("timestamp"))
    return price_source.canonical_prices(raw, wanted, c.BASE_DATE).select(
        "ticker", "date", c.sig("close").alias("close"), c.sig("adj_close").alias("adj_close"), "shares_out"
    )


def align_shares(spark, sf_dir):
    dates = tables.prices(spark, sf_dir).select("ticker", "date")
    return price_source.align_shares(
        dates, tables.share_counts(spark, sf_dir), tables.static_shares(spark, sf_dir)
    )


def _revisions(spark, sf_dir):
    """A batch for the upserts: every line restates its own day, the last line wins."""
    return tables.raw_prints(spark, sf_dir).select(
        "ticker",
        "date",
        F.col("shares_out").alias("close"),
        (F.col("shares_out") * 2).alias("adj_close"),
        F.lit(1.0).alias("shares_out"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def upsert_observations(spark, sf_dir):
    """Observations, then a batch that restates recent vintages and one of new vintages."""
    obs = tables.observations(spark, sf_dir)
    batch = obs.filter(F.col("as_of") >= F.lit("2000-01-01").cast("date")).withColumn("value", F.col("value") * 2)
    late = obs.select("source", "series_id", "date", F.date_add("as_of", 36500).alias("as_of"), "value")
    return writers.upsert_observations(writers.upsert_observations(obs, batch), late)


def upsert_prices(spark, sf_dir):
    """Prices up to 1998 with a batch of duplicated restatements from 1998 on."""
    old = tables.prices(spark, sf_dir).filter(F.col("date") < F.lit("1999-01-01").cast("date"))
    new = _revisions(spark, sf_dir).filter(F.col("date") >= F.lit("1998-01-01").cast("date"))
    return writers.upsert_prices(old, new, seq="seq")


def upsert_securities(spark, sf_dir):
    """A first load, then a batch that writes open dates as empty text."""
    first = tables.securities(spark, sf_dir)
    text = first.withColumns(
        {
            "from_date": F.lit(""),
            "to_date": F.when(F.col("to_date").isNull(), F.lit("")).otherwise(F.col("to_date").cast("string")),
        }
    )
    loaded = writers.upsert_securities(spark.createDataFrame([], SECURITIES), first)
    return writers.upsert_securities(loaded, text).drop("notes")


def stored_current_series(spark, sf_dir):
    """Two batches of vintages, the second restating some of the first, read in one aggregate."""
    path = new_workspace(spark, "vintages")
    obs = tables.observations(spark, sf_dir)
    writers.write_batch(obs, path, 0)
    recent = obs.filter(F.col("as_of") >= F.lit("2000-01-01").cast("date"))
    writers.write_batch(recent.withColumn("value", F.col("value") * 2), path, 1)
    return readers.current_series(writers.read_batches(spark, path, OBSERVATIONS), write_order="batch")


def stored_prices(spark, sf_dir):
    """Batches written to a store, one of them twice, compacted and read back."""
    root = new_workspace(spark, "store")
    old = tables.prices(spark, sf_dir)
    new = writers.last_per_key(_revisions(spark, sf_dir), PRICE_KEY, "seq")
    writers.write_batch(old, f"{root}/a", 0)
    for _ in range(2):
        writers.write_batch(new.filter(F.col("date") >= F.lit("1998-01-01").cast("date")), f"{root}/a", 1)
    writers.compact(spark, f"{root}/a", f"{root}/b", PRICES, PRICE_KEY)
    return writers.read_store(spark, f"{root}/b", PRICES, PRICE_KEY)


def replace_index(spark, sf_dir):
    """All indices written, then half of their base replaced for the sub-sectors only: stored levels and weights."""
    root = new_workspace(spark, "replace")
    px, mem = tables.prices(spark, sf_dir), c.members(spark, sf_dir)
    for base, rows in ((100.0, mem), (50.0, mem.filter(F.col("index_id") != c.MARKET))):
        levels, weights = index.build_index(px, rows, base_value=base, base_date=c.BASE_DATE)
        writers.replace_index(levels, weights, f"{root}/values", f"{root}/weights")
    values = writers.read_index_values(spark, f"{root}/values")
    weights = writers.read_index_weights(spark, f"{root}/weights").withColumnRenamed("rebalance_date", "date")
    none = F.lit(None).cast("string")
    return values.select("index_id", "date", none.alias("ticker"), c.sig("level_tr").alias("value")).unionByName(
        weights.select("index_id", "date", "ticker", c.sig("weight").alias("value"))
    )


def prices_wide(spark, sf_dir):
    """A column for every ticker of the benchmark catalogue, returned in long form."""
    tickers = [row.ticker for row in tables.baselines(spark, sf_dir).select("ticker").orderBy("ticker").collect()]
    wide = readers.prices_wide(tables.baseline_prices(spark, sf_dir), "close", tickers)
    return wide.unpivot(["date"], tickers, "ticker", "close")


def sanitize_prices(spark, sf_dir):
    tagged = quality.price_status(quality.tag_prices(tables.raw_prints(spark, sf_dir)))
    return tagged.select("ticker", "date", "l_orderkey", "l_linenumber", "status", "reason")


def quarantine_summary(spark, sf_dir):
    _, rejected = quality.sanitize_prices(tables.raw_prints(spark, sf_dir))
    return quality.quarantine_summary(rejected).select(
        "reason", "rows", F.array_join("tickers", ",").alias("tickers")
    )


def health_summary(spark, sf_dir):
    return quality.health_summary(
        spark, c.series_meta(spark, sf_dir), tables.securities(spark, sf_dir),
        c.index_levels(spark, sf_dir), tables.prices(spark, sf_dir),
    )


def series_meta(spark, sf_dir):
    return c.series_meta(spark, sf_dir).drop("notes")


_REASON = """
    CASE WHEN l_tax IN (0.0, 0.08) THEN 'non-positive or null close'
         WHEN l_discount IN (0.0, 0.1) THEN 'non-positive or null adj_close' END"""

_STALE = """
    SELECT source, series_id, frequency, last_obs,
           coalesce(date_diff('day', last_obs, date '2001-10-15')
                    > CASE frequency WHEN 'D' THEN 7 WHEN 'W' THEN 21 WHEN 'Q' THEN 200
                                     WHEN 'A' THEN 500 ELSE 75 END, true) AS stale
    FROM meta"""

QUERIES = {
    "normalize_payload": (
        normalize_payload,
        sql("SELECT source, series_id, date, as_of, value, true AS as_of_is_fetch FROM landed", "landed"),
    ),
    "land_raw": (
        land_raw,
        sql(
            "SELECT source, series_id, as_of, date, value FROM landed",
            "landed",
        ),
    ),
    "replay_landing": (
        replay_landing,
        sql("SELECT source, series_id, date, as_of, value FROM landed", "landed"),
    ),
    "incremental_ingest": (
        incremental_ingest,
        sql("SELECT source, series_id, date, as_of, value FROM landed", "landed"),
    ),
    "refresh": (
        run_refresh,
        sql(
            f"""SELECT 'observations' AS step, count(*) AS rows, 0::bigint AS errors, NULL::varchar AS error FROM landed
               UNION ALL SELECT 'series_meta', count(DISTINCT event_type), 0, NULL FROM events
               UNION ALL SELECT 'securities', count(*), 0, NULL FROM sec
               UNION ALL SELECT 'prices', (SELECT count(*) FROM px) + (SELECT count(*) FROM bpx), count(*), NULL
                         FROM line WHERE {_REASON} IS NOT NULL
               UNION ALL SELECT 'index_values', (SELECT count(*) FROM days) + (SELECT count(*) FROM bpx), 0, NULL
               UNION ALL SELECT 'index_weights', (SELECT count(*) FROM wt), 0, NULL""",
            "landed", "px", "bpx", "days", "wt", "sec", "line", prices="cleanpx",
        ),
    ),
    "refreshed_levels": (
        refreshed_levels,
        sql(
            f"""SELECT index_id, date, {sig('level_pr')} AS level_pr, {sig('level_tr')} AS level_tr FROM lev
                UNION ALL SELECT index_id, date, {sig('level_pr')}, {sig('level_tr')} FROM base""",
            "lev", "base", prices="cleanpx",
        ),
    ),
    "refreshed_weights": (
        refreshed_weights,
        sql(f"SELECT index_id, k AS rebalance_date, ticker, {sig('weight')} AS weight FROM wt", "wt", prices="cleanpx"),
    ),
    "refreshed_catalogue": (
        refreshed_catalogue,
        sql(
            """SELECT 'EVT' AS source, series_id, 'D' AS frequency, min(date) AS first_obs, max(date) AS last_obs,
                      timestamp '2002-01-01 00:00:00' AS last_fetched, date '2024-06-01' - max(date) > 7 AS stale
               FROM landed GROUP BY series_id""",
            "landed",
        ),
    ),
    "refreshed_health": (
        refreshed_health,
        sql(
            """SELECT (SELECT count(DISTINCT event_type) FROM events) AS n_indicators, (SELECT count(*) FROM sec) AS n_securities,
                      (SELECT count(DISTINCT index_id) FROM days) + (SELECT count(DISTINCT ticker) FROM bpx) AS n_indices,
                      timestamp '2002-01-01 00:00:00' AS last_fetched,
                      greatest((SELECT max(date) FROM px), (SELECT max(date) FROM bpx)) AS last_price""",
            "sec", "days", "bpx", prices="cleanpx",
        ),
    ),
    "canonical_prices": (
        canonical_prices,
        sql(
            f"""SELECT ticker, date,
                  CASE WHEN l_tax = 0.0 THEN NULL WHEN l_tax = 0.08 THEN -1
                       ELSE {sig('l_extendedprice / l_quantity')} END AS close,
                  CASE WHEN l_discount IN (0.0, 0.1) THEN NULL
                       ELSE {sig('l_extendedprice / l_quantity * (1 - l_discount)')} END AS adj_close,
                  l_quantity AS shares_out FROM line""",
            "line",
        ),
    ),
    "align_shares": (
        align_shares,
        sql(
            """SELECT p.ticker, p.date,
                      CASE WHEN count(h.shares) OVER (PARTITION BY p.ticker) = 0
                           THEN cast(p.ticker AS bigint) * 10.0::double + 1000 ELSE h.shares END AS shares_out
               FROM (SELECT DISTINCT ticker, date FROM line) p
               ASOF LEFT JOIN (
                   SELECT ticker, date, shares FROM counts) h
               ON p.ticker = h.ticker AND p.date >= h.date""",
            "line", "counts",
        ),
    ),
    "upsert_observations": (
        upsert_observations,
        sql(
            """SELECT source, series_id, date, as_of,
                      CASE WHEN as_of >= date '2000-01-01' THEN value * 2 ELSE value END AS value FROM obs
               UNION ALL
               SELECT source, series_id, date, as_of + 36500, value FROM obs""",
            "obs",
        ),
    ),
    "upsert_prices": (
        upsert_prices,
        sql(
            """SELECT ticker, date, close, adj_close, shares_out FROM px WHERE date < date '1998-01-01'
               UNION ALL
               SELECT ticker, date, arg_max(l_quantity, l_orderkey * 10 + l_linenumber),
                      arg_max(l_quantity, l_orderkey * 10 + l_linenumber) * 2, 1.0::double
               FROM line WHERE date >= date '1998-01-01' GROUP BY ticker, date""",
            "px",
        ),
    ),
    "upsert_securities": (
        upsert_securities,
        sql("SELECT ticker, name, subsector, NULL::date AS from_date, to_date FROM sec", "sec"),
    ),
    "stored_current_series": (
        stored_current_series,
        sql(
            """SELECT source, series_id, date, CASE WHEN as_of >= date '2000-01-01' THEN value * 2 ELSE value END AS value
               FROM obs QUALIFY row_number() OVER (PARTITION BY source, series_id, date ORDER BY as_of DESC) = 1""",
            "obs",
        ),
    ),
    "stored_prices": (
        stored_prices,
        sql(
            """SELECT ticker, date, close, adj_close, shares_out FROM px WHERE date < date '1998-01-01'
               UNION ALL
               SELECT ticker, date, arg_max(l_quantity, l_orderkey * 10 + l_linenumber),
                      arg_max(l_quantity, l_orderkey * 10 + l_linenumber) * 2, 1.0::double
               FROM line WHERE date >= date '1998-01-01' GROUP BY ticker, date""",
            "px",
        ),
    ),
    "replace_index": (
        replace_index,
        sql(
            f"""SELECT index_id, date, NULL::varchar AS ticker,
                       {sig("level_tr * CASE WHEN index_id = 'ALL' THEN 1 ELSE 0.5 END")} AS value FROM lev
                UNION ALL SELECT index_id, k, ticker, {sig('weight')} FROM wt""",
            "lev", "wt",
        ),
    ),
    "series_meta": (series_meta, sql("SELECT * FROM meta", "meta")),
    "series_bounds": (
        lambda s, d: readers.series_bounds(tables.observations(s, d)),
        sql("SELECT source, series_id, min(date) AS first_obs, max(date) AS last_obs FROM obs GROUP BY ALL", "obs"),
    ),
    "last_obs_date": (
        lambda s, d: readers.last_obs_date(tables.observations(s, d)),
        sql("SELECT source, series_id, max(date) AS last_obs FROM obs GROUP BY ALL", "obs"),
    ),
    "current_series": (c.current, sql("SELECT * FROM cur", "cur")),
    "series_as_known_on": (
        lambda s, d: readers.series_as_known_on(tables.observations(s, d), KNOWN_ON),
        sql(
            f"""SELECT source, series_id, date, value FROM obs WHERE as_of <= date '{KNOWN_ON}'
                QUALIFY row_number() OVER (PARTITION BY source, series_id, date ORDER BY as_of DESC) = 1""",
            "obs",
        ),
    ),
    "asof_value": (
        lambda s, d: readers.asof_value(c.adjusted(s, d), KNOWN_ON, keys=["ticker"]),
        sql(
            f"SELECT ticker, arg_max(adj_close, date) AS value FROM px WHERE date <= date '{KNOWN_ON}' GROUP BY ticker",
            "px",
        ),
    ),
    "series_catalog": (
        lambda s, d: readers.series_catalog(c.series_meta(s, d)),
        sql("SELECT * FROM meta ORDER BY subsector, metric_name", "meta"),
    ),
    "securities_list": (
        lambda s, d: readers.securities_list(tables.securities(s, d)),
        sql("SELECT ticker, name, subsector, from_date, to_date FROM sec ORDER BY subsector, ticker", "sec"),
    ),
    "series_metadata": (
        lambda s, d: universe.series_metadata(tables.series_specs(s, d)),
        sql("SELECT * FROM spec", "spec"),
    ),
    "ticker_list": (
        lambda s, d: universe.ticker_list(tables.securities(s, d), tables.baselines(s, d)),
        "SELECT cast(s_suppkey AS varchar) AS ticker FROM supplier UNION SELECT p_brand FROM part ORDER BY ticker",
    ),
    "prices_wide": (
        prices_wide,
        sql(
            """SELECT date, ticker, close
               FROM (SELECT DISTINCT d.date, t.p_brand AS ticker FROM bpx d CROSS JOIN part t) LEFT JOIN bpx USING (date, ticker)""",
            "bpx",
        ),
    ),
    "price_coverage": (
        lambda s, d: readers.price_coverage(tables.prices(s, d)),
        sql(
            """SELECT ticker, count(*) AS rows, min(date) AS first_date, max(date) AS last_date
               FROM px GROUP BY ticker ORDER BY last_date, ticker""",
            "px",
        ),
    ),
    "universe_members": (
        c.members,
        sql("SELECT index_id, ticker, from_date, to_date FROM mem", "mem"),
    ),
    "tag_filter": (
        lambda s, d: universe.tag_filter(tables.tagged_records(s, d), ["WIDGET", "d bo", "eco"]).select(
            "slug", "rank", "name"
        ),
        """SELECT cast(p_partkey AS varchar) AS slug, cast(p_partkey + 1 AS integer) AS rank, p_name AS name
           FROM part WHERE regexp_matches(lower(p_name || ' ' || p_type), 'widget|d bo|eco') ORDER BY rank""",
    ),
    "records_by_rank": (
        lambda s, d: universe.records_by_rank(tables.tagged_records(s, d)).select("slug", "rank", "name"),
        """SELECT cast(p_partkey AS varchar) AS slug, cast(p_partkey + 1 AS integer) AS rank, p_name AS name
           FROM part ORDER BY rank""",
    ),
    "sanitize_prices": (
        sanitize_prices,
        sql(
            f"""SELECT *, CASE WHEN reason IS NULL THEN 'clean' ELSE 'rejected' END AS status
                FROM (SELECT ticker, date, l_orderkey, l_linenumber, {_REASON} AS reason FROM line)""",
            "line",
        ),
    ),
    "quarantine_summary": (
        quarantine_summary,
        sql(
            f"""SELECT reason, sum(n)::bigint AS rows,
                       string_agg(ticker, ',' ORDER BY ticker) FILTER (pos <= 5) AS tickers
                FROM (SELECT reason, ticker, n, row_number() OVER (PARTITION BY reason ORDER BY ticker) AS pos
                      FROM (SELECT {_REASON} AS reason, ticker, count(*) AS n FROM line GROUP BY ALL)
                      WHERE reason IS NOT NULL)
                GROUP BY reason""",
            "line",
        ),
    ),
    "staleness": (
        lambda s, d: quality.staleness(c.series_meta(s, d), TODAY).select(
            "source", "series_id", "frequency", "last_obs", "stale"
        ),
        sql(_STALE, "meta"),
    ),
    "health_summary": (
        health_summary,
        sql(
            """SELECT (SELECT count(*) FROM meta) AS n_indicators, (SELECT count(*) FROM sec) AS n_securities,
                      (SELECT count(DISTINCT index_id) FROM days) AS n_indices,
                      (SELECT max(last_fetched) FROM meta) AS last_fetched,
                      (SELECT max(date) FROM px) AS last_price""",
            "meta", "days", "px",
        ),
    ),
    "duplicate_keys": (
        lambda s, d: quality.duplicate_keys(tables.raw_prints(s, d).select("ticker", "date"), PRICE_KEY),
        sql("SELECT ticker, date, count(*) AS rows FROM line GROUP BY ticker, date HAVING count(*) > 1", "line"),
    ),
}
