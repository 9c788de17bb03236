"""Landed prices: reading, streaming, late pulls, rebuilding; and what the ingest counts as it goes."""

import datetime as dt
import json
import random

from helpers import day
from pyspark.sql import functions as F

from tidemark.operators import writers
from tidemark.plans.refresh import Store, compact_store, refresh, rejected_prices, series_errors, stored_prices, stored_series_meta
from tidemark.sources import landing
from tidemark.streaming import ingest

PULLS = "source string, series_id string, fetched_at timestamp, payload string"


def pull(ticker, when, *entries, payload=None):
    keys = ("date", "close", "adj_close", "shares_out")
    doc = json.dumps({"prices": [dict(zip(keys, e)) for e in entries]}) if payload is None else payload
    return ("PX", ticker, dt.datetime.fromisoformat(when), doc)


ONE = [
    pull("A", "2021-01-05", ("2021-01-04", 1.5, "1.25", 10), ("2021-01-04", "2", 2, "11"), ("2021-01-05", 0, 1, 1)),
    pull("B", "2021-01-05", ("2021-01-04", 3, None, 1), ("soon", 1, 1, 1), ("2021-01-06", "NaN", "x", 1)),
    pull("C", "2021-01-05", payload='{"prices": [{"da'),
    pull("C", "2021-01-06", payload='{"prices": "none"}'),
    pull("C", "2021-01-07", payload="{}"),
    pull("C", "2021-01-08", payload='{"prices": []}'),
    pull("D", "2021-01-05", payload=None),
    ("PX", "E", dt.datetime(2021, 1, 5), None),
]


def frame(spark, pulls):
    return spark.createDataFrame(pulls, PULLS)


def test_reasons(spark):
    rows = landing.parse_prices(frame(spark, ONE)).collect()
    got = sorted((r["ticker"], r["pos"], r["date_text"], r["reason"]) for r in rows if r["pos"] is not None)
    close, adj = "non-positive or null close", "non-positive or null adj_close"
    assert got == [
        ("A", 0, "2021-01-04", None), ("A", 1, "2021-01-04", None), ("A", 2, "2021-01-05", close),
        ("B", 0, "2021-01-04", adj), ("B", 1, "soon", "bad date"), ("B", 2, "2021-01-06", close),
    ]
    whole = sorted((r["ticker"], r["reason"]) for r in rows if r["pos"] is None)
    assert whole == [("C", "unreadable payload")] * 2 + [("E", "unreadable payload")]


def test_replay_takes_the_last_entry_fetched(spark):
    more = [pull("A", "2021-01-04", ("2021-01-04", 9, 9, 9)), pull("A", "2021-02-01", ("2021-01-04", 7, 7, None))]
    got = [tuple(r) for r in landing.replay_prices(frame(spark, ONE + more[:1])).collect()]
    assert got == [("A", day("2021-01-04"), 2.0, 2.0, 11.0)]
    got = [tuple(r) for r in landing.replay_prices(frame(spark, ONE + more)).collect()]
    assert got == [("A", day("2021-01-04"), 7.0, 7.0, None)]


def many_pulls(seed, tickers="ABCDE", n=60):
    """Pulls that restate each other's days, with bad entries among them."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        days = [f"2021-{rng.randint(1, 2):02}-{rng.randint(1, 28):02}" for _ in range(rng.randint(0, 6))]
        entries = [(rng.choice([d, "bad", d, d]), rng.choice([k + 1, "x", 0, k + 2]), k + 1, 5) for d in days]
        out.append(pull(rng.choice(tickers), f"2021-03-01T{k // 60:02}:{k % 60:02}:00", *entries))
    return out


def rows_of(frame_):
    return sorted(map(tuple, frame_.collect()), key=repr)


def take_up(spark, store, raw):
    ingest.incremental_prices(
        spark, raw, store.path("landed_prices"), store.path("_price_progress"), stats_path=store.path("price_stats"), max_files=1
    )


def test_rebuilt_store_equals_the_first(spark, tmp_path):
    """Pulls land out of order in three rounds; a store built from the files alone is the same, rejects included."""
    pulls = many_pulls(1)
    raw, store, again = str(tmp_path / "raw"), Store(str(tmp_path / "a")), Store(str(tmp_path / "b"))
    for some in (pulls[40:], pulls[:10], pulls[10:40]):
        landing.land_raw(frame(spark, some), raw)
        take_up(spark, store, raw)
    take_up(spark, again, raw)
    want = rows_of(landing.replay_prices(frame(spark, pulls)).select("ticker", "date", "close", "adj_close", "shares_out"))
    assert rows_of(stored_prices(spark, store)) == rows_of(stored_prices(spark, again)) == want and len(want) > 20
    rejects = [rows_of(rejected_prices(spark, s).select("ticker", "date_text", "close_text", "fetched_at", "reason")) for s in (store, again)]
    assert rejects[0] == rejects[1] and len(rejects[0]) > 20
    assert rows_of(series_errors(spark, store)) == rows_of(series_errors(spark, again))
    # Folded into a new store, and the old landing taken up there once more: nothing changes.
    folded = Store(str(tmp_path / "c"))
    compact_store(spark, store, folded)
    assert rows_of(stored_prices(spark, folded)) == want
    assert rows_of(series_errors(spark, folded)) == rows_of(series_errors(spark, store))
    landing.land_raw(frame(spark, [pull("A", "2021-03-01T00:30:30", *[("2021-01-01", 5, 5, 5)])]), str(tmp_path / "late"))
    take_up(spark, folded, str(tmp_path / "late"))
    replayed = landing.replay_prices(frame(spark, pulls + [pull("A", "2021-03-01T00:30:30", ("2021-01-01", 5, 5, 5))]))
    assert rows_of(stored_prices(spark, folded)) == rows_of(replayed.select("ticker", "date", "close", "adj_close", "shares_out"))


def test_refresh_from_landed_prices(spark, tmp_path):
    raw, store = str(tmp_path / "raw"), Store(str(tmp_path / "store"))
    days = [f"2021-01-{d:02}" for d in range(4, 9)]
    landing.land_raw(frame(spark, [pull("A", "2021-01-09", *[(d, 10 + k, 10 + k, 5) for k, d in enumerate(days)]), ONE[2]]), raw)
    secs = spark.createDataFrame([("A", "metal", None, None)], "ticker string, subsector string, from_date date, to_date date")
    none = spark.createDataFrame([], "index_id string, ticker string")

    def run(**more):
        report = refresh(spark, store, landing_path=None, price_landing_path=raw, securities=secs, baselines=none, batch=1, prefix="ALL", **more)
        return {r.step: (r.rows, r.errors, r.error) for r in report.collect()}

    got = run()
    assert got["prices"] == (5, 1, None) and got["index_values"] == (10, 0, None)
    assert run() == got
    # A price written by hand counts as fetched now and stands over landed ones.
    hand = spark.createDataFrame([("A", day("2021-01-08"), 99.0, 99.0, 5.0)], "ticker string, date date, close double, adj_close double, shares_out double")
    assert run(prices=hand)["prices"] == (5, 1, None)
    assert stored_prices(spark, store).filter("close = 99").count() == 1


def test_counts_equal_a_recount_after_three_batches(spark, tmp_path):
    rng = random.Random(5)
    raw, stats = str(tmp_path / "raw"), str(tmp_path / "stats")
    landed = []
    for k in range(3):
        pulls = []
        for j in range(8):
            entries = [{"date": f"20{10 + rng.randrange(9)}-01-01", "value": rng.choice(["1", ".", "x", None])} for _ in range(rng.randrange(4))]
            doc = "{" if j == 0 else json.dumps({"observations": entries})
            pulls.append(("S", rng.choice("XYZ"), dt.datetime(2021, 1, 1 + k, j), doc))
        landed += pulls
        landing.land_raw(frame(spark, pulls), raw)
        for _ in range(2):  # a second run takes up nothing
            ingest.incremental_ingest(spark, raw, str(tmp_path / "obs"), str(tmp_path / "rej"), str(tmp_path / "cp"), stats_path=stats)
    got = rows_of(ingest.ingest_stats(spark, stats))
    assert got == rows_of(ingest.batch_stats(landing.tag_payload(frame(spark, landed))))
    bounds = ingest.ingest_stats(spark, stats).filter("entries > 0").select("source", "series_id", "first_obs", "last_obs")
    assert rows_of(bounds) == rows_of(ingest.stored_bounds(spark, str(tmp_path / "obs")))
    errors = ingest.ingest_stats(spark, stats).groupBy().agg(F.sum("errors")).first()[0]
    assert errors == writers.read_batches(spark, str(tmp_path / "rej"), landing.RAW_LANDING).count() > 0


def test_catalogue_takes_the_counted_bounds(spark, tmp_path):
    raw, store = str(tmp_path / "raw"), Store(str(tmp_path / "store"))
    doc = '{"observations": [{"date": "2020-01-01", "value": "1"}, {"date": "2020-05-01", "value": "."}]}'
    landing.land_raw(frame(spark, [("S", "X", dt.datetime(2020, 6, 1), doc)]), raw)
    specs = spark.createDataFrame([("S", "X", "x", "M", "u", "m")], "source string, series_id string, metric_name string, frequency string, unit string, subsector string")
    none = spark.createDataFrame([], "index_id string, ticker string")
    refresh(spark, store, landing_path=raw, specs=specs, baselines=none, batch=1, prefix="ALL").collect()
    row = stored_series_meta(spark, store).first()
    assert (str(row["first_obs"]), str(row["last_obs"])) == ("2020-01-01", "2020-05-01")
