import datetime as dt

from helpers import day, prices, values
from pyspark.sql import functions as F

from tidemark.operators import quality, readers, writers
from tidemark.schemas import OBSERVATION_KEY, OBSERVATIONS, PRICE_KEY, PRICES, SECURITIES, SERIES_META
from tidemark.sources import landing, prices as price_source
from tidemark.streaming import ingest


def test_quarantine(spark):
    rows = [
        ("fine", "12.5", "12.25"), ("zero", "0", "7.5"), ("below", "-0.01", "7.5"), ("half", "3.75", None),
        ("words", "closed", "2"), ("nan", "NaN", "2"), ("endless", "Infinity", "2"), ("neither", "0", "-1"),
    ]
    frame = spark.createDataFrame(rows, "ticker string, close string, adj_close string")
    clean, rejected = quality.sanitize_prices(frame)
    assert [r.ticker for r in clean.collect()] == ["fine", "endless"]
    reasons = {r.ticker: r.reason for r in rejected.collect()}
    assert reasons.pop("half") == "non-positive or null adj_close"
    assert set(reasons) == {"zero", "below", "words", "nan", "neither"}
    assert set(reasons.values()) == {"non-positive or null close"}


def test_quarantine_of_nothing(spark):
    clean, rejected = quality.sanitize_prices(spark.createDataFrame([], PRICES))
    assert clean.count() == 0 and rejected.count() == 0
    assert rejected.columns[-1] == "reason"


def test_quarantine_examples_are_few_and_counts_whole(spark):
    frame = spark.range(1000).select(
        F.format_string("T%03d", F.col("id") % 50).alias("ticker"), F.lit(0.0).alias("close"), F.lit(1.0).alias("adj_close")
    )
    row = quality.quarantine_summary(quality.sanitize_prices(frame)[1]).collect()[0]
    assert row.rows == 1000 and row.tickers == ["T000", "T001", "T002", "T003", "T004"]


def obs(spark, rows):
    data = [("S", k, day(d), day(a), v) for k, d, a, v in rows]
    return spark.createDataFrame(data, OBSERVATIONS)


def test_upsert_keeps_vintages_and_is_idempotent(spark):
    first = obs(spark, [("X", "2020-01-01", "2020-01-15", 1.0), ("X", "2020-01-01", "2020-02-15", 2.0)])
    batch = obs(spark, [("X", "2020-01-01", "2020-02-15", None), ("X", "2020-02-01", "2020-02-15", 4.0)])
    once = writers.upsert_observations(first, batch)
    twice = writers.upsert_observations(once, batch)
    want = [
        (day("2020-01-01"), day("2020-01-15"), 1.0),
        (day("2020-01-01"), day("2020-02-15"), None),
        (day("2020-02-01"), day("2020-02-15"), 4.0),
    ]
    for frame in (once, twice):
        assert values(frame, "date", "as_of", "value", order=["date", "as_of"]) == want


def test_last_duplicate_in_a_batch_wins(spark):
    batch = prices(spark, [("A", "2020-01-01", 1.0, 1.0, 1.0), ("A", "2020-01-01", 2.0, 2.0, 2.0)]).withColumn(
        "seq", F.col("close").cast("int")
    )
    out = writers.upsert_prices(spark.createDataFrame([], PRICES), batch, seq="seq")
    assert values(out, "close", "adj_close", "shares_out") == [(2.0, 2.0, 2.0)]


def test_upsert_securities_empty_text_is_open(spark):
    first = spark.createDataFrame([("A", "a", "s", day("2020-01-01"), None, None)], SECURITIES)
    batch = spark.createDataFrame(
        [("A", "a2", "s", "", "2021-01-01", None), ("B", "b", "s", None, "", None)],
        "ticker string, name string, subsector string, from_date string, to_date string, notes string",
    )
    out = writers.upsert_securities(first, batch)
    assert values(out, "ticker", "name", "from_date", "to_date", order="ticker") == [
        ("A", "a2", None, day("2021-01-01")), ("B", "b", None, None),
    ]


def test_series_meta(spark):
    specs = spark.createDataFrame([("S", "X", "x", "M", "u", "sub")], "source string, series_id string, metric_name string, frequency string, unit string, subsector string")
    bounds = readers.series_bounds(obs(spark, [("X", "2020-01-01", "2020-01-15", 1.0), ("X", "2020-03-01", "2020-03-15", 1.0)]))
    out = writers.upsert_series_meta(spark.createDataFrame([], SERIES_META), specs, bounds, fetched_at="2021-01-01 00:00:00")
    assert values(out, "first_obs", "last_obs", "last_fetched", order="series_id") == [
        (day("2020-01-01"), day("2020-03-01"), dt.datetime(2021, 1, 1))
    ]


def test_store_batches(spark, tmp_path):
    path = str(tmp_path / "prices")
    writers.write_batch(prices(spark, [("A", "2020-01-01", 1.0, 1.0, 1.0), ("B", "2020-01-01", 5.0, 5.0, 5.0)]), path, 0)
    for _ in range(2):
        writers.write_batch(prices(spark, [("A", "2020-01-01", 2.0, 2.0, None)]), path, 1)
    want = [("A", 2.0, None), ("B", 5.0, 5.0)]
    assert values(writers.read_store(spark, path, PRICES, PRICE_KEY), "ticker", "close", "shares_out", order="ticker") == want
    writers.compact(spark, path, str(tmp_path / "folded"), PRICES, PRICE_KEY)
    folded = writers.read_store(spark, str(tmp_path / "folded"), PRICES, PRICE_KEY)
    assert values(folded, "ticker", "close", "shares_out", order="ticker") == want


def test_replace_index_touches_only_its_ids(spark, tmp_path):
    v, w = str(tmp_path / "v"), str(tmp_path / "w")
    lv = "index_id string, date date, level_pr double, level_tr double"
    wt = "index_id string, rebalance_date date, ticker string, weight double"
    d = day("2020-01-01")
    writers.replace_index(
        spark.createDataFrame([("A", d, 1.0, 1.0), ("B", d, 2.0, 2.0)], lv),
        spark.createDataFrame([("A", d, "t", 1.0), ("B", d, "t", 1.0)], wt), v, w,
    )
    # B comes back without weights: its old ones must go, A's must stay.
    writers.replace_index(spark.createDataFrame([("B", d, 3.0, 3.0)], lv), spark.createDataFrame([], wt), v, w)
    assert values(writers.read_index_values(spark, v), "index_id", "level_pr", order="index_id") == [("A", 1.0), ("B", 3.0)]
    assert values(writers.read_index_weights(spark, w), "index_id", "ticker", order="index_id") == [("A", "t")]


def pulls(spark, rows):
    data = [("S", s, dt.datetime.fromisoformat(t), p) for s, t, p in rows]
    return spark.createDataFrame(data, "source string, series_id string, fetched_at timestamp, payload string")


PAYLOAD = """{"observations": [{"date": "2020-01-01", "value": "100.5"}, {"date": "2020-02-01", "value": "."},
             {"date": "2020-03-01", "value": "101.2"}, {"date": "2020-04-01", "value": ""},
             {"date": "2020-05-01", "value": null}]}"""


def test_normalize_payload(spark):
    good, bad = landing.normalize_payload(pulls(spark, [("X", "2020-06-01T10:00:00", PAYLOAD)]))
    assert values(good, "date", "value") == [
        (day("2020-01-01"), 100.5), (day("2020-02-01"), None), (day("2020-03-01"), 101.2),
        (day("2020-04-01"), None), (day("2020-05-01"), None),
    ]
    assert {(r.as_of, r.as_of_is_fetch) for r in good.collect()} == {(day("2020-06-01"), True)}
    assert bad.count() == 0


def test_bad_payloads_are_rejected_without_harm(spark):
    broken = '{"observations": [{"date": "2020-01-01", "value": "n/a"}, {"date": "soon", "value": "1"}, {"date": "2020-01-02", "value": "2"}]}'
    good, bad = landing.normalize_payload(
        pulls(spark, [("X", "2020-06-01T10:00:00", broken), ("Y", "2020-06-01T10:00:00", "no json"), ("Z", "2020-06-01T10:00:00", '{"observations": []}')])
    )
    assert values(good, "series_id", "date", "value") == [("X", day("2020-01-02"), 2.0)]
    odd = ['{"note": 1}', '{"observations": null}', '{"observations": "x"}', '{"observations": [{"date": "2020-01-01", "value": "nan"}]}']
    fine, broken = landing.normalize_payload(pulls(spark, [(str(i), "2020-06-01T10:00:00", p) for i, p in enumerate(odd)]))
    assert values(fine, "series_id", "value", order="series_id") == [("3", None)]
    assert sorted(r.series_id for r in broken.collect()) == ["1", "2"]
    counts = {(r.series_id, r.reason): r.rows for r in landing.reject_counts(bad).collect()}
    assert counts == {("X", "bad value"): 1, ("X", "bad date"): 1, ("Y", "unreadable payload"): 1}


def test_landing_is_replayable(spark, tmp_path):
    path = str(tmp_path / "raw")
    one = '{"observations": [{"date": "2020-01-01", "value": "1"}]}'
    two = '{"observations": [{"date": "2020-01-01", "value": "2"}]}'
    for stamp, doc in (("2020-06-01T10:00:00", one), ("2020-06-01T12:00:00", two), ("2020-06-02T10:00:00", one)):
        landing.land_raw(pulls(spark, [("odd/na me", stamp, doc)]), path, by_series=True)
    assert (tmp_path / "raw" / "source_dir=S" / "series_dir=odd_na_me").exists()
    out = landing.replay_landing(landing.read_landing(spark, path))
    assert values(out, "series_id", "as_of", "value", order="as_of") == [
        ("odd/na me", day("2020-06-01"), 2.0), ("odd/na me", day("2020-06-02"), 1.0),
    ]


def test_stream_equals_replay_and_repeats_safely(spark, tmp_path):
    raw, store, bad, progress = (str(tmp_path / x) for x in ("raw", "store", "bad", "progress"))
    for i, stamp in enumerate(("2020-06-01T10:00:00", "2020-06-01T12:00:00", "2020-07-01T10:00:00")):
        doc = '{"observations": [{"date": "2020-01-01", "value": "%d"}, {"date": "2020-02-01", "value": "x%d"}]}' % (i, i)
        landing.land_raw(pulls(spark, [("X", stamp, doc)]), raw)
        ingest.incremental_ingest(spark, raw, store, bad, progress)
        ingest.incremental_ingest(spark, raw, store, bad, progress)
    stored = ingest.stored_observations(spark, store)
    replayed = landing.replay_landing(landing.read_landing(spark, raw))
    cols = ["series_id", "date", "as_of", "value"]
    assert values(stored, *cols, order=cols) == values(replayed, *cols, order=cols)
    assert values(stored, "as_of", "value", order="as_of") == [(day("2020-06-01"), 1.0), (day("2020-07-01"), 2.0)]
    assert spark.read.parquet(bad).count() == 3
    assert quality.duplicate_keys(stored, OBSERVATION_KEY).isEmpty()


def test_align_shares(spark):
    dates = spark.createDataFrame(
        [(t, day(d)) for t in "ABC" for d in ("2020-01-01", "2020-01-05", "2020-01-09")], "ticker string, date date"
    )
    history = spark.createDataFrame(
        [("A", day("2020-01-05"), 1, 10.0), ("A", day("2020-01-05"), 2, 20.0), ("B", day("2020-01-20"), 1, 5.0)],
        "ticker string, date date, seq int, shares double",
    )
    static = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "ticker string, shares double")
    out = values(price_source.align_shares(dates, history, static), "ticker", "shares_out", order=["ticker", "date"])
    assert out == [("A", None), ("A", 20.0), ("A", 20.0), ("B", 2.0), ("B", 2.0), ("B", 2.0), ("C", None), ("C", None), ("C", None)]


def test_canonical_prices(spark):
    raw = spark.createDataFrame(
        [("A", dt.datetime(2020, 1, 1, 5), "1.5", "1", "10"), ("A", dt.datetime(2019, 1, 1), "1", "1", "1"), ("Z", dt.datetime(2020, 1, 1), "1", "1", "1")],
        "ticker string, date timestamp, close string, adj_close string, shares_out string",
    )
    wanted = spark.createDataFrame([("A",)], "ticker string")
    assert values(price_source.canonical_prices(raw, wanted, "2020-01-01"), "ticker", "date", "close") == [("A", day("2020-01-01"), 1.5)]


def test_replay_reads_only_the_folders_asked_for(spark, tmp_path):
    path = str(tmp_path / "landing")
    doc = '{"observations": [{"date": "2020-01-01", "value": "1"}]}'
    for d in (1, 2, 3):
        landing.land_raw(pulls(spark, [(k, f"2020-05-0{d} 00:00:00", doc) for k in "ab"]), path)
    rows = landing.read_landing(spark, path, source="S", since="2020-05-02", until="2020-05-02")
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 2 and "PartitionFilters: [isnotnull(source_dir" in text and "fetch_day" in text
    assert landing.read_landing(spark, path).count() == 6 and landing.read_landing(spark, path, source="none").count() == 0
