import pytest
from helpers import day, values

from tidemark.operators import quality, readers, universe
from tidemark.schemas import OBSERVATIONS


def observations(spark):
    rows = [
        ("FRED", "X", day("2020-01-01"), day("2020-01-15"), 100.0),
        ("FRED", "X", day("2020-01-01"), day("2020-02-15"), 105.0),
        ("FRED", "X", day("2020-03-01"), day("2020-03-15"), 7.0),
        ("FRED", "Y", day("2020-01-01"), day("2020-01-15"), 1.0),
        ("FRED", "Y", day("2020-01-01"), day("2020-05-15"), None),
    ]
    return spark.createDataFrame(rows, OBSERVATIONS)


def test_latest_vintage_and_point_in_time(spark):
    obs = observations(spark)
    now = readers.current_series(obs, "FRED", "X")
    assert values(now, "date", "value") == [(day("2020-01-01"), 105.0), (day("2020-03-01"), 7.0)]
    then = readers.series_as_known_on(obs, "2020-01-20", "FRED", "X")
    assert values(then, "date", "value") == [(day("2020-01-01"), 100.0)]
    assert readers.series_as_known_on(obs, "2019-01-01").count() == 0


def test_newest_vintage_may_be_null(spark):
    now = readers.current_series(observations(spark), series_id="Y")
    assert values(now, "value") == [(None,)]


def test_last_write_of_the_newest_vintage(spark):
    from pyspark.sql import functions as F

    first = observations(spark).withColumn("batch", F.lit(0))
    again = observations(spark).withColumn("value", F.col("value") + 1).withColumn("batch", F.lit(1))
    both = again.unionByName(first)
    now = readers.current_series(both, series_id="X", write_order="batch")
    assert values(now, "value") == [(106.0,), (8.0,)]
    then = readers.series_as_known_on(both, "2020-01-20", series_id="X", write_order="batch")
    assert values(then, "value") == [(101.0,)]


def test_batch_numbers_have_no_limit(spark):
    """A batch numbered by milliseconds never outweighs a newer vintage."""
    rows = [("S", "X", day("2020-01-01"), day("2020-02-01"), 1.0, 1_700_000_000_000), ("S", "X", day("2020-01-01"), day("2020-02-02"), 2.0, -5)]
    rows += [("S", "Y", day("2020-01-01"), day("2020-02-01"), v, b) for v, b in ((3.0, 2**63 - 1), (4.0, -(2**63)))]
    obs = spark.createDataFrame(rows, "source string, series_id string, date date, as_of date, value double, batch long")
    now = readers.current_series(obs, write_order="batch")
    assert values(now, "value", order="series_id") == [(2.0,), (3.0,)]
    assert "SortAggregate" not in now._jdf.queryExecution().executedPlan().toString()


def test_last_date(spark):
    obs = observations(spark)
    assert readers.last_obs_date_of(obs, "FRED", "X").collect()[0][0] == day("2020-03-01")
    assert readers.last_obs_date_of(obs, "FRED", "none").collect()[0][0] is None
    assert values(readers.last_obs_date(obs), "series_id", "last_obs", order="series_id") == [
        ("X", day("2020-03-01")),
        ("Y", day("2020-01-01")),
    ]


def test_asof_value_skips_nulls(spark):
    rows = [("a", day("2020-01-01"), 1.0), ("a", day("2020-01-02"), None), ("b", day("2020-02-01"), 2.0)]
    frame = spark.createDataFrame(rows, "key string, date date, value double")
    assert values(readers.asof_value(frame, "2020-01-15", keys=["key"]), "key", "value", order="key") == [("a", 1.0)]


def test_prices_wide_rejects_other_columns(spark):
    frame = spark.createDataFrame([("A", day("2020-01-01"), 1.0)], "ticker string, date date, close double")
    assert readers.prices_wide(frame, "close", ["A", "B"]).collect()[0].asDict() == {
        "date": day("2020-01-01"), "A": 1.0, "B": None,
    }
    with pytest.raises(ValueError):
        readers.prices_wide(frame, "open", ["A"])


def test_membership_bounds_are_inclusive(spark):
    from helpers import members

    mem = members(spark, [("I", "A", "2020-01-01", "2020-04-01"), ("I", "B", None, None), ("I", "C", "2020-04-02", None)])
    dates = spark.createDataFrame(
        [("I", day(d)) for d in ("2020-01-01", "2020-04-01", "2020-07-01")], "index_id string, rebalance_date date"
    )
    got = values(universe.eligible_members(mem, dates), "rebalance_date", "ticker", order=["rebalance_date", "ticker"])
    assert got == [
        (day("2020-01-01"), "A"), (day("2020-01-01"), "B"),
        (day("2020-04-01"), "A"), (day("2020-04-01"), "B"),
        (day("2020-07-01"), "B"), (day("2020-07-01"), "C"),
    ]


def test_tag_filter(spark):
    rows = [("two", 2, ["Devices", "Digital health"]), ("one", 1, ["Biotech", "AI tools"]), ("three", 3, ["Payers"])]
    recs = spark.createDataFrame(rows, "slug string, rank int, focus array<string>")
    assert [r.slug for r in universe.tag_filter(recs, ["ai", "DEVICE"]).collect()] == ["one", "two"]
    # A term may span two neighbouring tags.
    assert [r.slug for r in universe.tag_filter(recs, ["biotech ai"]).collect()] == ["one"]
    assert [r.slug for r in universe.tag_filter(recs, []).collect()] == ["one", "two", "three"]
    assert universe.record_by_slug(recs, "two").count() == 1
    with pytest.raises(KeyError):
        universe.record_by_slug(recs, "nobody")


def test_staleness(spark):
    rows = [("M", day("2026-05-01")), ("M", day("2025-01-01")), ("M", None), (None, day("2026-05-01")), ("D", day("2026-06-01"))]
    meta = spark.createDataFrame(rows, "frequency string, last_obs date")
    assert [r.stale for r in quality.staleness(meta, "2026-06-13").collect()] == [False, True, True, False, True]


def test_unique_key_check(spark):
    frame = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "a int, b int")
    with pytest.raises(ValueError):
        quality.assert_unique_key(frame, ["a", "b"])
    assert quality.assert_unique_key(frame.distinct(), ["a"]).count() == 2
