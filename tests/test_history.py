"""Reads as known on many dates, and running values over cut histories, against plain windows and brute force."""

import datetime as dt
import random

import pytest
from helpers import day, shuffled
from pyspark.sql import Window, functions as F

from tidemark.operators import align, readers, scan, signals
from tidemark.schemas import OBSERVATIONS


def vintages(spark, rows):
    """rows of (series, period, as_of, value)"""
    data = [("S", s, day(p), day(a), v) for s, p, a, v in rows]
    return spark.createDataFrame(data, OBSERVATIONS)


def dates(spark, days):
    return spark.createDataFrame([(None if d is None else day(d),) for d in days], "known_date date")


ROWS = [
    ("X", "2020-01-01", "2020-01-15", 100.0), ("X", "2020-01-01", "2020-02-15", 105.0), ("X", "2020-01-01", "2020-02-20", 105.0),
    ("X", "2020-02-01", "2020-02-15", None), ("X", "2020-02-01", "2020-03-15", 7.0), ("Y", "2020-01-01", "2020-02-15", 1.0),
]


def known(spark, days, rows=ROWS):
    out = readers.series_as_known_on_dates(vintages(spark, rows), dates(spark, days))
    return sorted(map(tuple, out.select("known_date", "series_id", "date", "value").collect()), key=repr)


def one_by_one(spark, days, rows=ROWS):
    out = []
    for d in sorted({d for d in days if d}):
        found = readers.series_as_known_on(vintages(spark, rows), d).select("series_id", "date", "value").collect()
        out += [(day(d), *r) for r in found]
    return sorted(out, key=repr)


@pytest.mark.parametrize(
    "days",
    [
        ["2020-02-16", "2020-01-15", "2020-02-14", "2020-02-16", None, "2021-01-01"],
        ["2020-01-20"], ["2019-01-01"], ["2019-01-01", "2030-01-01"], [], [None], ["2020-02-15", "2020-02-20", "2020-03-15"],
    ],
)
def test_known_on_many_dates(spark, days):
    assert known(spark, days) == one_by_one(spark, days)


def test_known_on_many_dates_random(spark):
    rng = random.Random(6)
    at = lambda: (dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(200))).isoformat()
    rows = list({(s, p, a): (s, p, a, rng.choice([None, 1.0, rng.random()])) for s in "ABC" for p in ("2019-01-01", "2019-02-01") for a in (at() for _ in range(40))}.values())
    days = [at() for _ in range(30)]
    assert known(spark, days, rows) == one_by_one(spark, days, rows)


def test_known_on_many_dates_of_a_store(spark):
    """A vintage written twice counts as its last write says."""
    obs = vintages(spark, [("X", "2020-01-01", "2020-01-15", 1.0)]).withColumn("batch", F.lit(0).cast("long"))
    obs = obs.unionByName(vintages(spark, [("X", "2020-01-01", "2020-01-15", 2.0)]).withColumn("batch", F.lit(3).cast("long")))
    out = readers.series_as_known_on_dates(obs, dates(spark, ["2020-02-01"]), write_order="batch")
    assert [r["value"] for r in out.collect()] == [2.0]
    held = readers.validity_intervals(obs, write_order="batch").collect()
    assert [(r["value"], r["valid_from"], r["valid_until"]) for r in held] == [(2.0, day("2020-01-15"), None)]


def test_known_on_many_dates_never_pairs_vintages_with_dates(spark):
    """Many vintages and many dates, few results: no step holds vintages x dates rows."""
    rows = [("X", "2020-01-01", (dt.date(2020, 1, 1) + dt.timedelta(k)).isoformat(), float(k)) for k in range(1000)]
    days = [(dt.date(2020, 1, 1) + dt.timedelta(k)).isoformat() for k in range(0, 1000, 2)]
    out = readers.series_as_known_on_dates(vintages(spark, rows), dates(spark, days))
    assert out.count() == 500
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_validity_intervals(spark):
    got = [tuple(r)[1:] for r in readers.validity_intervals(vintages(spark, ROWS)).orderBy("series_id", "date", "valid_from").collect()]
    assert got == [
        ("X", day("2020-01-01"), 100.0, day("2020-01-15"), day("2020-02-15")),
        ("X", day("2020-01-01"), 105.0, day("2020-02-15"), None),
        ("X", day("2020-02-01"), None, day("2020-02-15"), day("2020-03-15")),
        ("X", day("2020-02-01"), 7.0, day("2020-03-15"), None),
        ("Y", day("2020-01-01"), 1.0, day("2020-02-15"), None),
    ]


# --- running values over parts -----------------------------------------------------------


def history(spark, n=600, seed=1):
    """One key with nine tenths of the rows, a few short ones and a null key; gaps and empty years among them."""
    rng = random.Random(seed)
    rows, t = [], dt.datetime(2000, 1, 1)
    for k in range(n):
        t += dt.timedelta(days=rng.choice([0, 1, 3, 30, 900 if k % 97 == 0 else 1]), seconds=k + 1)
        key = "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None])
        rows.append((key, t, None if rng.random() < 0.3 else float(rng.randrange(-5, 50)), k))
    rows += [("lone", dt.datetime(1999, 5, 5), 3.0, n), ("nulls", dt.datetime(1999, 5, 5), None, n + 1)]
    return shuffled(spark.createDataFrame(rows, "key string, date timestamp, value double, id long"))


def alike(got, want):
    a, b = (sorted((tuple(r) for r in f.select(sorted(f.columns)).collect()), key=repr) for f in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and u == pytest.approx(v, rel=1e-9, abs=1e-9)), (x, y)


def year():
    return F.year("date")


@pytest.mark.parametrize("part", [year, lambda: F.lit(1), lambda: F.to_date("date")])
def test_running_equals_one_window(spark, part):
    rows = history(spark)
    upto = Window.partitionBy("key").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumns({"l": F.last("value", ignorenulls=True).over(upto), "t": F.sum("value").over(upto), "n": F.sum(F.lit(1)).over(upto)})
    got = scan.running(rows, ["key"], ["date"], part=part(), last={"l": F.col("value")}, total={"t": F.col("value"), "n": F.lit(1)})
    alike(got, want)


def test_running_without_keys_and_rows(spark):
    rows = history(spark, 50)
    upto = Window.partitionBy(F.lit(0)).orderBy("date", "id").rowsBetween(Window.unboundedPreceding, 0)
    alike(scan.running(rows, [], ["date", "id"], part=year(), total={"n": F.lit(1)}), rows.withColumn("n", F.sum(F.lit(1)).over(upto)))
    assert scan.running(rows.limit(0), ["key"], ["date"], part=year(), total={"n": F.lit(1)}).count() == 0


@pytest.mark.parametrize("block_rows", [1, 7, 40, 10_000])
@pytest.mark.parametrize("back", [0, 1, 13])
def test_blocks_equal_one_window(spark, block_rows, back):
    rows = history(spark, 300)

    def compute(frame, keys):
        w = Window.partitionBy(*keys).orderBy("date")
        return frame.withColumns({"s": F.sum("value").over(w.rowsBetween(-back, 0)), "g": F.lag("id", back).over(w)})

    alike(scan.over_blocks(rows, ["key"], ["date"], compute, back=back, part=year(), block_rows=block_rows), compute(rows, ["key"]))


def test_signals_over_parts_equal_plain_ones(spark):
    rows = history(spark)
    full = rows.dropna(subset=["value"])
    alike(signals.pct_change(rows, 5, keys=["key"], part=year()), signals.pct_change(rows, 5, keys=["key"]))
    alike(signals.zscore(full, 20, keys=["key"], part=year()), signals.zscore(full, 20, keys=["key"]))
    alike(signals.smooth(full, 20, keys=["key"], part=year()), signals.smooth(full, 20, keys=["key"]))
    coded = full.withColumn("f", F.when(F.col("id") % 2 == 0, F.lit("Q")).otherwise("A"))
    alike(signals.zscore(coded, keys=["key"], frequency="f", part=year()), signals.zscore(coded, keys=["key"], frequency="f"))


def test_asof_over_parts_equals_the_plain_one(spark):
    left, right = history(spark, 400, 2), history(spark, 300, 3)
    right = right.withColumn("tie", F.col("id")).drop("id")
    options = {"keys": ["key"], "columns": ["value"], "tie": "tie"}
    left = left.drop("value")
    plain = align.asof_align(left, right, **options)
    alike(align.asof_align(left, right, part=year(), **options), plain)
    alike(align.asof_align(left, right, left_is_unique=True, **options), plain)
    doubled = left.unionByName(left)
    alike(align.asof_align(doubled, right, part=year(), **options), align.asof_align(doubled, right, **options))


def test_a_hot_key_spreads_over_tasks(spark):
    """One key with most rows: the largest task holds a small share of them."""
    rows = spark.range(20_000).select(
        F.lit("hot").alias("key"), F.timestamp_seconds(F.lit(9e8) + F.col("id") * 40_000).alias("date"), F.rand(1).alias("value")
    )

    def largest(frame):
        counts = frame.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("l")).collect()
        return max(r["n"] for r in counts) / sum(r["n"] for r in counts)

    def lagged(frame, keys):
        return frame.withColumn("l", F.lag("value", 10).over(Window.partitionBy(*keys).orderBy("date")))

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert largest(scan.running(rows, ["key"], ["date"], part=year(), last={"l": F.col("value")})) < 0.6
        assert largest(scan.over_blocks(rows, ["key"], ["date"], lagged, back=10, part=year(), block_rows=1000)) < 0.6
        assert largest(lagged(rows, ["key"])) == 1.0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_move_once_for_running_values(spark):
    rows = spark.createDataFrame([], "key string, date timestamp, value double")
    text = scan.running(rows, ["key"], ["date"], part=year(), last={"l": F.col("value")})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text
