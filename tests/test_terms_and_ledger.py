"""Filters by many terms against a loop, and the ledger of dropped rows against a count."""

import random

import pytest
from helpers import day, month_ends, series
from pyspark.sql import Observation, functions as F

from tidemark.operators import forecast, universe


def records(spark, tag_lists):
    data = [(f"s{k}", k, tags) for k, tags in enumerate(tag_lists)]
    return spark.createDataFrame(data, "slug string, rank int, focus array<string>")


def terms(spark, words):
    return spark.createDataFrame([(w,) for w in words], "term string")


def loop(tag_lists, words):
    words = [w.lower() for w in words if w is not None]
    joined = [None if t is None else " ".join(x for x in t if x is not None).lower() for t in tag_lists]
    return [f"s{k}" for k, text in enumerate(joined) if not words or (text is not None and any(w in text for w in words))]


def kept(spark, tag_lists, words):
    return [r["slug"] for r in universe.tag_filter_many(records(spark, tag_lists), terms(spark, words)).collect()]


TAGS = [["Alpha beta", "GAMMA"], ["a"], [], None, ["ab", None, "cd"], ["Ünï", "x.y*z"], ["aaaa"], ["alpha"] * 3, [""]]


@pytest.mark.parametrize(
    "words",
    [["BETA gam"], ["a"], ["ab cd"], ["b c"], [""], [None], [], ["zzz", None], ["ünï x"], [".y*"], ["aaa"], ["aaaaa"], ["al", "xyz", "ha"], [" "]],
)
def test_terms(spark, words):
    assert kept(spark, TAGS, words) == loop(TAGS, words)
    if words and None not in words:
        same = universe.tag_filter(records(spark, TAGS), words).collect()
        assert kept(spark, TAGS, words) == [r["slug"] for r in same]


def test_many_terms_against_a_loop(spark):
    rng = random.Random(4)
    word = lambda a, b: "".join(rng.choice("abcde") for _ in range(rng.randint(a, b)))
    tag_lists = [[word(1, 6) for _ in range(rng.randint(0, 4))] for _ in range(400)]
    words = [word(5, 9) + rng.choice(["", " " + word(1, 3)]) for _ in range(3000)]
    got = kept(spark, tag_lists, words)
    assert got == loop(tag_lists, words) and 0 < len(got) < 400


def test_a_hundred_thousand_terms(spark):
    """Terms meet records on rare runs of letters; the plan has no product of the two."""
    rows = spark.range(3000).select(
        F.concat(F.lit("s"), F.col("id")).alias("slug"), F.col("id").cast("int").alias("rank"),
        F.array(F.sha2(F.col("id").cast("string"), 256), F.lit("common tail")).alias("focus"),
    )
    every = spark.range(100_000).select(F.substring(F.sha2((F.col("id") + 2900).cast("string"), 256), 5, 20).alias("term"))
    out = universe.tag_filter_many(rows, every)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert [r["rank"] for r in out.collect()] == list(range(2900, 3000))


def test_columns_that_clash(spark):
    rows = records(spark, TAGS).withColumnsRenamed({"slug": "text"}).withColumns({"gram": F.lit(1), "_hit": F.lit("h"), "term": F.lit("t")})
    out = universe.tag_filter_many(rows, terms(spark, ["gamma"]))
    assert out.columns == rows.columns and [tuple(r) for r in out.collect()] == [("s0", 0, ["Alpha beta", "GAMMA"], 1, "h", "t")]


def test_ledger_counts_the_first_missing_feature(spark):
    ends = month_ends("2000-01-31", 40)
    px = series(spark, [("A", d.isoformat(), 10.0 + k) for k, d in enumerate(ends)] + [("B", d.isoformat(), 5.0) for d in ends[:5]]).withColumnRenamed("key", "ticker")
    exog = series(spark, [("X", d.replace(day=1).isoformat(), 1.0 + k) for k, d in enumerate(ends)]).withColumnRenamed("key", "series_id")
    options = {"exog": exog, "exog_ids": ["X"], "ar_order": 2}
    ledger = Observation("ledger")
    built = forecast.arx_features(px, ledger=ledger, **options)
    n = built.count()
    rows = {r["feature"]: (r["dropped"], r["rows"]) for r in forecast.dropped_rows(spark, ledger).collect()}
    assert list(rows) == ["ret_lag0", "ret_lag1", "exog_X", "target"]
    total = rows["target"][1]
    assert total == 39 + 4 and total - sum(d for d, _ in rows.values()) == n
    # A's first return lacks its lag, then a year and the lag of the indicator; B never gets that far.
    assert rows["ret_lag1"][0] == 2 and rows["target"][0] == 1 and rows["exog_X"][0] == total - n - 3
    assert forecast.arx_features(px, **options).count() == n
    assert day("2000-01-31") == ends[0]


def test_ledger_reads_nothing_twice(spark):
    px = series(spark, [("A", "2000-01-31", 1.0)]).withColumnRenamed("key", "ticker")
    plain, counted = (
        forecast.arx_features(px, ledger=x)._jdf.queryExecution().executedPlan().toString() for x in (None, Observation("o"))
    )
    assert plain.count("Scan") == counted.count("Scan") and plain.count("Exchange") == counted.count("Exchange")
    assert "CollectMetrics" in counted
