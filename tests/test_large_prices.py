"""Prices in quantity: worked out once, moved before they fill a task, chosen by hash."""

import datetime as dt

from helpers import day, prices, values
from pyspark.sql import functions as F
from test_price_landing import frame, pull

from tidemark.functions.numeric import to_number
from tidemark.operators import quality, writers
from tidemark.plans import history_queries, index_store
from tidemark.plans.refresh import Store, refresh, stored_prices
from tidemark.schemas import PRICE_KEY, PRICES
from tidemark.sources import driver_tables, landing
from tidemark.streaming import ingest

SF = "/root/testdata/sf0.001"


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def counted(spark, rows):
    """The same rows, and how often one of them has been worked out."""
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(tell, rows.schema), seen


def px(spark, n=6):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=25 * k) for k in range(n)]
    return prices(spark, [(t, d, 1.0 + k, 1.0 + k, 5.0) for t in "ABC" for k, d in enumerate(days)])


def test_prices_are_worked_out_once_for_check_and_write(spark, tmp_path):
    rows, seen = counted(spark, px(spark))
    secs = spark.createDataFrame([(t, "metal", None, None) for t in "ABC"], "ticker string, subsector string, from_date date, to_date date")
    none = spark.createDataFrame([], "index_id string, ticker string")
    store = Store(str(tmp_path))
    report = refresh(spark, store, landing_path=None, prices=rows, securities=secs, baselines=none, batch=0, prefix="ALL")
    assert {r.step: (r.rows, r.error) for r in report.collect()}["prices"] == (18, None)
    assert seen.value == 18


def test_a_batch_with_a_double_key_leaves_the_old_one(spark, tmp_path):
    tagged = quality.price_status(quality.tag_prices(px(spark, 2)))
    writers.write_prints(tagged, str(tmp_path / "prices"), 0)
    try:
        writers.write_prints(tagged.unionByName(tagged), str(tmp_path / "prices"), 0)
        raise AssertionError("no error")
    except ValueError:
        pass
    assert stored_prices(spark, Store(str(tmp_path))).count() == 6


def test_incremental_indices_replay_once(spark, monkeypatch):
    told, replay = [], landing.replay_prices

    def counting(pulls):
        rows, seen = counted(spark, replay(pulls))
        told.append(seen)
        return rows

    want = replay(driver_tables.price_landing(spark, SF)).count()
    monkeypatch.setattr(landing, "replay_prices", counting)
    assert not history_queries.incremental_indices(spark, SF).isEmpty()
    assert [seen.value for seen in told] == [want]


def test_stored_prices_are_settled_once_an_update(spark, tmp_path, monkeypatch):
    store = Store(str(tmp_path))
    writers.write_prints(quality.price_status(quality.tag_prices(px(spark))), store.path("prices"), 0)
    told, settle = [], writers.last_prints

    def counting(rows, **more):
        out, seen = counted(spark, settle(rows, **more))
        told.append(seen)
        return out

    monkeypatch.setattr(index_store, "last_prints", counting)
    members = spark.createDataFrame([("ALL", t, None, None) for t in "ABC"], "index_id string, ticker string, from_date date, to_date date")
    index_store.update_indices(spark, store, members, spark.createDataFrame([], "index_id string, ticker string"))
    assert [seen.value for seen in told] == [18]


def test_stores_move_rows_before_they_choose(spark, tmp_path):
    """No aggregate below the shuffle: there it would hold all keys of a task's files."""
    path = str(tmp_path / "prices")
    writers.write_batch(px(spark), path, 0)
    writers.write_batch(px(spark).withColumn("close", F.lit(9.0)), path, 1)
    for rows in (
        writers.read_store(spark, path, PRICES, PRICE_KEY),
        writers.last_prints(writers.read_batches(spark, path, PRICES).withColumn("fetched_at", F.lit(None).cast("timestamp"))),
    ):
        above, below = plan(rows).split("Exchange")
        assert "HashAggregate" in above and "Aggregate" not in below
        assert values(rows.select("close").distinct(), "close", order="close") == [(9.0,)] and rows.count() == 18


def test_documents_are_gathered_after_the_shuffle(spark):
    rows = px(spark).withColumn("fetched_at", F.date_trunc("year", "date"))
    pulls = landing.price_pulls(rows.withColumn("n", F.datediff(F.lit("2021-01-01"), "date")), source="PX", seq=F.col("n"))
    above, below = plan(pulls).split("Exchange")
    assert "Aggregate" not in below and "lambdafunction" not in above
    back = landing.parse_prices(pulls.filter("series_id = 'A'")).orderBy("pos").collect()
    assert [r["date"] for r in back] == sorted((r["date"] for r in back), reverse=True) and len(back) == 6


def test_landed_prices_are_chosen_by_hash(spark, tmp_path, monkeypatch):
    entries = [("2021-01-04", 1, 1, 1), ("2021-01-04", 2, "x", 2), ("2021-01-04", 3, 3, None), ("soon", 1, 1, 1)]
    pulls = [pull("A", "2021-01-05", *entries), pull("A", "2021-01-04", ("2021-01-04", 8, 8, 8)), pull("B", "2021-01-05", payload="{")]
    pulls += [("PX", "C", when, pull("C", "2021-01-05", ("2021-01-04", k, k, k))[3]) for k, when in ((5, dt.datetime(1960, 1, 1)), (4, None))]
    assert "SortAggregate" not in plan(landing.replay_prices(frame(spark, pulls)))
    raw, store, settled = str(tmp_path / "raw"), Store(str(tmp_path / "store")), []
    write = writers.write_batch
    monkeypatch.setattr(writers, "write_batch", lambda rows, *a, **k: (settled.append(plan(rows)), write(rows, *a, **k)))
    frame(spark, pulls).write.parquet(raw)
    ingest.incremental_prices(spark, raw, store.path("landed_prices"), store.path("_price_progress"))
    assert settled and "SortAggregate" not in settled[0] and "InMemory" not in settled[0]
    want = [("A", day("2021-01-04"), 3.0, None), ("C", day("2021-01-04"), 5.0, 5.0)]
    assert values(stored_prices(spark, store), "ticker", "date", "close", "shares_out", order="ticker") == want
    rejected = writers.read_batches(spark, store.path("landed_prices"), writers.PRICE_PRINTS).filter("status = 'rejected'")
    got = values(rejected, "ticker", "date_text", "close_text", "adj_close_text", "reason", order=["ticker", "date_text"])
    assert got == [
        ("A", "2021-01-04", "2", "x", quality.BAD_ADJ_CLOSE), ("A", "soon", "1", "1", "bad date"),
        ("B", None, None, None, "unreadable payload"),
    ]


def test_numbers_are_read_once(spark):
    rows = spark.createDataFrame([("1.5",), ("NaN",), ("x",), ("-1",), (None,), ("Infinity",)], "t string")
    read = rows.select(to_number(F.col("t")).alias("v"), quality.usable_price(F.col("t")).alias("ok"))
    assert plan(rows.select(to_number(F.col("t")))).count("cast(t") == 1
    assert [tuple(r) for r in read.collect()] == [(1.5, True), (None, False), (None, False), (-1.0, False), (None, False), (float("inf"), True)]
