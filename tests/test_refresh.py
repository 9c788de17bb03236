import datetime as dt

import pandas as pd
import pytest
from helpers import prices, values

from tidemark.operators import readers, writers
from tidemark.plans.refresh import (
    Store, compact_store, refresh, rejected_prices, stored_prices, stored_securities, stored_series_meta,
)
from tidemark.sources import landing
from tidemark.streaming import ingest


def test_refresh_end_to_end(spark, tmp_path):
    # Two quarters of one print a week. TIN doubles in each quarter, OAK falls by a fifth; SEA is the benchmark.
    days = [d.date() for d in pd.date_range("2021-01-04", periods=26, freq="7D")]
    rows = []
    for i, d in enumerate(days):
        tin, oak = 8.0 * 2 ** (i / 12), 40.0 * 0.8 ** (i / 12)
        rows += [("TIN", d, tin, tin, 300.0), ("OAK", d, oak, oak, 60.0), ("SEA", d, 10.0 + i % 4, 10.0 + i % 4, 1.0)]
    bad = [("TIN", dt.date(2021, 2, 3), 0.0, 1.0, 1.0)]
    secs = spark.createDataFrame([("TIN", "metal", None, None), ("OAK", "wood", None, None)], "ticker string, subsector string, from_date date, to_date date")
    ids = spark.createDataFrame([("BASE_SEA", "SEA")], "index_id string, ticker string")
    specs = spark.createDataFrame([("S", "X", "x", "M", "u", "macro")], "source string, series_id string, metric_name string, frequency string, unit string, subsector string")
    raw, store = str(tmp_path / "raw"), Store(str(tmp_path / "store"))
    doc = '{"observations": [{"date": "2020-01-01", "value": "1"}, {"date": "2020-02-01", "value": "oops"}]}'
    pull = spark.createDataFrame([("S", "X", dt.datetime(2020, 3, 1), doc)], "source string, series_id string, fetched_at timestamp, payload string")
    landing.land_raw(pull, raw)

    def run(batch, frame):
        report = refresh(spark, store, landing_path=raw, prices=frame, securities=secs, baselines=ids, specs=specs, batch=batch, prefix="ALL", base_date="2021-01-01")
        assert all(r.error is None for r in report.collect())
        return {r.step: (r.rows, r.errors) for r in report.collect()}

    # Weights: each sub-sector's own name and both in ALL, at two rebalances.
    want = {"observations": (1, 1), "series_meta": (1, 0), "securities": (2, 0), "prices": (78, 1), "index_values": (104, 0), "index_weights": (8, 0)}
    assert run(1, prices(spark, rows + bad)) == want
    # Running it again changes nothing.
    assert run(1, prices(spark, rows + bad)) == want
    assert run(2, None) == want
    values_table = writers.read_index_values(spark, store.path("index_values"))
    assert [r.index_id for r in readers.available_indices(values_table).collect()] == ["ALL", "ALL_METAL", "ALL_WOOD", "BASE_SEA"]
    metal = readers.index_levels(values_table, "ALL_METAL").collect()
    # Flat on the rebalance day of the second quarter, the 14th print: 12 steps before it and 12 after.
    assert len(metal) == 26 and metal[12].level_pr == pytest.approx(200.0) and metal[-1].level_pr == pytest.approx(400.0)
    meta = stored_series_meta(spark, store).collect()
    assert [(r.series_id, str(r.first_obs), str(r.last_obs)) for r in meta] == [("X", "2020-01-01", "2020-01-01")]
    assert stored_securities(spark, store).count() == 2
    assert values(readers.last_obs_date(ingest.stored_observations(spark, store.path("observations"))), "series_id", order="series_id") == [("X",)]
    # A later batch restates a price.
    assert run(3, prices(spark, [("TIN", days[-1], 3.2, 3.2, 300.0)])) == want
    assert stored_prices(spark, store).filter("ticker = 'TIN' and close = 3.2").count() == 1
    again = readers.index_levels(writers.read_index_values(spark, store.path("index_values")), "ALL_METAL").collect()
    assert again[-1].level_pr == pytest.approx(200.0 * 3.2 / (8.0 * 2 ** (13 / 12)))
    # Folded into a new store, everything is there once, and the old stream goes on after it.
    folded = Store(str(tmp_path / "folded"))
    compact_store(spark, store, folded)
    assert stored_prices(spark, folded).count() == 78 and rejected_prices(spark, folded).count() == 1
    more = spark.createDataFrame([("S", "X", dt.datetime(2021, 4, 1), doc.replace("2020-01-01", "2021-01-01"))], pull.schema)
    landing.land_raw(more, str(tmp_path / "more"))
    ingest.incremental_ingest(spark, str(tmp_path / "more"), folded.path("observations"), folded.path("observation_rejects"), str(tmp_path / "other"))
    assert values(ingest.stored_observations(spark, folded.path("observations")), "date") == [(dt.date(2020, 1, 1),), (dt.date(2021, 1, 1),)]


def test_one_failing_step_stops_nothing_else(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    secs = spark.createDataFrame([("TIN", "metal", None, None)], "ticker string, subsector string, from_date date, to_date date")
    ids = spark.createDataFrame([("BASE_SEA", "SEA")], "index_id string, ticker string")
    twice = prices(spark, [("TIN", "2021-01-04", 1.0, 1.0, 1.0), ("TIN", "2021-01-04", 2.0, 2.0, 1.0), ("SEA", "2021-01-04", 1.0, 1.0, 1.0)])

    def run(frame, batch, **more):
        report = refresh(spark, store, landing_path=str(tmp_path / "nowhere"), prices=frame, securities=secs, baselines=ids, batch=batch, prefix="ALL", **more)
        return {r.step: r for r in report.collect()}

    got = run(twice, 1)
    assert got["observations"].errors == 1 and got["observations"].error
    assert "duplicate" in got["prices"].error and got["prices"].rows == 0
    assert got["securities"].rows == 1 and got["securities"].error is None
    text = twice.selectExpr("ticker", "date", "cast(close AS string) close", "cast(adj_close AS string) adj_close", "shares_out", "close seq")
    bad = text.limit(1).selectExpr("ticker", "date", "'n/a' close", "adj_close", "shares_out", "seq")
    got = run(text.unionByName(bad), 2, price_seq="seq")
    assert (got["prices"].rows, got["prices"].errors, got["prices"].error) == (2, 1, None) and got["index_values"].rows == 3
    assert values(stored_prices(spark, store).filter("ticker = 'TIN'"), "close") == [(2.0,)]
    assert [r.close_text for r in rejected_prices(spark, store).collect()] == ["n/a"]
