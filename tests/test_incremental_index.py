"""Stored indices after new, late, restated and rewritten prices equal a full build; only touched periods are read."""

import datetime as dt
import random

import pytest
from helpers import day, members, prices
from pyspark.sql import functions as F

from tidemark.operators import index, quality, writers
from tidemark.plans import index_store
from tidemark.plans.store import Store, stored_prices


def price_rows(rng, tickers, start, days, gaps=0.0):
    out = []
    for t in tickers:
        level = 50.0
        for k in range(days):
            if rng.random() < 0.4:
                continue
            level *= 1 + rng.uniform(-0.1, 0.1)
            close = None if rng.random() < gaps else level
            out.append((t, (dt.date.fromisoformat(start) + dt.timedelta(k)).isoformat(), close, close and close * 0.9, 100.0 + k))
    return out


def put(spark, store, rows, batch):
    """Rows as a clean batch, without a check of the prices: the store's own form of a missing price is left in."""
    tagged = prices(spark, rows).withColumns({"reason": F.lit(None).cast("string"), "status": F.lit(quality.CLEAN)})
    writers.write_prints(tagged.withColumn("fetched_at", F.lit(None).cast("timestamp")), store.path("prices"), batch)


MEMBERS = [("ALL", t, "2020-01-01" if t != "C" else "2020-05-01", None) for t in "ABCDE"] + [("ALL_X", t, None, None) for t in "AB"]


def table_of(frame):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.collect()), key=repr)


def check(spark, store, mem, base, **options):
    """The store's levels and weights equal those built from all its prices."""
    px = stored_prices(spark, store)
    levels, weights = index.build_all_indices(px, mem, px, base, **options)
    assert table_of(writers.read_index_values(spark, store.path("index_values")).select(levels.columns)) == table_of(levels)
    got = writers.read_index_weights(spark, store.path("index_weights")).select(weights.columns)
    assert table_of(got) == table_of(weights)


@pytest.mark.parametrize("mode,gaps", [("flat", 0.3), ("carry", 0.0)])
def test_updates_equal_a_full_build(spark, tmp_path, mode, gaps):
    rng = random.Random(len(mode) + int(gaps * 10))
    store = Store(str(tmp_path / "store"))
    mem = members(spark, MEMBERS)
    base = spark.createDataFrame([("BASE_E", "E")], "index_id string, ticker string")
    options = {"base_date": "2020-02-01", "rebalance_day": mode}

    def update(batch=None, rewritten=None, **more):
        return index_store.update_indices(spark, store, mem, base, batch=batch, rewritten=rewritten, **{**options, **more})

    put(spark, store, price_rows(rng, "ABCDE", "2020-01-05", 420, gaps), 0)
    assert update() is None
    check(spark, store, mem, base, **options)
    assert update() == []
    # A new quarter, then a late restatement of an old one.
    put(spark, store, price_rows(rng, "ABCDE", "2021-03-01", 60, gaps), 1)
    built = update()
    assert day("2021-01-01") in built and day("2021-04-01") in built and day("2020-04-01") not in built
    check(spark, store, mem, base, **options)
    put(spark, store, price_rows(rng, "AC", "2020-08-01", 20), 2)
    built = update()
    assert day("2020-07-01") in built and day("2020-04-01") not in built
    if not gaps:
        assert built == [day("2020-07-01")] + ([day("2020-10-01")] if mode == "carry" else [])
    check(spark, store, mem, base, **options)
    # The same batch again, with other rows: what it held is undone.
    old = index_store.periods_of_batch(spark, store, 2, rebalance="Q", rebalance_day=mode)
    put(spark, store, price_rows(rng, "B", "2020-11-01", 20), 2)
    built = update(batch=2, rewritten=old)
    assert {day("2020-07-01"), day("2020-10-01")} <= set(built)
    check(spark, store, mem, base, **options)


def test_other_settings_build_all(spark, tmp_path):
    rng = random.Random(3)
    store = Store(str(tmp_path / "store"))
    mem, none = members(spark, MEMBERS), spark.createDataFrame([], "index_id string, ticker string")
    put(spark, store, price_rows(rng, "ABCDE", "2020-01-05", 200), 0)
    update = index_store.update_indices
    assert update(spark, store, mem, none) is None
    assert update(spark, store, mem, none) == []
    # Another base value chains the stored days anew and builds none.
    assert update(spark, store, mem, none, base_value=50.0) == []
    check(spark, store, mem, none, base_value=50.0)
    assert update(spark, store, mem, none, base_value=50.0, rebalance="M") is None
    check(spark, store, mem, none, base_value=50.0, rebalance="M")
    fewer = mem.filter("ticker != 'A'")
    assert update(spark, store, fewer, none, rebalance="M") is None
    check(spark, store, fewer, none, rebalance="M")
    # A batch written again without the only prices of a period: its days go.
    put(spark, store, [("A", "2021-06-01", 1.0, 1.0, 1.0), ("B", "2021-06-01", 1.0, 1.0, 1.0)], 1)
    assert update(spark, store, mem, none) is None  # members changed back
    old = index_store.periods_of_batch(spark, store, 1, rebalance="Q", rebalance_day="flat")
    put(spark, store, [("A", "2020-03-01", 9.0, 9.0, 1.0)], 1)
    assert update(spark, store, mem, none, batch=1, rewritten=old) is None
    check(spark, store, mem, none)


def test_only_touched_periods_are_read(spark, tmp_path):
    """The scan of prices gets the touched periods as ranges of dates, next to each other joined."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    store = Store(str(tmp_path / "store"))
    put(spark, store, price_rows(random.Random(1), "AB", "2020-01-05", 300), 0)
    periods = [day("2020-04-01"), day("2020-07-01"), day("2021-01-01")]
    rows = stored_prices(spark, store).filter(index_store.within(periods, F.col("date"), "Q"))
    text = rows._jdf.queryExecution().executedPlan().toString()
    pushed = text[text.index("PushedFilters") :].split("\n")[0]
    for bound in ("GreaterThanOrEqual(date,2020-04-01)", "LessThan(date,2020-10-01)", "GreaterThanOrEqual(date,2021-01-01)", "LessThan(date,2021-04-01)"):
        assert bound in pushed
    assert "2020-07-01" not in pushed
    assert index_store.within([day("2020-12-01")], F.col("date"), "M") is not None


def held_shares(px, mem, base=100.0):
    """Hold each quarter's shares, sell and buy anew at the first day's closing prices: the level day by day."""
    level, out, held, last = None, {}, {}, {}
    quarter = None
    for d in sorted({r[1] for r in px}):
        today = {t: (c, s) for t, x, c, _, s in px if x == d}
        last.update({t: c for t, (c, _) in today.items()})
        if level is not None and held:
            level = sum(n * last[t] for t, n in held.items())
        elif level is None:
            level = base
        if (d.year, (d.month - 1) // 3) != quarter:
            quarter = (d.year, (d.month - 1) // 3)
            caps = {t: c * s for t, (c, s) in today.items() if mem[t] <= d}
            total = sum(caps.values())
            held = {t: level * cap / total / today[t][0] for t, cap in caps.items()} if total else {}
        out[d] = level
    return out


def test_carry_equals_holding_shares(spark):
    rng = random.Random(9)
    rows = [(t, day(d), c, a, s) for t, d, c, a, s in price_rows(rng, "ABCDE", "2020-01-05", 400)]
    mem = {t: day("2020-01-01") for t in "ABCDE"} | {"C": day("2020-05-01")}
    frame = members(spark, [("I", t, d.isoformat(), None) for t, d in mem.items()])
    levels, _ = index.build_index(prices(spark, rows), frame, rebalance_day="carry")
    got = {r["date"]: r["level_pr"] for r in levels.collect()}
    want = held_shares(rows, mem)
    assert set(got) == set(want)
    for d, v in want.items():
        assert got[d] == pytest.approx(v, rel=1e-9), d
    flat, _ = index.build_index(prices(spark, rows), frame)
    assert any(abs(r["level_pr"] - got[r["date"]]) > 1e-6 for r in flat.collect())


def test_carry_factors_multiply_to_the_levels(spark):
    rows = price_rows(random.Random(2), "AB", "2020-01-05", 250, 0.2)
    chain = index.index_levels_chain(prices(spark, rows), members(spark, [("I", "A", None, None), ("I", "B", None, None)]), rebalance_day="carry")
    level = 100.0
    for r in chain.orderBy("date").collect():
        level *= r["factor_pr"] or 1.0
        assert r["level_pr"] == pytest.approx(level, rel=1e-9)
    with pytest.raises(ValueError):
        index.index_levels_chain(prices(spark, rows), members(spark, []), rebalance_day="other")
