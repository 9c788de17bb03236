import numpy as np
import pandas as pd
import pytest
from helpers import day, members, prices, shuffled, values

from tidemark.operators import index, universe


def levels_of(frame, index_id="I"):
    rows = frame.filter(frame.index_id == index_id).orderBy("date").collect()
    return [(r.date, r.level_pr, r.level_tr) for r in rows]


# The two-name golden case.
GOLDEN = [
    ("A", "2020-01-01", 10.0, 10.0, 10.0), ("B", "2020-01-01", 20.0, 20.0, 10.0),
    ("A", "2020-01-02", 11.0, 11.0, 10.0), ("B", "2020-01-02", 20.0, 20.0, 10.0),
    ("A", "2020-01-03", 11.0, 11.0, 10.0), ("B", "2020-01-03", 22.0, 22.0, 10.0),
]
AB = [("I", "A", "2020-01-01", None), ("I", "B", None, None)]


def test_two_names(spark):
    levels, weights = index.build_index(prices(spark, GOLDEN), members(spark, AB), base_date="2020-01-01")
    got = levels_of(levels)
    assert [r[1] for r in got] == pytest.approx([100, 310 / 3, 110])
    assert [r[2] for r in got] == pytest.approx([100, 310 / 3, 110])
    assert values(weights, "rebalance_date", "ticker", order="ticker") == [(day("2020-01-01"), "A"), (day("2020-01-01"), "B")]
    assert [w for (w,) in values(weights, "weight", order="ticker")] == pytest.approx([1 / 3, 2 / 3])


def test_base_date_cuts_history(spark):
    levels, _ = index.build_index(prices(spark, GOLDEN), members(spark, AB), base_date="2020-01-02")
    assert levels_of(levels)[0][:2] == (day("2020-01-02"), 100.0)


def test_no_prices_no_rows(spark):
    levels, weights = index.build_index(prices(spark, GOLDEN), members(spark, [("I", "Z", None, None)]))
    assert levels.count() == 0 and weights.count() == 0


def test_level_is_flat_on_the_rebalance_day(spark):
    rows = [("A", d, c, c, 1.0) for d, c in (("2020-03-30", 10.0), ("2020-03-31", 20.0), ("2020-04-01", 40.0), ("2020-04-02", 80.0))]
    levels, _ = index.build_index(prices(spark, rows), members(spark, [("I", "A", None, None)]))
    assert [r[1] for r in levels_of(levels)] == pytest.approx([100, 200, 200, 400])


def test_missing_day_earns_nothing_and_is_made_up(spark):
    rows = [("A", "2020-01-01", 10.0, 10.0, 1.0), ("B", "2020-01-01", 10.0, 10.0, 1.0),
            ("B", "2020-01-02", 20.0, 20.0, 1.0),
            ("A", "2020-01-03", 30.0, 30.0, 1.0), ("B", "2020-01-03", 20.0, 20.0, 1.0)]
    levels, _ = index.build_index(prices(spark, rows), members(spark, [("I", "A", None, None), ("I", "B", None, None)]))
    assert [r[1] for r in levels_of(levels)] == pytest.approx([100, 150, 250])


def test_name_missing_on_the_rebalance_day_sits_out(spark):
    rows = [("A", "2020-01-01", 10.0, 10.0, 1.0), ("B", "2020-01-02", 10.0, 10.0, 1.0), ("A", "2020-01-02", 10.0, 10.0, 1.0),
            ("B", "2020-01-03", 99.0, 99.0, 1.0), ("A", "2020-01-03", 11.0, 11.0, 1.0),
            ("A", "2020-04-01", 11.0, 11.0, 1.0), ("B", "2020-04-01", 11.0, 11.0, 1.0)]
    levels, weights = index.build_index(prices(spark, rows), members(spark, [("I", "A", None, None), ("I", "B", None, None)]))
    assert [r[1] for r in levels_of(levels)] == pytest.approx([100, 100, 110, 110])
    assert values(weights, "rebalance_date", "ticker", order=["rebalance_date", "ticker"]) == [
        (day("2020-01-01"), "A"), (day("2020-04-01"), "A"), (day("2020-04-01"), "B"),
    ]


def test_nobody_eligible_keeps_the_level(spark):
    mem = members(spark, [("I", "A", "2020-04-01", None), ("I", "B", "2020-04-01", None)])
    rows = [*GOLDEN, ("A", "2020-04-01", 5.0, 5.0, 1.0), ("A", "2020-04-02", 6.0, 6.0, 1.0)]
    levels, _ = index.build_index(prices(spark, rows), mem)
    assert [r[1] for r in levels_of(levels)] == pytest.approx([100, 100, 100, 100, 120])


def simulate(px, mem, code, base=100.0):
    """Hold units of each name from rebalance to rebalance, marked at the last known price."""
    px = px[px.ticker.isin(mem.ticker)]
    out = []
    for track in ("close", "adj_close"):
        last, units, worth, value, period, levels = {}, {}, None, base, None, {}
        for date, rows in px.sort_values("date").groupby("date"):
            for r in rows.itertuples():
                if getattr(r, track) is not None and not np.isnan(getattr(r, track)):
                    last[r.ticker] = getattr(r, track)
            current = pd.Timestamp(date).to_period({"A": "Y"}.get(code, code))
            if current != period:
                period = current
                caps = {}
                for r in rows.itertuples():
                    m = mem[mem.ticker == r.ticker].iloc[0]
                    inside = (m.from_date is None or m.from_date <= date) and (m.to_date is None or date <= m.to_date)
                    if inside and r.close * r.shares_out > 0:
                        caps[r.ticker] = r.close * r.shares_out
                total = sum(caps.values())
                units = {t: value * c / total / last[t] for t, c in caps.items()}
            elif units:
                value = sum(u * last[t] for t, u in units.items())
            levels[date] = value
        out.append(levels)
    return out


@pytest.mark.parametrize("code", ["Q", "M", "A"])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_holdings_simulation(spark, seed, code):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2019-11-04", periods=180)
    rows = []
    for t in range(7):
        path = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, len(days))))
        for d, c in zip(days, path):
            if rng.random() > 0.25:
                rows.append((f"T{t}", d.date(), float(c), float(c * 0.9 + t), float(rng.integers(0, 5))))
    mem = [("I", f"T{t}", ["", "2020-01-15"][t % 2] or None, ["", "2020-04-01"][t % 3 == 0] or None) for t in range(7)]
    mem += [("J", f"T{t}", None, None) for t in range(3)]
    mdf = members(spark, mem)
    levels, _ = index.build_index(shuffled(prices(spark, rows)), mdf, rebalance=code)
    for name in ("I", "J"):
        own = pd.DataFrame(
            [(m.ticker, m.from_date, m.to_date) for m in mdf.collect() if m.index_id == name],
            columns=["ticker", "from_date", "to_date"],
        )
        want_pr, want_tr = simulate(pd.DataFrame(rows, columns=["ticker", "date", "close", "adj_close", "shares_out"]), own, code)
        got = levels_of(levels, name)
        assert [g[0] for g in got] == sorted(want_pr)
        assert np.allclose([g[1] for g in got], [want_pr[g[0]] for g in got], rtol=1e-10)
        assert np.allclose([g[2] for g in got], [want_tr[g[0]] for g in got], rtol=1e-10)


def test_chain_factors_multiply_to_the_level(spark):
    chain = index.index_levels_chain(prices(spark, GOLDEN), members(spark, AB)).orderBy("date").collect()
    assert np.prod([r.factor_pr for r in chain]) * 100 == pytest.approx(chain[-1].level_pr)


def test_baseline(spark):
    rows = [("SEA", "2001-05-03", 8.0, 4.0, None), ("SEA", "2001-05-09", 10.0, 7.0, None), ("SKY", "2001-05-09", 3.0, 3.0, None),
            ("SEA", "2001-05-02", 0.0, 4.0, None), ("SEA", "2001-05-01", None, 4.0, None), ("SEA", "2001-05-04", 9.0, None, None)]
    ids = spark.createDataFrame([("BASE_SEA", "SEA"), ("BASE_NONE", "NONE")], "index_id string, ticker string")
    out = index.baseline_index(prices(spark, rows), ids)
    assert values(out, "index_id", "date", "level_pr", "level_tr") == [
        ("BASE_SEA", day("2001-05-03"), 100.0, 100.0), ("BASE_SEA", day("2001-05-09"), 125.0, 175.0),
    ]


def test_build_all(spark):
    # TIN pays no dividend and gains a half; OAK stays and pays, so only its total return rises, by a tenth.
    days = [day(f"2010-03-{d:02d}") for d in (1, 4, 9, 15, 22)]
    rows = []
    for i, d in enumerate(days):
        rows += [("TIN", d, 16.0 + 2 * i, 16.0 + 2 * i, 50.0), ("OAK", d, 40.0, 40.0 + i, 20.0), ("SEA", d, 5.0 + i, 5.0, 1.0)]
    secs = spark.createDataFrame(
        [("TIN", "metal", None, None), ("OAK", "wood", None, None)], "ticker string, subsector string, from_date date, to_date date"
    )
    px = prices(spark, rows)
    ids = spark.createDataFrame([("BASE_SEA", "SEA")], "index_id string, ticker string")
    levels, weights = index.build_all_indices(px, universe.index_members(secs, "ALL"), px, ids, base_date="2010-03-01")
    counts = {r.index_id: r["count"] for r in levels.groupBy("index_id").count().collect()}
    assert counts == {"BASE_SEA": 5, "ALL": 5, "ALL_METAL": 5, "ALL_WOOD": 5}
    last = {r.index_id: (r.level_pr, r.level_tr) for r in levels.filter(f"date = '{days[-1]}'").collect()}
    # ALL holds 800 of each: price (150 + 100) / 2, total return (150 + 110) / 2.
    want = {"BASE_SEA": (180, 100), "ALL_METAL": (150, 150), "ALL_WOOD": (100, 110), "ALL": (125, 130)}
    assert {k: pytest.approx(v) for k, v in want.items()} == last
    assert sorted(r.weight for r in weights.filter("index_id = 'ALL'").collect()) == [0.5, 0.5]
    more = ids.unionByName(spark.createDataFrame([("BASE_NONE", "NONE")], "index_id string, ticker string"))
    priced = index.priced_indices(px, universe.index_members(secs, "ALL"), more, base_date="2010-03-01")
    assert sorted(r.index_id for r in priced.collect()) == sorted(counts)


def test_rebalance_codes(spark):
    rows = [("A", d, 1.0, 1.0, 1.0) for d in ("2020-01-07", "2020-02-03", "2020-04-02", "2021-01-04")]
    px, mem = prices(spark, rows), members(spark, [("I", "A", None, None)])
    for code, n in (("M", 4), ("Q", 3), ("A", 2), ("X", 3)):
        assert index.rebalance_dates(px, mem, rebalance=code).count() == n
