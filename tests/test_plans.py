"""Plan shapes the operators promise, and registered queries against their SQL."""

import sys
from pathlib import Path
from types import SimpleNamespace

import pytest
from helpers import members, prices, series

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402
from tidemark import session  # noqa: E402
from tidemark.operators import align, index, leadlag, readers, signals, skew  # noqa: E402
from tidemark.plans import forecast_queries, history_queries, index_queries, series_queries, store_queries  # noqa: E402
from tidemark.schemas import OBSERVATIONS  # noqa: E402

SF = "/root/testdata/sf0.001"
WRITES = {
    "incremental_ingest", "refresh", "refreshed_levels", "refreshed_weights", "refreshed_catalogue", "refreshed_health",
    "land_raw", "replay_landing", "stored_prices", "stored_current_series", "replace_index", "dropped_rows",
    "landed_prices", "replay_prices", "rebuilt_prices", "landed_price_errors", "ingest_stats", "incremental_indices",
}


@pytest.fixture(autouse=True)
def long_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")


# The corpus subpackage has its own tests and may be left out.
CORE = {
    name: query
    for module in (store_queries, series_queries, index_queries, forecast_queries, history_queries)
    for name, query in module.QUERIES.items()
}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_cross_joins_and_no_row_python(spark):
    for name, (run, _) in CORE.items():
        if name not in WRITES:
            text = plan(run(spark, SF))
            for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "RDDScan"):
                assert bad not in text, (name, bad)


def test_every_query_is_named_once_and_checked():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CORE) <= set(entry.oracle_sql())


def test_point_in_time_filter_reaches_the_files(spark, tmp_path):
    path = str(tmp_path / "obs")
    spark.createDataFrame([], OBSERVATIONS).write.parquet(path)
    text = plan(readers.series_as_known_on(spark.read.schema(OBSERVATIONS).parquet(path), "2020-01-01", "S", "X"))
    assert "LessThanOrEqual(as_of,2020-01-01)" in text and "EqualTo(series_id,X)" in text
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_unused_columns_are_not_read(spark):
    text = plan(entry.queries()["price_coverage"](spark, SF))
    assert "ReadSchema: struct<l_suppkey:bigint,l_shipdate:timestamp_ntz>" in text


def test_index_moves_prices_once(spark):
    px = prices(spark, [("A", "2020-01-01", 1.0, 1.0, 1.0)])
    text = plan(index.index_levels_chain(px, members(spark, [("I", "A", None, None)])))
    assert text.count("Exchange hashpartitioning(ticker") == 2  # prices and members
    assert text.count("SortMergeJoin") == 1


def test_lead_lag_unfolds_without_another_shuffle(spark):
    s = series(spark, [("a", "2020-01-01", 1.0)])
    pairs = spark.createDataFrame([("a", "a")], "indicator string, target string")
    text = plan(leadlag.lead_lag(s.withColumnRenamed("key", "indicator"), s.withColumnRenamed("key", "target"), pairs))
    assert "hashpartitioning(indicator#" in text
    assert not any("hashpartitioning" in line and "slot" in line for line in text.splitlines())


def test_asof_needs_no_join_for_unique_rows(spark):
    s = series(spark, [("a", "2020-01-01", 1.0)])
    right = s.withColumnRenamed("value", "other")
    text = plan(align.asof_align(s, right, keys=["key"], columns=["other"], left_is_unique=True))
    assert "Join" not in text and text.count("Exchange") == 1


def fake_session(**settings):
    get = lambda key, default=None: settings.get(key.replace(".", "_"), default)
    return SimpleNamespace(conf=SimpleNamespace(get=get))


def test_scratch_folder_is_the_clusters():
    shared = fake_session(spark_checkpoint_dir="/shared/scratch/")
    assert session.new_workspace(shared, "x").startswith("/shared/scratch/tidemark/x-")
    assert session.new_workspace(shared, "x") != session.new_workspace(shared, "x")
    unset = fake_session(spark_sql_warehouse_dir="hdfs://store/warehouse/")
    assert session.scratch_root(unset) == "hdfs://store/warehouse/_scratch"
    local, cluster = (fake_session(spark_sql_warehouse_dir="file:/home/me/warehouse") for _ in range(2))
    local.sparkContext, cluster.sparkContext = SimpleNamespace(master="local[4]"), SimpleNamespace(master="spark://host:7077")
    assert session.scratch_root(local) == "file:/home/me/warehouse/_scratch"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(cluster)


def test_only_hot_keys_are_repeated(spark):
    rows = [("hot", str(k)) for k in range(300)] + [(f"k{k}", "x") for k in range(100)]
    big = spark.createDataFrame(rows, "key string, part string")
    small = spark.createDataFrame([(k, 1.0) for k in ("hot", "k1", "k2", "other")], "key string, v double")
    assert skew.hot_keys(big, "key") == []  # too few rows to matter
    assert skew.hot_keys(big, "key", least=0) == ["hot"]
    assert "Generate" not in plan(skew.spread_join(big, small, "key", by="part"))
    spread = skew.spread_join(big, small, "key", by="part", hot=["hot"])
    assert "Generate" in plan(spread)
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, big.join(small, "key").collect()))


def test_series_of_the_catalogue_are_not_a_fixed_list(spark, tmp_path):
    """A sixth segment, added to the tables, takes part everywhere."""
    con = check.connect(SF)
    for name in ("lineitem", "orders", "part", "supplier", "nation", "region"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    con.execute(
        f"""COPY (SELECT * REPLACE (CASE WHEN c_custkey % 5 = 0 THEN 'ZOOLOGY' ELSE c_mktsegment END AS c_mktsegment)
                  FROM customer) TO '{tmp_path}/customer.parquet'"""
    )
    for name in ("exog_features", "asof_indicator", "asof_known", "arx_features"):
        got = CORE[name][0](spark, str(tmp_path)).toPandas()
        assert "ZOOLOGY" in got.get("series_id", got.get("feature")).str.replace("exog_", "").unique()
        assert check.difference(got, check.connect(str(tmp_path)).execute(CORE[name][1]).df()) is None


def test_knowledge_date_prefers_the_newest_period(spark):
    from helpers import day

    vintages = [("k", "2020-02-01", "2020-03-01", 2.0), ("k", "2020-03-01", "2020-04-01", 3.0), ("k", "2020-02-01", "2020-04-05", 2.5)]
    vintages += [("k", "2020-03-01", "2020-04-20", None)]
    right = spark.createDataFrame([(k, day(d), day(a), v) for k, d, a, v in vintages], "key string, date date, as_of date, value double")
    dates = ["2020-01-01", "2020-03-15", "2020-04-10", "2020-04-10", "2020-04-20"]
    left = spark.createDataFrame([("k", day(d)) for d in dates], "key string, date date")
    got = align.asof_known(left, right, keys=["key"]).orderBy("date").collect()
    assert [(r.period and str(r.period), r.value) for r in got] == [
        (None, None), ("2020-02-01", 2.0), ("2020-03-01", 3.0), ("2020-03-01", 3.0), ("2020-03-01", None)
    ]


def test_rolling_windows_are_running_sums(spark):
    s = series(spark, [("a", "2020-01-01", 1.0)])
    text = plan(signals.zscore(s, 252, keys=["key"]))
    assert "-251" not in text and text.count("Exchange") == 1


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["index_id", "date", "level_pr", "level_tr"] and not rows.isEmpty()


SAMPLE = [
    "current_series", "series_as_known_on", "replay_landing", "upsert_prices", "sanitize_prices", "align_shares", "asof_align",
    "diffusion", "build_index", "target_weights", "lead_lag", "movers_topk", "walk_forward_ar1",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_registered_query_equals_its_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = check.connect(SF).execute(entry.oracle_sql()[name]).df()
    assert len(got) > 0 and check.difference(got, want) is None
