"""The driver's star schema read as the model's tables.

Money is summed as whole cents, so totals are exact in any summation order.
Every reader selects its columns straight from Parquet, which lets the scan
prune the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.numeric import ratio
from tidemark.sources.landing import price_pulls

INDEX_PREFIX = "ALL"
BASELINE_PREFIX = "BASE_"


# Declared, so that no job has to open the files to find the schema.
SCHEMAS = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp_ntz"
    ),
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string",
    "events": "ts timestamp_ntz, event_type string, value double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _cents(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("bigint")


def _daily_prices(lines: DataFrame, key: str) -> DataFrame:
    """close / adj_close / shares_out per key and shipping day.

    Grouped on the stored key; it becomes a ticker string once per group.
    """
    sums = lines.groupBy(key, F.to_date("l_shipdate").alias("date")).agg(
        F.sum(_cents("l_extendedprice")).alias("gross"),
        F.sum(_cents("l_extendedprice") * (100 - _cents("l_discount"))).alias("net"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
    )
    return sums.select(
        F.col(key).cast("string").alias("ticker"),
        "date",
        ratio(F.col("gross") / 100.0, F.col("qty").cast("double")).alias("close"),
        ratio(F.col("net") / 10000.0, F.col("qty").cast("double")).alias("adj_close"),
        F.col("qty").cast("double").alias("shares_out"),
    )


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One security per supplier; the sub-sector is the supplier's region."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    key = F.col("s_suppkey")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            key.cast("string").alias("ticker"),
            F.col("s_name").alias("name"),
            F.col("r_name").alias("subsector"),
            F.date_add(F.lit("1995-01-01").cast("date"), (key % 10 * 90).cast("int")).alias("from_date"),
            F.when(key % 7 == 0, F.lit("2000-12-31").cast("date")).alias("to_date"),
            F.lit(None).cast("string").alias("notes"),
        )
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices per supplier."""
    return _daily_prices(table(spark, sf_dir, "lineitem"), "l_suppkey")


def baseline_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices per brand: the benchmark tickers."""
    brand = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem").join(brand, F.col("l_partkey") == F.col("p_partkey"))
    return _daily_prices(lines, "p_brand")


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark catalogue: index id and its one ticker."""
    return (
        table(spark, sf_dir, "part")
        .select("p_brand")
        .distinct()
        .select(
            F.concat(F.lit(BASELINE_PREFIX), F.upper(F.replace("p_brand", F.lit("#"), F.lit("")))).alias(
                "index_id"
            ),
            F.col("p_brand").alias("ticker"),
        )
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value per market segment; each shipping day is a vintage."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.lit("ORD").alias("source"),
            F.col("c_mktsegment").alias("series_id"),
            F.trunc(F.to_date("o_orderdate"), "month").alias("date"),
            F.to_date("l_shipdate").alias("as_of"),
            _cents("l_extendedprice").alias("cents"),
        )
        .filter(F.col("as_of") >= F.col("date"))
        .groupBy("source", "series_id", "date", "as_of")
        .agg((F.sum("cents") / 100.0).alias("value"))
    )


def series_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a config file would declare for the monthly series."""
    return (
        table(spark, sf_dir, "customer")
        .select("c_mktsegment")
        .distinct()
        .select(
            F.lit("ORD").alias("source"),
            F.col("c_mktsegment").alias("series_id"),
            F.lit(None).cast("string").alias("metric_name"),
            F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("Q")).alias("frequency"),
            F.lit("USD").alias("unit"),
            F.when(F.col("c_mktsegment") < "G", F.lit("spending")).otherwise(F.lit("prices")).alias(
                "subsector"
            ),
        )
    )


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily total per event type: (source, series_id, date, value)."""
    return (
        table(spark, sf_dir, "events")
        .select(
            F.lit("EVT").alias("source"),
            F.col("event_type").alias("series_id"),
            F.to_date("ts").alias("date"),
            _cents("value").alias("cents"),
        )
        .groupBy("source", "series_id", "date")
        .agg((F.sum("cents") / 100.0).alias("value"))
    )


def decision_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which someone decides: the 15th of every month with an order, each as often as there are orders."""
    month = F.trunc(F.to_date("o_orderdate"), "month")
    return table(spark, sf_dir, "orders").select(F.date_add(month, 14).alias("known_date"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single events as series rows, dated to the microsecond: (event_type, date, value).

    An even number of cents stands for a value that is missing. Five types hold all
    events, so each is a key whose history grows with the table.
    """
    cents = _cents("value")
    return table(spark, sf_dir, "events").select(
        "event_type", F.col("ts").alias("date"), F.when(cents % 2 == 1, cents / 100.0).alias("value")
    )


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pulls: per event type and week one JSON document of daily totals.

    A document holds at most seven days, since the events are summed to days
    before they are gathered. A day whose total ends in an even cent is sent as
    the "no value" mark.
    """
    total = F.sum(_cents("value"))
    daily = (
        table(spark, sf_dir, "events")
        .select(F.col("event_type").alias("series_id"), F.to_date("ts").alias("date"), "value")
        .groupBy("series_id", "date")
        .agg(total.alias("cents"))
    )
    entry = F.struct(
        F.col("date").cast("string").alias("date"),
        F.when(F.col("cents") % 2 == 0, F.lit("."))
        .otherwise((F.col("cents") / 100.0).cast("decimal(18,2)").cast("string"))
        .alias("value"),
    )
    week = F.trunc("date", "week")
    return (
        daily.withColumn("week", week)
        .groupBy("series_id", "week")
        .agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("observations"))).alias("payload"))
        .select(
            F.lit("EVT").alias("source"),
            "series_id",
            F.date_add("week", 7).cast("timestamp").alias("fetched_at"),
            "payload",
        )
    )


def raw_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unchecked price prints, one per order line, as text with planted defects."""
    close = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("ticker"),
        F.to_date("l_shipdate").alias("date"),
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_tax") == 0.0, F.lit(None))
        .when(F.col("l_tax") == 0.08, F.lit("-1"))
        .otherwise(close.cast("string"))
        .alias("close"),
        F.when(F.col("l_discount") == 0.1, F.lit("n/a"))
        .when(F.col("l_discount") == 0.0, F.lit("NaN"))
        .otherwise((close * (1 - F.col("l_discount"))).cast("string"))
        .alias("adj_close"),
        F.col("l_quantity").alias("shares_out"),
        _cents("l_extendedprice").alias("cents"),
        F.col("l_discount").alias("off"),
    )


def price_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pulls of prices: per ticker and month one document of all its unchecked prints, fetched as the month ends.

    Every tenth supplier also has a pull that is cut off.
    """
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    # Lines that share a number are told apart by what they say.
    seq = F.struct(number, F.col("shares_out"), F.col("cents"), F.col("off"))
    month_end = F.add_months(F.trunc("date", "month"), 1).cast("timestamp")
    prints = raw_prints(spark, sf_dir).withColumn("shares_out", F.col("shares_out").cast("string"))
    pulls = price_pulls(prints, source="PX", seq=seq, fetched_at=month_end)
    key = F.col("s_suppkey")
    cut = table(spark, sf_dir, "supplier").filter(key % 10 == 3).select(
        F.lit("PX").alias("source"), key.cast("string").alias("series_id"),
        F.lit("2002-01-01").cast("timestamp").alias("fetched_at"), F.lit('{"prices": [{"date": "20').alias("payload"),
    )
    return pulls.unionByName(cut)


def broken_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`landing` and for each event type a pull with a bad date, a bad value and a usable row, and one cut off."""
    pulls = landing(spark, sf_dir)
    doc = '{"observations": [{"date": "soon", "value": "1"}, {"date": "2024-02-01", "value": "x"}, {"date": "2030-01-01", "value": "1"}]}'
    types = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id")).distinct()
    odd = types.select(
        F.lit("EVT").alias("source"), "series_id", F.lit("2024-03-01").cast("timestamp").alias("fetched_at"),
        F.explode(F.array(F.lit(doc), F.lit("{"))).alias("payload"),
    )
    return pulls.unionByName(odd)


def share_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share-count history: (ticker, date, seq, shares), a count reported on every order's day.

    Suppliers with a negative balance have none. Several order lines of a day
    report several counts; `seq` says which came last. Orders are placed on other
    days than those they are shipped and priced on.
    """
    supplier = table(spark, sf_dir, "supplier").filter(F.col("s_acctbal") >= 0).select("s_suppkey")
    placed = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return (
        table(spark, sf_dir, "lineitem")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_suppkey").cast("string").alias("ticker"),
            F.to_date("o_orderdate").alias("date"),
            # Lines that share a number are told apart by their quantity.
            ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity")).cast("bigint").alias("seq"),
            (F.col("l_quantity") * 1000).alias("shares"),
        )
    )


def static_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("ticker"),
        (F.col("s_suppkey") * 10.0 + 1000.0).alias("shares"),
    )


def tagged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with an array of tags, one per part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("slug"),
        (F.col("p_partkey") + 1).cast("int").alias("rank"),
        F.col("p_name").alias("name"),
        F.array_append(F.split("p_name", " "), F.col("p_type")).alias("focus"),
    )
