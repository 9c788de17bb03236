"""Lead-lag cross-correlation and its honesty report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.numeric import ratio
from tidemark.operators.skew import spread_join

MIN_PAIRS = 3
SMALL_SAMPLE = 30
MANY_COMBINATIONS = 20

# The report's texts.
WARN_SMALL = "Small effective sample (<30) at one or more lags; correlations unstable."
WARN_MANY = (
    " indicator x lag combinations tested; expect spurious "
    "'significant' hits by chance. Prefer a pre-registered hypothesis."
)
WARN_ALWAYS = "Exploratory only -- not a predictive or trading signal."


def pearson(x: Column, y: Column, n: Column) -> Column:
    """Correlation aggregate; NULL for fewer than three pairs or a constant side.

    Inputs must be NULL together. The built-in corr raises on a constant side
    under ANSI, so the ratio is spelled out.
    """
    r = ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(n >= MIN_PAIRS, r)


def lead_lag(
    indicators: DataFrame,
    targets: DataFrame,
    pairs: DataFrame,
    *,
    max_lag: int = 12,
    value: str = "value",
    hot_indicators: list | None = None,
    hot_targets: list | None = None,
) -> DataFrame:
    """Correlation of indicator(t - lag) with target(t) for every pair and lag.

    `indicators` is (indicator, date, value), `targets` (target, date, value),
    `pairs` (indicator, target). Lags count rows of a pair's merged dates, so
    both sides should share a frequency; a positive lag means the indicator
    leads. Returns (indicator, target, lag, corr, n), also where n is 0.

    Lags are read from one window per pair and unfolded next to it; the sums
    per (pair, lag) form where the window left the rows. No join on shifted row
    numbers, and the data shuffles for the window alone. Series known to take part in
    very many pairs may be named as hot, which deals their pairs out.
    """
    pair = ["indicator", "target"]
    none = F.lit(None).cast("double")
    lhs = spread_join(pairs, indicators, "indicator", by="target", hot=hot_indicators).select(
        *pair, "date", F.col(value).alias("ind"), none.alias("tgt")
    )
    rhs = spread_join(pairs, targets, "target", by="indicator", hot=hot_targets).select(
        *pair, "date", none.alias("ind"), F.col(value).alias("tgt")
    )
    # An undated row per pair keeps pairs without any data in the result.
    seed = pairs.select(*pair, F.lit(None).cast("date").alias("date"), none.alias("ind"), none.alias("tgt"))
    merged = (
        lhs.unionByName(rhs)
        .filter(F.col("ind").isNotNull() | F.col("tgt").isNotNull())
        .unionByName(seed)
        .groupBy(*pair, "date")
        .agg(F.max("ind").alias("ind"), F.max("tgt").alias("tgt"))
    )
    over = "OVER (PARTITION BY indicator, target ORDER BY date)"
    lags = ", ".join(f"lag(ind, {lag}) {over}" for lag in range(-max_lag, max_lag + 1))
    both = F.col("ind").isNotNull() & F.col("tgt").isNotNull()
    seeded = F.col("date").isNull()
    shifted = (
        merged.select(*pair, "date", "tgt", F.expr(f"array({lags})").alias("shifted"))
        .filter(F.col("tgt").isNotNull() | seeded)
        .select(*pair, "date", "tgt", F.posexplode("shifted").alias("slot", "ind"))
        .filter(both | seeded)
    )
    x, y = F.when(both, F.col("ind")), F.when(both, F.col("tgt"))
    n = F.count(x)
    return (
        shifted.groupBy(*pair, "slot")
        .agg(pearson(x, y, n).alias("corr"), n.alias("n"))
        .select(*pair, (F.col("slot") - max_lag).alias("lag"), "corr", "n")
    )


def lead_lag_matrix(result: DataFrame, max_lag: int = 12) -> DataFrame:
    """One row per indicator and target, one column per lag."""
    names = [(lag, f"lag_m{-lag}" if lag < 0 else f"lag_p{lag}") for lag in range(-max_lag, max_lag + 1)]
    cells = [F.max(F.when(F.col("lag") == lag, F.col("corr"))).alias(name) for lag, name in names]
    return result.groupBy("indicator", "target").agg(*cells)


def honesty_report(
    result: DataFrame, *, keys: list[str], n_indicators_tested: int | DataFrame | None = None
) -> DataFrame:
    """How a lead-lag result could mislead: best lag, combinations tested, warnings.

    `n_indicators_tested` is a number, or a one-row frame that counts the
    indicators scanned. By default the distinct indicators of `result` are
    counted, which reads it twice, or 1 where it names none.
    """
    tested = n_indicators_tested
    if tested is None:
        tested = result.select(F.countDistinct("indicator")) if "indicator" in result.columns else 1
    tested = tested.scalar() if isinstance(tested, DataFrame) else F.lit(tested)
    valid = F.col("corr").isNotNull()
    rank = F.when(valid, F.struct(F.abs("corr"), -F.col("lag")))
    best = F.max_by(F.struct("lag", "corr", "n"), rank)
    summary = (
        result.groupBy(*keys)
        .agg(best.alias("best"), F.count(F.lit(1)).alias("n_lags"), F.min("n").alias("min_n"))
        .withColumn("combinations_tested", F.col("n_lags") * F.greatest(F.lit(1), tested))
        .withColumn("small_sample", F.col("min_n") < SMALL_SAMPLE)
    )
    many = F.concat(F.col("combinations_tested").cast("string"), F.lit(WARN_MANY))
    warnings = F.array_compact(
        F.array(
            F.when(F.col("small_sample"), F.lit(WARN_SMALL)),
            F.when(F.col("combinations_tested") > MANY_COMBINATIONS, many),
            F.lit(WARN_ALWAYS),
        )
    )
    return summary.select(
        *keys,
        F.col("best.lag").alias("best_lag"),
        F.col("best.corr").alias("best_corr"),
        F.col("best.n").alias("best_n"),
        "combinations_tested",
        "small_sample",
        warnings.alias("warnings"),
    )
