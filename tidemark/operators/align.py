"""Alignment in time: as-of joins, date joins and the month grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.scan import running


def _last_row_per_date(right: DataFrame, keys: list[str], columns: list[str], tie: str | None, out: str):
    row = F.struct(*columns)
    if tie is None:
        return right.select(*keys, "date", row.alias(out))
    return right.groupBy(*keys, "date").agg(F.max_by(row, tie).alias(out))


def asof_align_all(
    left: DataFrame,
    rights: list[tuple[DataFrame, list[str], str | None]],
    *,
    keys: list[str],
    left_is_unique: bool = False,
    part: Column | None = None,
) -> DataFrame:
    """As-of join several right sides at once; each is (frame, columns, tie).

    For every left row and right side: the last right row of the same keys dated
    on or before it. NULL values on the right are carried, not skipped. Of
    several right rows on a date the one with the greatest `tie` counts; without
    `tie` the right side must hold one row per keys and date.

    The match depends on keys and date only, so it is worked out once per
    distinct (keys, date). A window partition is then bounded by the days on
    the calendar, however many left rows share a key, and the result returns to
    the left by an equi-join that AQE can split. With `left_is_unique` the left
    rows are those distinct rows already, or few share a date: they go through the
    window themselves, which moves them once instead of three times.

    `part` spreads a key with a very long history: a column that never falls as
    `date` grows, such as its year, by which the history is cut (`operators.scan`).
    Left rows then go through the windows of their own part. Rows without a key or
    a date match nothing.
    """
    left_is_unique = left_is_unique or part is not None
    carried = [f"_row{i}" for i in range(len(rights))]
    rest = [c for c in left.columns if c not in (*keys, "date")] if left_is_unique else []
    probes = left.select(*keys, "date", *rest) if left_is_unique else left.select(*keys, "date").distinct()
    events = probes.withColumn("_probe", F.lit(True))
    for name, (right, columns, tie) in zip(carried, rights):
        rows = _last_row_per_date(right.dropna(subset=[*keys, "date"]), keys, columns, tie, name)
        events = events.unionByName(rows.withColumn("_probe", F.lit(False)), allowMissingColumns=True)
    if part is not None:
        found = running(
            events.withColumnsRenamed({name: f"{name}_of" for name in carried}), keys, ["date", "_probe"],
            part=part, last={name: F.col(f"{name}_of") for name in carried},
        )
    else:
        upto = (
            Window.partitionBy(*(keys or [F.lit(0)]))
            .orderBy("date", "_probe")
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        found = events.withColumns({name: F.last(name, ignorenulls=True).over(upto) for name in carried})
    matched = (
        found.filter("_probe")
        .select(
            *keys,
            "date",
            *rest,
            *[F.col(f"{name}.{c}").alias(c) for name, (_, columns, _) in zip(carried, rights) for c in columns],
        )
    )
    return matched if left_is_unique else left.join(matched, [*keys, "date"], "left")


def asof_align(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: list[str],
    columns: list[str],
    right_date: str = "date",
    tie: str | None = None,
    left_is_unique: bool = False,
    part: Column | None = None,
) -> DataFrame:
    """As-of join of one right side; see `asof_align_all`.

    `right_date` may name another date of the right side. To keep out values that
    were published later, use `asof_known`: it matches the publication day and
    still finds the newest period.
    """
    if right_date != "date":
        right = right.drop("date").withColumnRenamed(right_date, "date")
    return asof_align_all(left, [(right, columns, tie)], keys=keys, left_is_unique=left_is_unique, part=part)


def asof_known(
    left: DataFrame,
    vintages: DataFrame,
    *,
    keys: list[str],
    value: str = "value",
    known: str = "as_of",
    period: str = "period",
) -> DataFrame:
    """Left rows with the newest period known on their date, in its newest vintage known then.

    `vintages` is (keys, date, `known`, value), each vintage once. A revision of an
    older period never hides a newer period; a NULL in the newest vintage is
    carried. Adds `period` and `value`, NULL where nothing was known yet. One
    running maximum over (period, vintage) per key, on distinct left dates.
    """
    seen = vintages.select(*keys, F.col(known).alias("_day"), F.struct("date", known, value).alias("_seen"))
    # One row per key and publication day before anything is ordered.
    seen = seen.groupBy(*keys, "_day").agg(F.max("_seen").alias("_seen")).withColumn("_probe", F.lit(False))
    probes = left.select(*keys, F.col("date").alias("_day")).distinct().withColumn("_probe", F.lit(True))
    upto = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("_day", "_probe")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = (
        seen.unionByName(probes, allowMissingColumns=True)
        .withColumn("_best", F.max("_seen").over(upto))
        .filter("_probe")
        .select(*keys, F.col("_day").alias("date"), F.col("_best.date").alias(period), F.col(f"_best.{value}").alias(value))
    )
    return left.join(found, [*keys, "date"], "left")


def inner_align(a: DataFrame, b: DataFrame, *, keys: list[str], left: str = "a", right: str = "b") -> DataFrame:
    """Common dates with both values present."""
    lhs = a.filter(F.col("value").isNotNull()).select(*keys, "date", F.col("value").alias(left))
    rhs = b.filter(F.col("value").isNotNull()).select(*keys, "date", F.col("value").alias(right))
    return lhs.join(rhs, [*keys, "date"])


def outer_align(a: DataFrame, b: DataFrame, *, keys: list[str], left: str = "a", right: str = "b") -> DataFrame:
    """All dates of either side."""
    lhs = a.select(*keys, "date", F.col("value").alias(left))
    rhs = b.select(*keys, "date", F.col("value").alias(right))
    return lhs.join(rhs, [*keys, "date"], "full_outer")


def padded(value: str | Column, keys: list[str], order: str = "date") -> Column:
    """The value, or the last one known before it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(w)


def month_last(
    series: DataFrame,
    *,
    keys: list[str],
    value: str = "value",
    label: str = "end",
    span_nulls: bool = False,
) -> DataFrame:
    """Last non-null value of each calendar month, with a NULL row for empty months.

    The months of a key run from its first to its last row; rows with a NULL
    value count for that span only with `span_nulls`. Each month fills the gap
    to the next one itself, so no calendar is joined.
    """
    month = F.trunc("date", "month")
    rows = series if span_nulls else series.filter(F.col(value).isNotNull())
    monthly = (
        rows.groupBy(*keys, month.alias("_month"))
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("date"))).alias(value))
    )
    following = F.lead("_month").over(Window.partitionBy(*keys).orderBy("_month"))
    upto = F.coalesce(F.add_months(following, -1), F.col("_month"))
    grid = monthly.withColumn("_upto", upto).select(
        *keys,
        "_month",
        value,
        F.explode(F.sequence("_month", "_upto", F.expr("interval 1 month"))).alias("_slot"),
    )
    shown = F.last_day("_slot") if label == "end" else F.col("_slot")
    return grid.select(
        *keys, shown.alias("date"), F.when(F.col("_slot") == F.col("_month"), F.col(value)).alias(value)
    )
