"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SALTS = 16
#: A key is hot with more than one in so many rows, so there are no more hot keys than this.
SHARES = 64
#: Fewer rows than this make no task slow, whoever holds them.
LEAST = 10_000


def hot_keys(rows: DataFrame, key: str, *, shares: int = SHARES, least: int = LEAST) -> list:
    """The keys that hold more than 1/shares of all rows: fewer than `shares` by that rule."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    if total < least:
        return []
    return [row[0] for row in counts.filter(F.col("n") * shares > total).collect() if row[0] is not None]


def spread_join(
    big: DataFrame, small: DataFrame, key: str, *, by: str, salts: int = SALTS, hot: list | None = None
) -> DataFrame:
    """Inner join on `key`; the rows of the `hot` keys of `big` are dealt out over `salts` parts.

    Which keys are hot is for the caller to say, who may know it or ask `hot_keys`, a
    job of its own. A row's part follows from its `by` column, so a task that is run again deals
    the same. Only the rows of `small` that have a hot key are repeated, once per
    part; all others are joined as they are. Without hot keys this is a plain join, of
    which adaptive execution splits what turns out large.
    """
    if not hot:
        return big.join(small, key)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    zero = F.lit(0).cast("bigint")
    dealt = big.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(zero))
    last = F.when(is_hot, F.lit(salts - 1).cast("bigint")).otherwise(zero)
    copies = small.withColumn("_salt", F.explode(F.sequence(zero, last)))
    return dealt.join(copies, [key, "_salt"]).drop("_salt")
