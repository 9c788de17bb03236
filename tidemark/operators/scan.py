"""Running values over long series without one task for each key.

A window partitioned by key alone puts a key's whole history into one task. Here a
history is cut into parts, ranges along its order. What a part hands on (its last
known values, the sums of its rows) is an aggregate that combines before the
shuffle; over these few rows, one for each key and part, a small window carries it
forward. It comes back as one seed row in front of each part, so the rows themselves
shuffle and sort once, by (key, part), and need no join.

`part` is a column that never falls along the order of a key, such as the year or
the day of a time. Parts may be uneven or empty. Keys may be null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

PART, SEED, ROW, BLOCK, OWN = "_part", "_seed", "_row", "_block", "_own"
BLOCK_ROWS = 50_000


def running(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    part: Column,
    last: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
) -> DataFrame:
    """rows with running values up to each row: the `last` one that isn't null, and the `total` (null before any).

    The order must be total within a key where values differ. Equal to one window
    by key from its first row to the current one.
    """
    last, total = last or {}, total or {}
    whole = rows.withColumn(PART, part)
    place = F.struct(*order)
    held = whole.withColumns({f"_v_{n}": c for n, c in {**last, **total}.items()})
    handed = held.groupBy(*keys, PART).agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_v_{n}") for n in last],
        *[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in total],
    )
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    seeds = handed.select(
        *keys,
        PART,
        F.lit(True).alias(SEED),
        *[F.last(f"_v_{n}", ignorenulls=True).over(before).alias(f"_v_{n}") for n in last],
        *[F.sum(f"_v_{n}").over(before).alias(f"_v_{n}") for n in total],
    )
    upto = (
        Window.partitionBy(*keys, PART)
        .orderBy(F.col(SEED).desc(), *order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        held.withColumn(SEED, F.lit(False))
        .unionByName(seeds, allowMissingColumns=True)
        .withColumns(
            {
                **{n: F.last(f"_v_{n}", ignorenulls=True).over(upto) for n in last},
                **{n: F.sum(f"_v_{n}").over(upto) for n in total},
            }
        )
        .filter(~F.col(SEED))
        .select(*rows.columns, *last, *total)
    )


def over_blocks(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    compute: Callable[[DataFrame, list[str]], DataFrame],
    *,
    back: int,
    part: Column,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """compute(rows, keys) in blocks of consecutive rows of a key, for windows that reach `back` rows back at most.

    Rows are numbered by a running total, then dealt into blocks by number; the last
    `back` rows of a block come before the next one too. `compute` gets the keys with
    the block among them, must keep the rows and their columns and may add some.
    """
    size = max(block_rows, back, 1)
    numbered = running(rows, keys, order, part=part, total={ROW: F.lit(1)})
    block = F.floor((F.col(ROW) - 1) / size).cast("long")
    ahead = (F.col(ROW) - 1) % size >= size - back
    own, copy = F.struct(block.alias(BLOCK), F.lit(True).alias(OWN)), F.struct((block + 1).alias(BLOCK), F.lit(False).alias(OWN))
    places = F.when(ahead, F.array(own, copy)).otherwise(F.array(own)) if back else F.array(own)
    dealt = numbered.select(*rows.columns, F.inline(places))
    done = compute(dealt, [*keys, BLOCK])
    return done.filter(OWN).drop(BLOCK, OWN)
