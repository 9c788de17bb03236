"""Uniform shuffle into shards of exact size, planned by a communication matrix.

Rows lie in P partitions and go to S shards. How many rows partition p sends to
shard j in a uniformly random shuffle follows a multivariate hypergeometric law
with the partition sizes as row sums and the shard sizes as column sums. That
matrix of counts is drawn first. Then each partition permutes its own rows and
deals them by its row of the matrix, the rows are exchanged, and every shard is
permuted again. No global sort, and shard sizes are exact whatever the seed.

DataFrame functions only. All randomness comes from hashes of the seed and the
row, so a lost task repeats its decisions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import durable, uniform, whole_row

def _hypergeometric(draws: str, good: str, total: str, u: str) -> str:
    """SQL text: good items among the draws without return, by inversion of u in [0, 1).

    Walks the weights by their ratio over 12 deviations and more to either side of
    the mean; what lies beyond is below the precision of a double.
    """
    mean = f"({draws} * double({good}) / greatest({total}, 1))"
    # Whole numbers that bound the walk: 12 deviations and 24 more.
    reach = f"(12 * sqrt({mean} * (1 - double({good}) / greatest({total}, 1))) + 24)"
    low = f"greatest(0, {draws} - ({total} - {good}), bigint(floor({mean} - {reach})))"
    high = f"least({draws}, {good}, bigint(ceil({mean} + {reach})))"
    step = f"(double({good} - k) * ({draws} - k)) / (double(k + 1) * ({total} - {good} - {draws} + k + 1))"
    between = "if(r.hi > r.lo, sequence(r.lo, r.hi - 1), cast(array() AS array<bigint>))"
    whole = (
        f"aggregate({between}, struct(1.0D AS w, 1.0D AS s), "
        f"(a, k) -> struct(a.w * {step} AS w, a.s + a.w * {step} AS s), a -> a.s)"
    )
    pick = (
        f"aggregate({between}, struct(1.0D AS w, 1.0D AS s, r.lo AS x), (a, k) -> "
        f"if(a.s > g, a, struct(a.w * {step} AS w, a.s + a.w * {step} AS s, k + 1 AS x)), a -> a.x)"
    )
    return (
        f"transform(array(struct({low} AS lo, {high} AS hi)), r -> "
        f"transform(array({u} * {whole}), g -> {pick})[0])[0]"
    )


def _matrix_rows(sizes: str, caps: str, seed: int, tag: str) -> Column:
    """array<array<long>>: what each of `sizes` sends to each of `caps`.

    The sizes add up to the caps. Row after row, cell after cell: each cell is
    hypergeometric given those before, which gives the joint law exactly.
    """
    u = (
        f"shiftrightunsigned(xxhash64({seed}L, {tag}, size(m.done), size(c.cells)), 11) * {2.0**-53!r}D"
    )
    cell = _hypergeometric("c.draws", "good", "c.total", u)
    row = (
        "aggregate(m.rest, struct(n AS draws, aggregate(m.rest, 0L, (a, b) -> a + b) AS total, "
        "cast(array() AS array<bigint>) AS cells), (c, good) -> transform(array("
        f"{cell}), x -> struct(c.draws - x AS draws, c.total - good AS total, "
        "concat(c.cells, array(x)) AS cells))[0], c -> c.cells)"
    )
    return F.expr(
        f"aggregate({sizes}, struct({caps} AS rest, cast(array() AS array<array<bigint>>) AS done), "
        f"(m, n) -> transform(array({row}), z -> struct(zip_with(m.rest, z, (a, b) -> a - b) AS rest, "
        "concat(m.done, array(z)) AS done))[0], m -> m.done)"
    )


def communication_matrix(counts: DataFrame, n_shards: int, side: int, seed: int) -> DataFrame:
    """(part, cells): the drawn row of each partition.

    counts: (part, n), parts from 0 to side * side - 1. Drawn in two levels, so
    that no list is longer than `side`: first for groups of partitions, then for
    the partitions of each group, all groups side by side.
    """
    grouped = counts.withColumn("grp", F.floor(F.col("part") / side).cast("int"))
    per_group = (
        grouped.groupBy("grp")
        .agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"))
        .withColumn("size", F.aggregate("parts", F.lit(0).cast("long"), lambda a, b: a + b["n"]))
    )
    total = F.aggregate("groups", F.lit(0).cast("long"), lambda a, b: a + b["size"])
    caps = F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda j: F.floor(total / n_shards).cast("long") + F.when(j < total % n_shards, 1).otherwise(0),
    )
    top = (
        per_group.groupBy()
        .agg(F.array_sort(F.collect_list(F.struct("grp", "size"))).alias("groups"))
        .where(F.size("groups") > 0)
        .withColumn("caps", caps)
        .withColumn("rows", _matrix_rows("groups.size", "caps", seed, "-1"))
        .select(F.explode(F.arrays_zip(F.col("groups.grp").alias("grp"), F.col("rows").alias("row"))).alias("z"))
        .select("z.grp", F.col("z.row").alias("caps"))
    )
    return (
        per_group.join(top, "grp")
        .withColumn("rows", _matrix_rows("parts.n", "caps", seed, "grp"))
        .select(F.explode(F.arrays_zip(F.col("parts.part").alias("part"), F.col("rows").alias("cells"))).alias("z"))
        .select("z.part", "z.cells")
    )


def shuffle_into_shards(
    docs: DataFrame, n_shards: int = 8, *, id_col: str = "doc_id", salt_cols: tuple[str, ...] = ("text",), seed: int = 9
) -> DataFrame:
    """Every row of docs with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in each shard).

    Shard sizes differ by one row at most and the order is uniformly random.
    Deterministic in the rows and the seed. salt_cols tell rows with the same id
    apart; rows equal in those too are interchangeable, so any order between them
    gives the same table. Null ids and texts hash like values. Columns of docs
    named shard or slot are replaced, all others keep their values. An empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    side = max(2, math.ceil(math.sqrt(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    parts = side * side
    base = docs.drop("shard", "slot")
    key = F.xxhash64(F.lit(seed), F.col(id_col), *[F.col(c) for c in salt_cols])
    keyed = base.select(whole_row(base).alias("doc"), key.alias("_h"), F.pmod(key, F.lit(parts)).cast("int").alias("_part"))
    counts = keyed.groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    cells = durable(communication_matrix(counts, n_shards, side, seed), "matrix")

    # Permute locally, then deal by the matrix row: the first cells[0] rows to shard 0, and so on.
    local = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit("local"), "_h"), "_h")
    rank = F.row_number().over(local) - 1
    shard = F.aggregate(
        "cells",
        F.struct(F.col("_rank").cast("long").alias("left"), F.lit(0).alias("shard"), F.lit(False).alias("done")),
        lambda a, n: F.struct(
            F.when(a["done"], a["left"]).otherwise(a["left"] - n).alias("left"),
            F.when(a["done"] | (a["left"] < n), a["shard"]).otherwise(a["shard"] + 1).alias("shard"),
            (a["done"] | (a["left"] < n)).alias("done"),
        ),
    )["shard"]
    dealt = (
        keyed.join(cells.withColumnRenamed("part", "_part"), "_part")
        .withColumn("_rank", rank)
        .withColumn("shard", shard.cast("int"))
        # The second permutation's order, and the block of the shard that it falls in.
        .withColumn("_order", F.xxhash64(F.lit("shard"), "_h"))
        .withColumn("_block", F.floor(uniform(F.lit("shard"), F.col("_h")) * parts).cast("int"))
        .drop("cells", "_rank", "_part")
    )
    # The order within a shard is by block, then by hash in the block; a block's
    # first slot is the number of rows in the blocks before.
    sizes = dealt.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_block").orderBy("_order", "_h")
    return (
        dealt.join(starts, ["shard", "_block"])
        .withColumn("slot", F.col("_start") + F.row_number().over(inside) - 1)
        .select("doc.*", "shard", F.col("slot").cast("long").alias("slot"))
    )
