"""Mixing sources to target weights by the cube method.

Each source has a target in words, its documents one inclusion number
target / source size: the whole part is taken for certain, the fraction is a
probability. Balanced sampling rounds those fractions so that words and
documents of each source keep their totals.

Flight phase: of three undecided documents, move the probabilities along the
vector on which both totals stay, in a direction drawn so that each expectation
stays too, until one of them is 0 or 1; replace it by the next document. Blocks
of a source fly side by side as Spark groups and leave two undecided documents
each; these fly again in fewer blocks until a source has one block. Landing: the
last two keep the number of documents and give up exact words, then the last one
is drawn. Large documents fly first, so what lands is small.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import durable, whole_row, word_count

WEIGHTS = (3.0, 1.0, 2.0)
_TINY = 1e-9


def fly(prob: np.ndarray, size: np.ndarray, draws: np.ndarray, land: bool) -> np.ndarray:
    """Probabilities after the flight; at most two stay between 0 and 1, none after landing."""
    p = np.where(prob < _TINY, 0.0, np.where(prob > 1 - _TINY, 1.0, prob)).tolist()
    x, u = size.tolist(), draws.tolist()
    active: list[int] = []

    def move(v: list[float], chance: float) -> None:
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(active, v) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(active, v) if d)
        step = up if chance * (up + down) < down else -down
        for i, d in zip(active, v):
            q = p[i] + step * d
            p[i] = 0.0 if q < _TINY else 1.0 if q > 1 - _TINY else q
        active[:] = [i for i in active if 0.0 < p[i] < 1.0]

    k = 0
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        active.append(i)
        while len(active) == 3:
            a, b, c = (x[j] for j in active)
            scale = max(abs(c - b), abs(a - c), abs(b - a))
            v = [(c - b) / scale, (a - c) / scale, (b - a) / scale] if scale else [1.0, -1.0, 0.0]
            move(v, u[k % len(u)])
            k += 1
    if land:
        if len(active) == 2:
            move([1.0, -1.0], u[k % len(u)])
            k += 1
        for i in active:
            p[i] = 1.0 if u[k % len(u)] < p[i] else 0.0
    return np.array(p)


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, source_docs, target) of each source.

    sizes: source, size. Sources by code point, null last, weigh `weights` in
    turn. They share `share` times all sizes by weight; none gets more than `cap`
    times its own size, what is above is shared among the rest again. That is
    target = min(cap * size, level * weight) for one level, found in one pass over
    the sources by the ratio at which each is full. One row per source goes
    through the windows; documents do not.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("_full", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    table = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
        .withColumn("_w", F.get(table, ((F.row_number().over(by_name) - 1) % n).cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_full", F.col("_cap") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("_before", F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cap"))
        .withColumn("_left", F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_left"))
        .withColumn(
            "_level", F.min_by(F.when(F.col("_level") <= F.col("_full"), F.col("_level")),
                               F.when(F.col("_level") <= F.col("_full"), F.col("_full"))).over(every)
        )
        .withColumn("target", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(
            F.least("_cap", F.col("_level") * F.col("_w"))))
        .select("source", "source_size", "source_docs", "target")
    )


def cube_sample(units: DataFrame, largest: int, *, block: int = 4096, seed: int = 2) -> DataFrame:
    """units with `prob` rounded to 0 or 1, balanced on size and number within each source.

    units: source, size, prob, uid, number (of the source's units) and more columns,
    all of which are kept. `largest` bounds the number of units of any source and
    decides only how often the undecided fly again. Groups hold about `block` rows.
    """
    done = None
    schema = units.schema
    while True:
        blocks = max(1, math.ceil(largest / block))
        last = blocks == 1

        def flight(frame: pd.DataFrame, land: bool = last) -> pd.DataFrame:
            frame = frame.sort_values(["size", "uid"], ascending=[False, True], kind="stable", ignore_index=True)
            start = int(frame["uid"].min()) & 0xFFFFFFFF
            draws = np.random.default_rng([seed, start, len(frame)]).random(2 * len(frame) + 4)
            frame["prob"] = fly(frame["prob"].to_numpy(), frame["size"].to_numpy(float), draws, land)
            return frame

        # Each source has as many blocks as its own number asks for, spread by hash.
        own = F.greatest(F.lit(1), F.ceil(F.col("number") / block).cast("int"))
        slot = F.pmod(F.xxhash64(F.lit(blocks), "uid"), own).cast("int")
        flown = durable(
            units.withColumn("_b", F.lit(0) if last else slot)
            .groupBy("source", "_b")
            .applyInPandas(lambda frame: flight(frame.drop(columns="_b")), schema),
            "flight",
        )
        open_ = (F.col("prob") > 0) & (F.col("prob") < 1)
        decided = flown.where(~open_)
        done = decided if done is None else done.unionByName(decided)
        if last:
            return done
        # Two of each block at most are left; blocks of a source are no more than its number / block, rounded up.
        largest = 2 * blocks
        units = flown.where(open_).withColumn("number", 2 * own)


def mix(docs: DataFrame, *, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 2, salts: int = 16) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of docs.

    docs: doc_id, source, size. copies is how often the mix takes the document, at
    most `cap` rounded up. Repeated rows are units of their own; rows with null ids
    too. Empty documents count as documents of size 0. An empty table gives an
    empty one. The sources' table goes to every salt of a document's hash, so a
    source with a third of all rows is dealt over `salts` join keys.
    """
    sized = docs.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    targets = durable(source_targets(sized, weights=weights, share=share, cap=cap), "targets")
    largest = targets.agg(F.max("source_docs")).first()[0] or 0
    salted = targets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("source", "_s")
    uid = F.xxhash64(F.lit(seed), "doc_id", "source", "size")
    left = sized.withColumn("_u", uid).withColumn("_k", F.pmod("_u", F.lit(salts)).cast("int"))
    ratio = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    joined = left.join(salted, (F.col("_k") == F.col("_salt")) & F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "size", "source_size", "target",
        F.floor(ratio).cast("int").alias("whole"),
        (ratio - F.floor(ratio)).alias("prob"),
        F.col("_u").alias("uid"),
        F.col("source_docs").alias("number"),
    )
    rounded = cube_sample(joined, int(largest), seed=seed)
    copies: Column = F.col("whole") + F.round("prob").cast("int")
    return rounded.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it, all columns with their values.

    Rows alike in id, source and size share what the mix takes of them; those whose
    text hashes are least are taken once more. Rows alike in their text too are
    interchangeable, so reruns give the same rows.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    key = F.xxhash64(F.lit(1), "doc_id", "source", "size")
    # How many rows of a key are taken once more than the rest.
    plan = (
        mix(sized, **options)
        .groupBy(key.alias("key"))
        .agg(F.min("copies").alias("least"), F.max("copies").alias("most"), F.sum("copies").alias("all"), F.count("*").alias("rows"))
        .where("most > 0")
        .select("key", "least", (F.col("all") - F.col("least") * F.col("rows")).alias("more"))
    )
    rows = docs.select(
        whole_row(docs).alias("doc"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text")
    ).select("doc", "text", key.alias("key"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("text"))
    copies = F.col("least") + F.when(F.col("nth") <= F.col("more"), 1).otherwise(0)
    return (
        rows.withColumn("nth", nth)
        .join(plan, "key")
        .withColumn("copies", copies)
        .where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("doc.*")
    )
