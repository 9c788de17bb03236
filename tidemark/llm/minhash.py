"""Near-duplicate documents by fast similarity sketching.

A sketch has T bins. In round r every shingle is thrown into one bin by a hash of
its own and leaves the value (r, hash) there if that is less; rounds go on until
all bins are filled, after T rounds each further round serves one bin alone, so
2T rounds always suffice. Bins of two sketches agree with the Jaccard likeness of
the sets and as sharply concentrated as independent draws, yet a set larger than
T log T is read about once.

Sketches are cut into bands; documents that agree on a band share a bucket. Sets
that are equal are one class from the start, so copies cost nothing more. Links
are confirmed on full sets, in three steps that between them look at every pair
of classes that shares a bucket, except pairs that are in one group by then:
each class with the head of a bucket that it shares most bands with; with the
heads of its other buckets; and, in buckets that still hold more than one group,
the members of different groups with each other, found by their rarest shingles.
No step lists the pairs inside a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import durable, whole_row
from tidemark.llm.words import Names, mix, split, windows

BINS, ROWS = 128, 4
_NONE = np.uint64((1 << 64) - 1)

SIGNED = "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>"
SETS = "doc_id long, set_key binary, n_shingles long, shingles binary"


def fast_sketch(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One value for each bin from distinct 64-bit values; bins is a power of two, 128 at most."""
    out = np.full(bins, _NONE, np.uint64)
    if not len(x):
        return out
    r = 0
    while r < bins and (out == _NONE).any():
        # Small sets take several rounds at once; a bin keeps the value of its first round anyway.
        many = min(bins - r, max(1, 4 * bins // len(x)))
        rounds = np.arange(r, r + many, dtype=np.uint64)
        h = mix(x[None, :] ^ mix(rounds + np.uint64(1))[:, None])
        value = (rounds[:, None] << np.uint64(56)) | (h >> np.uint64(8))
        np.minimum.at(out, (h & np.uint64(bins - 1)).astype(np.int64).ravel(), value.ravel())
        r += many
    for b in np.flatnonzero(out == _NONE):
        r = np.uint64(bins + b)
        out[b] = (r << np.uint64(56)) | (mix(x ^ mix(np.array([r + np.uint64(1)]))) >> np.uint64(8)).min()
    return out


def bands(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A signed 64-bit bucket for each band of `rows` bins."""
    part = sketch.reshape(-1, rows)
    key = mix(np.arange(len(part), dtype=np.uint64) + np.uint64(77))
    for k in range(rows):
        key = mix(key ^ part[:, k])
    return key.view(np.int64)


class Shingler:
    """Sorted distinct hashes of the runs of `width` words of a text, A-Z lower-cased."""

    def __init__(self, width: int):
        self.width, self.names = width, Names()

    def __call__(self, text: str | None) -> np.ndarray:
        words = split(text)
        if not words:
            return np.empty(0, np.uint64)
        names = self.names.of([w.lower() for w in words])  # bytes.lower() leaves all but A-Z
        return np.unique(windows(names, min(self.width, len(names))))


def set_key(shingles: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def sketches(docs: DataFrame, width: int, bins: int) -> DataFrame:
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(width)
        for batch in batches:
            rows = []
            for doc, text, key in batch.itertuples(index=False, name=None):
                x = shingle(text)
                cut = bands(fast_sketch(x, bins)).tolist() if len(x) else []
                rows.append((doc, key, len(x), set_key(x), cut))
            out = pd.DataFrame(rows, columns=["doc_id", "text_key", "n_shingles", "set_key", "bands"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInPandas(sign, SIGNED)


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, set_key, n_shingles, shingles) of the wanted (doc_id, set_key) only."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(width)
        for batch in batches:
            rows = []
            for doc, text, key in batch.itertuples(index=False, name=None):
                x = shingle(text)
                if set_key(x) == bytes(key):
                    rows.append((doc, key, len(x), x.tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "set_key", "n_shingles", "shingles"])

    joined = docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "set_key")
    return joined.mapInPandas(build, SETS).dropDuplicates(["doc_id", "set_key"])


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets have den * shared >= num * union."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"), F.col("n_shingles").alias("_n"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"), F.col("n_shingles").alias("_m"))
    fits = den * F.least("_n", "_m") >= num * F.greatest("_n", "_m")
    # Sizes are known for each class: pairs that can't reach the ratio meet no set.
    sized = (
        pairs.select("a", "b")
        .join(one.select("a", "_n"), "a")
        .join(two.select("b", "_m"), "b")
        .where(fits)
        .select("a", "b")
    )
    return sized.join(one.drop("_n"), "a").join(two.drop("_m"), "b").mapInPandas(compare, "a long, b long")


def prefix_pairs(sets: DataFrame, placed: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): classes of different groups that may reach the ratio; placed: rep, _g.

    The shingles of a set are ranked by how many of these sets hold them, rarest
    first. Sets that share `need` shingles have their first common one among the
    first n - need + 1 of either; pairs without such a one are not made. A copy with
    many changes starts with shingles of its own and so meets nobody, however
    many copies of the same text there are.
    """

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, n, group, raw in batch.itertuples(index=False, name=None):
                yield pd.DataFrame({"rep": doc, "n": n, "grp": group, "shingle": np.frombuffer(raw, np.int64)})

    own = sets.withColumnRenamed("doc_id", "rep").join(placed, "rep").select("rep", "n_shingles", "_g", "shingles")
    rows = own.mapInPandas(unfold, "rep long, n long, grp long, shingle long")
    held = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("held", "shingle"))
    # No partner of a set of n is smaller than num / den * n, so need is at least that.
    most = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    first = rows.join(held, "shingle").withColumn("at", rank).where(F.col("at") <= most)
    first = durable(first.select("shingle", "rep", "n", "grp", "at"), "prefixes")
    mixed = first.groupBy("shingle").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low < high")
    first = first.join(mixed.select("shingle"), "shingle")
    need = F.ceil((F.col("l.n") + F.col("r.n")) * num / F.lit(num + den))
    meets = (
        (F.col("l.shingle") == F.col("r.shingle"))
        & (F.col("l.grp") < F.col("r.grp"))
        & (F.col("l.at") <= F.col("l.n") - need + 1)
        & (F.col("r.at") <= F.col("r.n") - need + 1)
        & (den * F.least("l.n", "r.n") >= num * F.greatest("l.n", "r.n"))
    )
    pairs = first.alias("l").join(first.alias("r"), meets)
    return pairs.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the least node that it reaches.

    Alternating large and small stars: each round hooks every node's larger
    neighbours, then its smaller ones, to its least neighbour. All steps are
    aggregates and joins; a node with very many neighbours is a hot join key that
    adaptive execution splits. Rounds are written out, their number grows with the
    logarithm of the nodes.
    """

    def normal(frame: DataFrame) -> DataFrame:
        return frame.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def mark(frame: DataFrame) -> tuple:
        row = frame.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        return tuple(row)

    now = durable(normal(edges), "edges")
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = normal(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = durable(
            normal(
                small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                    low.select("a", F.col("m").alias("b"))
                )
            ),
            "stars",
        )
        was, seen = seen, mark(now)
        if was == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Documents are linked when den * shared >= num * union of their sets of distinct
    shingles; one with fewer than `width` words is one shingle, one without any is
    linked with nothing. component_id is the least doc_id reachable. With 32 bands of
    4 bins a pair at likeness 0.75 shares no bucket with probability 5e-6, one at 0.8
    with 5e-8. Null ids take part and are never the least while others are there.
    A null id is not kept where its set is that of a document with an id. Other columns
    are ignored; an empty table gives an empty one. Options: width, num, den, bins.
    """
    return _placed(docs, **options).drop("text_key")


def _placed(docs: DataFrame, *, width: int = 5, num: int = 75, den: int = 100, bins: int = BINS) -> DataFrame:
    """near_duplicates() with text_key, a hash of the text: it tells rows of one id apart."""
    signed = durable(sketches(docs, width, bins), "sketches")
    has = F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()
    classes = signed.where(has).groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    buckets = classes.select("rep", "set_key", F.explode("bands").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = durable(buckets.join(heads.drop("n"), "bucket"), "buckets")

    wanted = members.select(F.col("rep").alias("doc_id"), "set_key").distinct()
    sets = durable(full_sets(docs, wanted, width), "sets")
    stars = durable(
        members.where("rep <> head").groupBy(F.col("rep").alias("a"), F.col("head").alias("b")).agg(
            F.count(F.lit(1)).alias("votes")
        ),
        "stars",
    )
    # Each class with one head.
    first = stars.groupBy("a").agg(F.max_by("b", F.struct("votes", -F.col("b"))).alias("b"))
    links = durable(confirmed(first, sets, num, den), "links")
    groups = components(links)

    def grouped(frame: DataFrame, column: str, name: str) -> DataFrame:
        own = groups.select(F.col("node").alias(column), F.col("root").alias("_r"))
        return frame.join(own, column, "left").withColumn(name, F.coalesce("_r", column)).drop("_r")

    # With the other heads, where groups differ.
    rest = grouped(grouped(stars, "a", "_ga"), "b", "_gb").where("_ga <> _gb").select("a", "b")
    more = durable(confirmed(rest.join(first, ["a", "b"], "left_anti"), sets, num, den), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        groups = components(links)

    # Members of different groups that are still in one bucket; heads have been compared.
    placed = grouped(members, "rep", "_g").where("rep <> head")
    mixed = placed.groupBy("bucket").agg(F.min("_g").alias("_low"), F.max("_g").alias("_high")).where("_low < _high")
    left = durable(placed.join(mixed.select("bucket"), "bucket").select("rep", "_g").distinct(), "mixed")
    cross = prefix_pairs(sets, left, num, den)
    last = durable(confirmed(cross, sets, num, den), "links")
    if not last.isEmpty():
        groups = components(links.unionByName(last))

    reps = classes.select("set_key", F.col("rep"))
    roots = grouped(reps, "rep", "_root").select("set_key", "_root")
    return (
        signed.select("doc_id", "text_key", "n_shingles", "set_key")
        .join(roots, "set_key", "left")
        .withColumn("component_id", F.coalesce("_root", "doc_id"))
        .select(
            "doc_id", "text_key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
        )
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group, that of the least id, in all its columns and values.

    What stays is what near_duplicates() keeps, null ids alike, and once of each: rows
    of one id and text are one document even if other columns differ, and one of
    them stays. Rows of one id with different texts are documents of their own.
    """
    none = F.lit(-(2**63))
    placed = _placed(docs, **options).where(~F.col("kept"))
    gone = placed.select(F.coalesce("doc_id", none).alias("id"), F.col("text_key").alias("text")).distinct()
    rows = docs.select(
        whole_row(docs).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), none).alias("id"), F.xxhash64("text").alias("text")
    )
    # Equal rows lie together after the join, so the second step moves nothing.
    return rows.join(gone, ["id", "text"], "left_anti").dropDuplicates(["id", "text"]).select("doc.*")
