"""Document fingerprints from closed syncmers, in SQL expressions.

A k-mer is K code points. It is chosen as an anchor when the smallest hash of its
inner S-mers stands first or last among them, which depends on the k-mer alone:
equal passages have equal anchors whatever surrounds them. The fingerprint is the
sketch of the `m` smallest anchor hashes.

Texts are turned to fixed-width UTF-32, so that a k-mer is a slice at a known
place, and are worked through in chunks to keep the lists short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

K, S, CHUNK, SKETCH = 12, 7, 2048, 64
_DIGITS = 10  # hexadecimal digits of a hash in a fingerprint


def _chosen(b: str, k: int, s: int) -> str:
    """SQL text: starts of the anchors of the UTF-32 binary `b`, a list for each chunk, out of order."""
    w = k - s + 1
    last = f"(octet_length({b}) div 4 - {k})"
    smers = f"transform(sequence(c, least(c + {CHUNK - 1}, {last}) + {w - 1}), i -> xxhash64(substring({b}, 4 * i + 1, {4 * s})))"
    # An inner S-mer that is least of the w from it on opens an anchor, one least of the w up to it
    # closes one. Past the ends get() is null, which chooses nothing.
    opens = " AND ".join(f"x <= get(h, e + {d})" for d in range(1, w))
    closes = " AND ".join(f"x <= get(h, e - {d})" for d in range(1, w))
    starts = (
        f"array_distinct(array_compact(concat(transform(h, (x, e) -> if({opens}, c + e, null)), "
        f"transform(h, (x, e) -> if({closes}, c + e - {w - 1}, null)))))"
    )
    return (
        f"transform(if({last} < 0, cast(array() AS array<int>), sequence(0, {last}, {CHUNK})), c -> "
        f"transform(array({smers}), h -> {starts})[0])"
    )


def anchors(text: str, k: int = K, s: int = S) -> Column:
    """array<struct<pos, hash>>: the anchors of the text column named, in order, positions in code points.

    A text shorter than k is one anchor, an empty or null one has none.
    """
    whole = "array(struct(0 AS pos, xxhash64(b) AS hash))"
    found = (
        f"transform(sort_array(flatten({_chosen('b', k, s)})), "
        f"i -> struct(i AS pos, xxhash64(substring(b, 4 * i + 1, {4 * k})) AS hash))"
    )
    return F.expr(
        f"transform(array(encode(coalesce({text}, ''), 'UTF-32')), "
        f"b -> if(octet_length(b) BETWEEN 1 AND {4 * k - 1}, {whole}, {found}))[0]"
    )


def _sketch(starts: str, b: str, k: int, m: int) -> str:
    """SQL text: the m smallest anchor hashes of a list of starts."""
    hashed = f"shiftrightunsigned(xxhash64(substring({b}, 4 * i + 1, {4 * k})), {64 - 4 * _DIGITS})"
    return f"slice(sort_array(array_distinct(transform({starts}, i -> {hashed}))), 1, {m})"


def _digits(sketch: str, b: str, k: int, m: int) -> str:
    """SQL text: a fingerprint, from a list of lists of hashes and the text's UTF-32 for short texts."""
    whole = f"array(shiftrightunsigned(xxhash64({b}), {64 - 4 * _DIGITS}))"
    short = f"octet_length({b}) BETWEEN 1 AND {4 * k - 1}"
    merged = f"slice(sort_array(array_distinct(if({short}, {whole}, flatten({sketch})))), 1, {m})"
    return f"array_join(transform({merged}, x -> lpad(lower(hex(x)), {_DIGITS}, '0')), '')"


def fingerprint(text: str, k: int = K, s: int = S, m: int = SKETCH) -> Column:
    """The fingerprint of the text column named, null being empty.

    The m smallest anchor hashes as hexadecimal digits, in order, joined.
    """
    lists = f"transform({_chosen('b', k, s)}, p -> {_sketch('p', 'b', k, m)})"
    # A lambda's variable, so that the text is turned to UTF-32 once.
    return F.expr(f"transform(array(encode(coalesce({text}, ''), 'UTF-32')), b -> {_digits(lists, 'b', k, m)})[0]")


def edited_fingerprints(text: str, tail: str, k: int = K, s: int = S, m: int = SKETCH) -> Column:
    """struct<own, edited>: fingerprints of a text column and of the same text with `tail` for its last third.

    Anchors are free of context, so those of the edited text are the text's own
    that end before the cut, and those of the seam: the k - 1 code points before
    the cut and the tail. Each part is worked through once.
    """
    n = "octet_length(b) div 4"
    cut = f"({n} - {n} div 3)"
    limit = f"({cut} - {k})"
    tail_b = f"encode({tail}, 'UTF-32')"
    head_b = f"substring(b, 1, 4 * {cut})"
    seam = f"concat(substring(b, 4 * greatest(0, {cut} - {k - 1}) + 1, 4 * least({cut}, {k - 1})), {tail_b})"
    empty = "cast(array() AS array<bigint>)"
    left = (
        f"if(size(p) = 0 OR array_min(p) > {limit}, {empty}, if(array_max(p) <= {limit}, a, "
        f"{_sketch(f'filter(p, i -> i <= {limit})', 'b', k, m)}))"
    )
    both = (
        f"transform({_chosen('b', k, s)}, p -> transform(array({_sketch('p', 'b', k, m)}), "
        f"a -> struct(a AS a, {left} AS l))[0])"
    )
    seams = f"transform({_chosen('j', k, s)}, p -> {_sketch('p', 'j', k, m)})"
    edited = f"transform(array({seam}), j -> concat(z.l, {seams}))[0]"
    own = _digits("z.a", "b", k, m)
    other = f"transform(array(concat({head_b}, {tail_b})), e -> {_digits(edited, 'e', k, m)})[0]"
    return F.expr(
        f"transform(array(encode({text}, 'UTF-32')), b -> transform(array({both}), "
        f"z -> struct({own} AS own, {other} AS edited))[0])[0]"
    )


def likeness(a: Column, b: Column, m: int = SKETCH) -> Column:
    """Jaccard likeness of the anchor sets behind two fingerprints; two empty ones are alike.

    The m smallest of both together are a fair draw from the union: the share
    of them in both.
    """
    def parts(x: Column) -> Column:
        return F.regexp_extract_all(x, F.lit(f"[0-9a-f]{{{_DIGITS}}}"), F.lit(0))

    both = F.array_intersect(parts(a), parts(b))
    union = F.slice(F.sort_array(F.array_union(parts(a), parts(b))), 1, m)
    shared = F.size(F.array_intersect(union, both))
    return F.when((a == "") & (b == ""), F.lit(1.0)).otherwise(shared / F.size(union))


def chain(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", blocks: int = 64) -> DataFrame:
    """docs with _block, _h and _guest, ready for lead() over next_order().

    Blocks are ranges of ids between quantiles, so no task sorts all rows. Each
    block also gets a copy of the head row of the block after it, marked _guest;
    the block of the smallest ids is followed by that of the largest. Ties of an id
    go by the hash of the text; null ids come last.
    """
    keyed = docs.withColumn("_h", F.xxhash64(text_col))
    at = [i / blocks for i in range(1, blocks)]
    bounds = docs.agg(F.percentile_approx(id_col, at, 10_000)).first()[0] or []
    edges = F.array(*[F.lit(int(x)) for x in sorted(set(bounds))]) if bounds else F.array().cast("array<bigint>")
    keyed = keyed.withColumn("_block", F.size(F.filter(edges, lambda e: F.coalesce(F.col(id_col) > e, F.lit(False)))))
    order = F.struct(F.col(id_col), F.col("_h"))
    heads = keyed.groupBy("_block").agg(F.max(order).alias("_head"))
    down = Window.orderBy(F.desc("_block"))
    every = Window.partitionBy()
    # One row per block: the block that a head follows; the first head follows the last block.
    heads = heads.select(
        F.col("_head")[id_col].alias("_hid"),
        F.col("_head")["_h"].alias("_hh"),
        F.coalesce(F.lag("_block").over(down), F.min("_block").over(every)).alias("_to"),
    )
    guests = (
        keyed.join(F.broadcast(heads), F.col(id_col).eqNullSafe(F.col("_hid")) & (F.col("_h") == F.col("_hh")))
        .withColumn("_block", F.col("_to"))
        .drop("_hid", "_hh", "_to")
    )
    return keyed.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)))


def next_order(id_col: str = "doc_id"):
    """The window in which lead() is the next document, for what chain() returns."""
    return Window.partitionBy("_block").orderBy("_guest", F.col(id_col).desc_nulls_last(), F.desc("_h"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs (doc_id, text, none of them null) and how well they hold under an edit.

    The edited text is the text whose last third (rounded down) of code points is
    replaced by the first as many, or all, of the next document in descending
    doc_id. Texts move once, by blocks of ids; both windows and all fingerprints
    use that order.
    """
    blocks = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = next_order()
    third = F.floor(F.col("n_chars") / 3).cast("int")
    text, follows = F.col("text"), F.col("_next")
    return (
        chain(docs, blocks=blocks)
        .withColumn("_next", F.lead("text").over(order))
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("_tail", F.substring(F.coalesce(follows, F.lit("")), F.lit(1), third))
        .select(
            "doc_id", "_block", "_guest", "_h", "n_chars",
            F.sha2(F.concat(F.substring(text, F.lit(1), F.col("n_chars").cast("int") - third), "_tail"), 256)
            .alias("edited_sha256"),
            edited_fingerprints("text", "_tail").alias("_f"),
        )
        .withColumns({"fingerprint": F.col("_f.own"), "edited_fingerprint": F.col("_f.edited")})
        .withColumn("_near", F.lead("fingerprint").over(order))
        .where(~F.col("_guest"))
        .select(
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("_near")).alias("near_next"),
        )
    )
