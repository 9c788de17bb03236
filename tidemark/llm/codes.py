"""Vector code compression: a codebook for each part of a vector, searched by equal averages.

Vectors are cut into equal consecutive parts; a part is replaced by the number of
the nearest of its position's codebook entries. The entries of a position are
sorted by the sum of their components. A search starts where the sum of the part
belongs and goes outward, nearer sum first: (sum gap)^2 / dimension never exceeds
the squared distance, so once it is strictly greater than the best one found, no
other entry can be nearer or tie.

A round reads the vectors once and moves sums alone: each task adds up its parts
by position and entry and hands over one row for each of them. Codebooks have a
size set by the parameters, whatever the data, and travel with the tasks; vectors
never shuffle, so a lost executor costs a repetition of its own splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import durable
from tidemark.llm.vectors import SCALE, integers, matrix, reach_of, usable

_FAR = np.int64(2**33)


class Codebooks:
    """Entries of all part positions: (parts, entries, part dimension), with their order by sum."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        sums = self.entries.sum(axis=2)
        self.order = np.argsort(sums, axis=1, kind="stable")
        # A sum too far for any search closes both ends.
        self.sums = np.pad(np.take_along_axis(sums, self.order, 1), ((0, 0), (1, 1)), constant_values=((0, 0), (-_FAR, _FAR)))

    def search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry and squared distance of each part, ties to the lower number; and entries looked at."""
        parts, many, dims = self.entries.shape
        points = vectors.reshape(-1, dims)
        where = np.tile(np.arange(parts), len(vectors))
        mine = points.sum(axis=1)
        right = np.empty(len(points), np.int64)
        for p in range(parts):
            right[p::parts] = np.searchsorted(self.sums[p], mine[p::parts])
        left = right - 1
        best = np.full(len(points), np.iinfo(np.int64).max // dims)
        code = np.full(len(points), many)
        active, looked = np.arange(len(points)), 0
        while len(active):
            p, s = where[active], mine[active]
            below, above = s - self.sums[p, left[active]], self.sums[p, right[active]] - s
            up = above <= below
            gap = np.where(up, above, below)
            # Strictly greater: an entry at exactly the best distance may have a lower number.
            on = (gap * gap <= best[active] * dims) & (gap < _FAR // 2)
            active, p, up = active[on], p[on], up[on]
            looked += len(active)
            entry = self.order[p, np.where(up, right[active], left[active]) - 1]
            away = points[active] - self.entries[p, entry]
            away = np.einsum("ij,ij->i", away, away)
            old, held = best[active], code[active]
            nearer = (away < old) | ((away == old) & (entry < held))
            best[active] = np.where(nearer, away, old)
            code[active] = np.where(nearer, entry, held)
            right[active] += up
            left[active] -= ~up
        return code.reshape(-1, parts), best.reshape(-1, parts), looked

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable_vectors(frame: DataFrame, parts: int, dims: int | None = None) -> DataFrame:
    """(vec_id, label, v): integer vectors that can be cut into equal parts.

    Left out are null vectors, those with a null, NaN or infinite component, and
    what the integers can't hold: empty vectors, lengths that `parts` doesn't
    divide or that aren't `dims`, components of 2^22 / length or more in size.
    """
    vector, long = F.col("embedding"), F.size("embedding")
    fits = long == dims if dims else (long > 0) & (long % parts == 0)
    kept = frame.filter(vector.isNotNull() & fits)
    near = usable(vector, reach_of(dims)) if dims else usable(vector, reach_of(parts))
    return kept.filter(near).select("vec_id", "label", integers(vector).alias("v"))


def first_codebooks(frame: DataFrame, parts: int = 16, entries: int = 64) -> Codebooks | None:
    """Entries are the parts of the vectors with the smallest ids, ascending; None without vectors.

    Of equal ids the smaller vector comes first, null ids come last. The length
    of the first of these vectors holds for all.
    """
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    heads = usable_vectors(frame, parts).orderBy(*order).limit(entries).collect()
    if not heads:
        return None
    dims = len(heads[0]["v"])
    if any(len(r["v"]) != dims or max(map(abs, r["v"])) >= reach_of(dims) * SCALE for r in heads):
        heads = usable_vectors(frame, parts, dims).orderBy(*order).limit(entries).collect()
    if not heads:
        return None
    cut = np.array([r["v"] for r in heads], np.int64).reshape(len(heads), parts, dims // parts)
    return Codebooks(cut.transpose(1, 0, 2))


def train(frame: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks | None:
    """Codebooks after `rounds` of assigning all parts and moving each entry to the floor of its parts' mean."""
    books = first_codebooks(frame, parts, entries)
    for _ in range(rounds if books else 0):
        books = _moved(frame, books)
    return books


def _moved(frame: DataFrame, books: Codebooks) -> Codebooks:
    parts, many, dims = books.entries.shape

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * many, dims), np.int64), np.zeros(parts * many, np.int64)
        for batch in batches:
            vectors = matrix(batch.column(0), parts * dims)
            code, _, _ = books.search(vectors)
            slot = (code + np.arange(parts) * many).ravel()
            counts += np.bincount(slot, minlength=parts * many)
            np.add.at(sums, slot, vectors.reshape(-1, dims))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {"slot": pa.array(used, pa.int32()), "n": pa.array(counts[used]), "total": pa.array(list(sums[used]), pa.list_(pa.int64()))}
        )

    rows = usable_vectors(frame, parts, parts * dims).select("v").mapInArrow(tally, "slot int, n long, total array<long>")
    exact = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"t{k}") for k in range(dims)]
    entries = books.entries.copy()
    # One row for each entry of each position: a size set by the parameters.
    for r in rows.groupBy("slot").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *exact).collect():
        entries[r["slot"] // many, r["slot"] % many] = [int(r[f"t{k}"]) // int(r["n"]) for k in range(dims)]
    return Codebooks(entries)


def encode(frame: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): codes as bytes in part order and the squared distance to what they stand for."""
    parts, _, dims = books.entries.shape

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error, _ = books.search(matrix(batch.column(2), parts * dims))
            packed = [row.tobytes() for row in code.astype(np.uint8)]
            yield pa.RecordBatch.from_pydict(
                {"vec_id": batch.column(0), "label": batch.column(1), "code": pa.array(packed, pa.binary()), "error": pa.array(error.sum(axis=1))}
            )

    rows = usable_vectors(frame, parts, parts * dims)
    kinds = dict(rows.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long"
    return rows.mapInArrow(coded, schema)


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """Adds `decoded`, the integer vector that a code stands for."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.arange(books.entries.shape[0])
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, len(parts))
            whole = books.entries[parts, codes].reshape(len(codes), -1)
            yield batch.append_column("decoded", pa.array(list(whole), pa.list_(pa.int64())))

    kept = codes.select([c for c in codes.columns if c != "decoded"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(back, f"{fields}, decoded array<long>")


def compress(frame: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Codes of all usable vectors with their error, the error of their label and the codebooks' digest.

    frame has vec_id, embedding (array of numbers) and label; other columns are
    left aside. Which vectors are usable is told at `usable_vectors`; the others
    have no row, and an empty table gives none. Repeated rows stay as often as
    they come. Null labels are one label. An error of a label beyond 64 bits is
    null. At most 256 entries, as a code has a byte for each part.
    """
    if not 0 < entries <= 256:
        raise ValueError(f"entries must be 1 to 256, not {entries}")
    books = train(frame, parts, entries, rounds)
    if books is None:
        kept = usable_vectors(frame, parts).limit(0)
        return kept.select(
            "vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"),
            F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"),
        )
    done = durable(encode(frame, books), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    # The decimal's bounds are checked by hand: a plain cast would fail the job.
    labels = done.groupBy(F.col("label").alias("_label")).agg(total.alias("_sum"))
    fits = F.when(F.col("_sum") <= F.lit(Decimal(2**63 - 1)), F.col("_sum").cast("long"))
    return done.join(labels, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "label", "code", "error", fits.alias("label_error"), F.lit(books.sha256()).alias("codebooks_sha256")
    )
