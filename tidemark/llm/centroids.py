"""Centroid clustering with heaps of bounds.

A vector has an upper bound of the distance to its own centroid and a lower bound
of that to any other. While the gap between them is above zero its centroid can't
change. When centroids move, the gap of all vectors of cluster j shrinks by at
most the way j went plus the longest way another went. So nothing is written to
the vectors: each cluster keeps one accumulated drift and a heap of gaps, each
offset by the drift at the time it was taken. A round pops gaps that the drift has
reached, scans those vectors exactly against all centroids and pushes them anew;
the others are not looked at, and only vectors that change cluster alter the sums
the centroids come from. Bounds are rounded to the safe side and a gap of zero
counts as expired, so ties go to the smaller number exactly.

Vectors are packed once into blocks of a few thousand, in a table bucketed by block.
A block's heaps are a row of a second table with the same buckets, written each
round at 12 bytes a vector, so both meet without a shuffle and every round starts
from written data. Sums of changes come back to the driver, one row a cluster.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from tidemark.llm.common import durable, remove, shared_folder
from tidemark.llm.vectors import integers, matrix, reach_of, usable

BLOCK = 4096
_UP, _DOWN, _SLACK = 1 + 1e-12, 1 - 1e-12, 1e-9

BLOCKS = "block long, ids array<long>, vectors binary"
CHANGE = "array<struct<cluster: int, n: long, total: array<long>>>"
STATE = f"block long, heaps binary, changes {CHANGE}, scanned long"


class Heaps:
    """For each cluster a heap of (gap plus drift when taken, vector's place in the block)."""

    def __init__(self, clusters: int):
        self.of = [[] for _ in range(clusters)]

    @classmethod
    def from_bytes(cls, raw: bytes, clusters: int) -> Heaps:
        self = cls(clusters)
        sizes = np.frombuffer(raw, "<i4", clusters)
        n = int(sizes.sum())
        keys = np.frombuffer(raw, "<f8", n, 4 * clusters).tolist()
        places = np.frombuffer(raw, "<i4", n, 4 * clusters + 8 * n).tolist()
        ends = np.cumsum(sizes).tolist()
        self.of = [list(zip(keys[e - s : e], places[e - s : e])) for s, e in zip(sizes.tolist(), ends)]
        return self

    def to_bytes(self) -> bytes:
        # A heap's list keeps its order, so it is a heap again when read.
        sizes = np.array([len(h) for h in self.of], "<i4")
        keys = np.array([k for h in self.of for k, _ in h], "<f8")
        places = np.array([i for h in self.of for _, i in h], "<i4")
        return sizes.tobytes() + keys.tobytes() + places.tobytes()

    def pop_expired(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and clusters of the vectors whose gap the drift may have used up."""
        places, clusters = [], []
        for j, heap in enumerate(self.of):
            limit = drift[j] + _SLACK * (1 + drift[j])
            while heap and heap[0][0] <= limit:
                places.append(heapq.heappop(heap)[1])
                clusters.append(j)
        return np.array(places, np.int64), np.array(clusters, np.int64)

    def push(self, places: np.ndarray, clusters: np.ndarray, keys: np.ndarray) -> None:
        for i, j, key in zip(places.tolist(), clusters.tolist(), keys.tolist()):
            heapq.heappush(self.of[j], (key, i))

    def assignment(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int32)
        for j, heap in enumerate(self.of):
            out[[i for _, i in heap]] = j
        return out


def distances(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centers."""
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centers).max(initial=0)))
    if most * most * 4 * vectors.shape[1] < 2**52:  # all products and sums are whole numbers that doubles hold
        x, c = vectors.astype(np.float64), centers.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centers], axis=1)


def advance(vectors: np.ndarray, heaps: Heaps | None, centers: np.ndarray, drift: np.ndarray):
    """Bring a block up to date with the centers; heaps None: nothing known yet.

    Returns the heaps, the places looked at, and their clusters before (-1: none) and now.
    """
    if heaps is None:
        heaps = Heaps(len(centers))
        places = np.arange(len(vectors))
        before = np.full(len(vectors), -1, np.int64)
    else:
        places, before = heaps.pop_expired(drift)
    if not len(places):
        return heaps, places, before, before
    d = distances(vectors[places], centers)
    now = d.argmin(axis=1)  # the first of equal ones
    upper = np.sqrt(d[np.arange(len(d)), now]) * _UP
    d[np.arange(len(d)), now] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(axis=1)) * _DOWN
    heaps.push(places, now, lower - upper + drift[now])
    return heaps, places, before, now


def _changes(vectors: np.ndarray, places: np.ndarray, before: np.ndarray, now: np.ndarray, clusters: int) -> list[dict]:
    """What vectors that changed cluster add to and take from the clusters' counts and sums."""
    moved = before != now
    places, before, now = places[moved], before[moved], now[moved]
    n, total = np.zeros(clusters, np.int64), np.zeros((clusters, vectors.shape[1]), np.int64)
    np.add.at(n, now, 1)
    np.add.at(total, now, vectors[places])
    had = before >= 0
    np.subtract.at(n, before[had], 1)
    np.subtract.at(total, before[had], vectors[places[had]])
    touched = np.union1d(now, before[had])
    return [{"cluster": int(j), "n": int(n[j]), "total": total[j].tolist()} for j in touched]


class _Tables:
    """Tables bucketed by block, in the shared folder; kept in the catalog while in use."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.home = f"{shared_folder(spark)}/llm/centroids-{uuid.uuid4().hex}"
        self.names: dict[str, str] = {}

    def write(self, frame: DataFrame, tag: str) -> DataFrame:
        name = self.names[tag] = f"llm_centroids_{tag}_{uuid.uuid4().hex}"
        writer = frame.write.format("parquet").bucketBy(self.buckets, "block").sortBy("block")
        writer.option("path", f"{self.home}/{tag}").saveAsTable(name)
        return self.spark.table(name)

    def drop(self, tag: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(tag)}")
        remove(self.spark, f"{self.home}/{tag}")

    def close(self) -> None:
        for tag in list(self.names):
            self.drop(tag)
        remove(self.spark, self.home)


def usable_vectors(frame: DataFrame, dims: int) -> DataFrame:
    """(vec_id, v): integer vectors of `dims` components.

    Left out are null vectors, other lengths, those with a null, NaN or infinite
    component, and those with a component of 2^22 / dims or more in size, whose
    distances 64 bits can't hold.
    """
    vector = F.col("embedding")
    kept = frame.filter(vector.isNotNull() & (F.size(vector) == dims)).filter(usable(vector, reach_of(dims)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), integers(vector).alias("v"))


def first_centers(kept: DataFrame, clusters: int, salt: int) -> np.ndarray:
    """The vectors whose salted ids have the smallest hashes, in that order.

    Null ids come last; of equal ids the smaller vector comes first.
    """
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(hashed.asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _packed(kept: DataFrame, dims: int, size: int) -> DataFrame:
    """Blocks of up to `size` vectors of one split each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = count(TaskContext.get().partitionId() << 32)

        def block(ids: list, rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([next(serial)], pa.int64()),
                    "ids": pa.array([ids], pa.list_(pa.int64())),
                    "vectors": pa.array([rows.astype("<i4").tobytes()], pa.binary()),
                }
            )

        ids, rows = [], np.empty((0, dims), np.int64)
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows = np.concatenate([rows, matrix(batch.column(1), dims)])
            while len(ids) >= size:
                yield block(ids[:size], rows[:size])
                ids, rows = ids[size:], rows[size:]
        if ids:
            yield block(ids, rows)

    return kept.mapInArrow(pack, BLOCKS)


def _vectors(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(-1, dims).astype(np.int64)


def _round(blocks: DataFrame, state: DataFrame | None, centers: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The state of all blocks after an assignment."""
    clusters, dims = centers.shape

    def step(block: int, raw: bytes, heaps: bytes | None) -> pd.DataFrame:
        vectors = _vectors(raw, dims)
        known = None if heaps is None else Heaps.from_bytes(heaps, clusters)
        known, places, before, now = advance(vectors, known, centers, drift)
        changes = _changes(vectors, places, before, now, clusters)
        return pd.DataFrame(
            {"block": [block], "heaps": [known.to_bytes()], "changes": [changes], "scanned": [len(places)]}
        )

    if state is None:
        return blocks.select("block", "vectors").groupBy("block").applyInPandas(
            lambda rows: step(int(rows["block"][0]), rows["vectors"][0], None), STATE
        )
    return _meet(blocks.select("block", "vectors"), state).applyInPandas(
        lambda rows, had: step(int(rows["block"][0]), rows["vectors"][0], had["heaps"][0]), STATE
    )


def _meet(blocks: DataFrame, state: DataFrame):
    return blocks.groupBy("block").cogroup(state.select("block", "heaps").groupBy("block"))


def _result(blocks: DataFrame, state: DataFrame, centers: np.ndarray, drift: np.ndarray) -> DataFrame:
    clusters, dims = centers.shape

    def finish(rows: pd.DataFrame, had: pd.DataFrame) -> pd.DataFrame:
        vectors = _vectors(rows["vectors"][0], dims)
        heaps, _, _, _ = advance(vectors, Heaps.from_bytes(had["heaps"][0], clusters), centers, drift)
        cluster = heaps.assignment(len(vectors))
        away = vectors - centers[cluster]
        ids = pd.array([None if pd.isna(i) else int(i) for i in rows["ids"][0]], "Int64")
        return pd.DataFrame({"vec_id": ids, "cluster": cluster, "distance": (away * away).sum(1)})

    return _meet(blocks, state).applyInPandas(finish, "vec_id long, cluster int, distance long")


def cluster(
    frame: DataFrame, clusters: int = 40, rounds: int = 5, dims: int = 64, salt: int = 2, block: int = BLOCK,
    log: list[int] | None = None,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of all usable vectors.

    frame has vec_id and embedding; other columns are left aside. Which vectors
    are usable is told at `usable_vectors`; the others have no row, and an empty
    table gives none. Repeated rows count as often as they come. With fewer than
    `clusters` vectors each of them starts a cluster. `log` gets the number of
    vectors scanned in each round.
    """
    spark = frame.sparkSession
    kept = usable_vectors(frame, dims)
    centers = first_centers(kept, clusters, salt)
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centers):
        empty = spark.createDataFrame([], schema)
        done = kept.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return done.join(empty, "cluster").select("vec_id", "cluster", "distance", *empty.columns[1:])
    tables = _Tables(spark)
    try:
        packed = _packed(kept, dims, block).repartition(tables.buckets, "block")
        blocks = tables.write(packed, "blocks")
        n, total = [0] * len(centers), [[0] * dims for _ in centers]
        drift, state = np.zeros(len(centers)), None
        for r in range(rounds):
            state = tables.write(_round(blocks, state, centers, drift), f"state{r}")
            if r:
                tables.drop(f"state{r - 1}")
            if log is not None:
                log.append(state.agg(F.sum("scanned")).first()[0])
            for change in _summed(state, dims):
                j = change["cluster"]
                n[j] += int(change["n"])
                total[j] = [t + int(change[f"t{k}"]) for k, t in enumerate(total[j])]
            moved = np.array([[t // n[j] for t in total[j]] if n[j] else centers[j] for j in range(len(centers))], np.int64)
            drift = drift + _drift(centers, moved)
            centers = moved
        if state is None:
            state = tables.write(_round(blocks, None, centers, drift), "state0")
        done = durable(_result(blocks, state, centers, drift), "clusters")
    finally:
        tables.close()
    # One row a cluster.
    sums = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    whole = sum(int(r["s"]) for r in sums)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    about = [Row(r["cluster"], int(r["s"]), whole, digest[r["cluster"]]) for r in sums]
    return done.join(F.broadcast(spark.createDataFrame(about, schema)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _summed(state: DataFrame, dims: int) -> list[Row]:
    """Changes of all blocks, a row a cluster."""
    rows = state.select(F.explode("changes").alias("c")).select("c.*")
    exact = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"t{k}") for k in range(dims)]
    return rows.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect()


def _drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much the gap of a cluster's vectors can have shrunk, at most."""
    way = np.sqrt(((new - old) ** 2).sum(1)) * _UP
    longest = np.sort(way)[::-1]
    other = np.where(way == longest[0], longest[1] if (way == longest[0]).sum() == 1 and len(way) > 1 else longest[0], longest[0])
    return way + (other if len(way) > 1 else 0.0)
