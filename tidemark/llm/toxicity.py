"""Toxicity scores from a linear model that is trained not to mind who is spoken of.

Features are the words of a document and their beginnings, as present or absent.
The features to weigh are chosen by a chi-squared test over the labelled documents.
Training adds counterfactuals: a document that names a group is copied with other
groups named in its place, and every change of the score that this makes is
penalised, so the weights of group names shrink unless nothing else explains the
labels.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import durable
from tidemark.llm.words import split

# Names of groups that can stand in each other's place.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "ladies", "gentlemen"),
    ("woman", "man", "girl", "boy", "lady", "gentleman"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "transgender", "queer"),
    ("black", "white", "asian", "african", "european", "american", "latino", "hispanic", "arab"),
    ("immigrants", "citizens", "refugees", "natives", "foreigners"),
    ("old", "young", "elderly"),
    ("blind", "deaf", "disabled", "healthy"),
)

HASHES = 1 << 20
_EDGE = ".,;:!?\"'()[]{}<>|*_-"


def held_out(doc_id: str = "doc_id") -> Column:
    """One row of five, by the crc32 of the id as text; null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def features(word: bytes) -> tuple[int, ...]:
    """The word and its beginnings of 4 to 8 letters, hashed."""
    plain = word.decode("utf-8", "surrogatepass").strip(_EDGE).lower()
    if not plain:
        return ()
    forms = {"=" + plain} | {plain[:n] for n in range(4, 9) if len(plain) >= n}
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % HASHES for x in forms)


class Reader:
    """Distinct features of a text among the chosen ones, by their number."""

    def __init__(self, chosen: np.ndarray | None = None, most: int = 100_000):
        self.number = None if chosen is None else {int(x): k for k, x in enumerate(chosen)}
        self.words: dict[bytes, tuple[int, ...]] = {}
        self.most = most

    def of_word(self, word: bytes) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= self.most:
                self.words.clear()
            found = features(word)
            if self.number is not None:
                found = tuple(self.number[x] for x in found if x in self.number)
            self.words[word] = found
        return found

    def __call__(self, text: str | None) -> list[int]:
        of_word, out = self.of_word, set()
        for word in set(split(text)):
            found = of_word(word)
            if found:
                out.update(found)
        return sorted(out)


def swapped(text: str | None, identities=IDENTITIES) -> list[list[bytes]]:
    """The words of a text with each group name replaced by the next, and by the one after that, in its list."""
    places = {w.encode(): (group, k) for group in identities for k, w in enumerate(group)}
    words = split(text)
    hits = {}
    for i, word in enumerate(words):
        found = places.get(word.lower().strip(_EDGE.encode()))
        if found:
            hits[i] = found
    if not hits:
        return []
    return [
        [hits[i][0][(hits[i][1] + shift) % len(hits[i][0])].encode() if i in hits else w for i, w in enumerate(words)]
        for shift in (1, 2)
    ]


class Model:
    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float):
        self.chosen, self.weights, self.bias = chosen, weights, bias

    def scorer(self):
        read = Reader(self.chosen)

        def score(text: str | None) -> float:
            z = self.bias + sum(self.weights[k] for k in read(text))
            return float(1 / (1 + np.exp(-z)))

        return score


def fit(
    rows: list[tuple[int, list[int], list[list[int]]]], n: int, *, ridge: float, fairness: float, steps: int = 300
) -> tuple[np.ndarray, float]:
    """Logistic regression over (label, features, features of the counterfactuals)."""
    y = np.array([r[0] for r in rows], float)
    col = np.array([k for r in rows for k in r[1]], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    # What each counterfactual changes: features that come (+1) or go (-1).
    d_row, d_col, d_sign, pairs = [], [], [], 0
    for _, own, others in rows:
        for other in others:
            for sign, gone in ((1.0, set(other) - set(own)), (-1.0, set(own) - set(other))):
                for k in gone:
                    d_row.append(pairs), d_col.append(k), d_sign.append(sign)
            pairs += 1
    d_row, d_col, d_sign = np.array(d_row, np.int64), np.array(d_col, np.int64), np.array(d_sign)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    w[n] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], minlength=len(y)) + w[n]
        error = 1 / (1 + np.exp(-z)) - y
        grad = np.append(np.bincount(col, error[row], minlength=n), error.sum()) / max(len(y), 1)
        grad[:n] += ridge * w[:n]
        if pairs:
            change = np.bincount(d_row, d_sign * w[d_col], minlength=pairs)
            grad[:n] += fairness * np.bincount(d_col, d_sign * change[d_row], minlength=n) / pairs
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:n], float(w[n])


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    max_rows: int = 20_000,
    max_features: int = 4096,
    ridge: float = 3e-4,
    fairness: float = 10.0,
    identities=IDENTITIES,
) -> Model:
    """Fit on at most max_rows labelled documents, those least in a hash of their id.

    labels: doc_id, toxic; of several labels of one id the largest holds, null ones
    don't count. Held-out ids are never read. Without a labelled document of each
    kind the model knows only the prior.
    """
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows ids: bounded, so it can go to every task and texts stay where they are.
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("_toxic", "text")
    labelled = durable(labelled.dropDuplicates(["_toxic", "text"]), "labelled")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, counts, totals = Reader(), (Counter(), Counter()), [0, 0]

        def told() -> pd.DataFrame:
            keys = list(set(counts[0]) | set(counts[1]))
            rows = {
                "feature": [-1, *keys],
                "clean": [totals[0], *(counts[0][k] for k in keys)],
                "toxic": [totals[1], *(counts[1][k] for k in keys)],
            }
            counts[0].clear(), counts[1].clear()
            totals[:] = [0, 0]
            return pd.DataFrame(rows)

        for batch in batches:
            for toxic, text in batch.itertuples(index=False, name=None):
                counts[int(toxic > 0)].update(read(text))
                totals[int(toxic > 0)] += 1
                if len(counts[0]) + len(counts[1]) > 200_000:  # bounds the task's memory
                    yield told()
        yield told()

    tallied = (
        labelled.mapInPandas(tally, "feature long, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    )
    names = sorted({x for group in identities for w in group for x in features(w.encode())})
    total = tallied.where("feature = -1").first()
    clean, toxic = (total["c"], total["t"]) if total else (0, 0)
    if not clean or not toxic:
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log((toxic + 0.5) / (clean + 0.5))))
    # Chi-squared of presence against label.
    n = F.lit(float(clean + toxic))
    seen = F.col("c") + F.col("t")
    gap = F.col("t") * F.lit(float(clean)) - F.col("c") * F.lit(float(toxic))
    chi2 = n * gap * gap / (F.lit(float(clean) * float(toxic)) * seen * F.greatest(n - seen, F.lit(1.0)))
    best = (
        tallied.where((F.col("feature") >= 0) & (seen >= 3) & (chi2 > 15.0))
        .orderBy(F.desc(chi2), "feature")
        .limit(max_features)
    )
    chosen = np.array(sorted({r["feature"] for r in best.collect()} | set(names)), np.int64)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Reader(chosen)
        for batch in batches:
            rows = []
            for toxic, text in batch.itertuples(index=False, name=None):
                others = [sorted({k for w in set(x) for k in read.of_word(w)}) for x in swapped(text, identities)]
                rows.append((int(toxic > 0), read(text), others))
            yield pd.DataFrame(rows, columns=["y", "x", "others"])

    # max_rows rows of the chosen features they have: bounded.
    encoded = labelled.mapInPandas(encode, "y int, x array<int>, others array<array<int>>").collect()
    rows = sorted((r["y"], list(r["x"]), [list(o) for o in r["others"]]) for r in encoded)
    weights, bias = fit(rows, len(chosen), ridge=ridge, fairness=fairness)
    return Model(chosen, weights, bias)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text). Null texts score as empty ones."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = model.scorer()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": [of(x) for x in batch["text"]]})

    return (
        docs.select("doc_id", "text")
        .mapInPandas(score, "doc_id long, score double")
        .select(
            "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
        )
    )


def drop_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs without the rows that score `least` or more; all columns stay as they are."""

    def clean(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of = model.scorer()
        for batch in batches:
            # One text at a time: a batch of long texts is not held twice.
            yield batch.filter(pa.array([of(x.as_py()) < least for x in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
