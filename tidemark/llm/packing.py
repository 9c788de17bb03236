"""Best-fit-decreasing packing of tokenised documents into sequences of fixed capacity.

Which bins best fit opens and fills depends on the lengths alone. So the lengths
are counted, and the plan is made from at most `capacity` counts: lengths in falling
order go to the tightest open bin that holds them, which a segment tree over
remaining capacities finds in logarithmic time. Pieces of one length and bins of one
remaining capacity are placed in runs; a run ends as many placements of single
documents would. The plan has a size set by the capacity, not by the data, and every
piece finds its place in it by its length and its rank among the pieces of that length.
Ranks are counted in blocks of rows, so a length that most pieces share is no hot key.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import durable

CAPACITY = 2048
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids binary"
_BLOCK_BITS = 16
_RANK_BITS = 44


# How a tokenizer file that keeps words apart normalises and splits.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_SPLIT = {
    "type": "Split",
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}
_SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def keeps_words_apart(settings: dict) -> bool:
    """Whether a tokenizer's ids of a text are those of its words one after another, in lower case or not."""
    normal = [n["type"] for n in (settings.get("normalizer") or {}).get("normalizers", [])]
    split = ((settings.get("pre_tokenizer") or {}).get("pretokenizers") or [None])[0]
    tied = any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] for t in settings["added_tokens"])
    return normal == _NORMAL and split == _SPLIT and not tied and not settings.get("post_processor")


def _byte_letters() -> dict[int, str]:
    """How byte-level models write each byte: printable signs as they are, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds(dict):
    """A word (bytes without ASCII blanks) -> its token ids as bytes, remembered for a bounded number of words.

    For a tokenizer that keeps words apart: it drops blanks, and lower-cases what
    isn't a special token. A word of small Latin letters is one piece to its model;
    signs that follow it are another. All other words go through the whole tokenizer.
    """

    def __init__(self, tokenizer, most: int = 500_000):
        super().__init__()
        self.tokenizer, self.model, self.most = tokenizer, tokenizer.model, most
        self.letters = _byte_letters()

    def of(self, text: str) -> np.ndarray:
        raw = text.encode("utf-8", "surrogatepass")
        words = (raw if b"<|" in raw else raw.lower()).split()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u4")

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        core = word.rstrip(_SIGNS)
        piece = self._piece(core)
        if piece is None:
            ids = self._ids(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
        elif len(core) < len(word):
            ids = self[core] + self[word[len(core) :]]
        else:
            ids = self._ids([t.id for t in self.model.tokenize(piece)])
        self[word] = ids
        return ids

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _piece(self, core: bytes) -> str | None:
        """The model's piece for a word of small Latin letters, which no normalisation changes."""
        if core.isascii():
            return core.decode() if core.isalpha() and core.islower() else None
        text = core.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "\u0250" and text.lower() == text:
            return core.decode("latin-1").translate(self.letters)
        return None


class WholeTexts:
    """Token ids of whole texts by any tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def of(self, text: str) -> np.ndarray:
        text = text.encode("utf-8", "replace").decode()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def open_tokenizer(file: str) -> WordIds | WholeTexts:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(file, encoding="utf-8") as f:
        settings = json.load(f)
    tokenizer = Tokenizer.from_file(file)
    return WordIds(tokenizer) if keeps_words_apart(settings) else WholeTexts(tokenizer)


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids) of whole texts: token ids and an `end` id, cut after each `capacity` ids.

    docs has doc_id and text; other columns are left aside. tokenizer names a file
    of the tokenizers library that every executor can read; its special tokens
    count as such in a text.
    A null text is an empty one and gives the end alone. Null and repeated ids keep their rows.
    ids are unsigned 32-bit little-endian numbers.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = open_tokenizer(tokenizer)
        last = np.array([end], "<u4")
        for batch in batches:
            out, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([words.of(text.as_py() or ""), last])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    some = ids[at : at + capacity]
                    out.append((doc, k, at, len(some), some.tobytes()))
                held += 4 * len(ids)
                if held > 8 << 20:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class OpenBins:
    """Runs of equal bins by remaining capacity, under a segment tree that knows where there are any."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int) -> None:
        at = self.leaves + room
        self.any[at] = bool(self.runs[room])
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def put(self, room: int, first: int, bins: int) -> None:
        self.runs[room].append((first, bins))
        self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._mark(room)
        return run

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least `length` that an open bin has."""
        at = self.leaves + length
        if self.any[at]:
            return length
        while at > 1:  # up until a right neighbour holds any, then down to its left end
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """The plan: (length, first rank, pieces a bin, first bin, offset) for each run of placements.

    The pieces of a length with ranks from the first on go to consecutive bins, so
    many a bin, at the offset and behind each other. counts has the number of pieces
    by length, 1 to capacity.
    """
    bins, plan, made = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1 to {capacity}")
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room, fit = capacity, capacity // length
                first, run = made, -(-left // fit)
                made += run
            else:
                first, run = bins.take(room)
                fit = room // length
            # The tightest bin stays the tightest until the length no longer fits, so it is filled first.
            whole = min(run, left // fit)
            if whole:
                plan.append((length, rank, fit, first, capacity - room))
                bins.put(room - fit * length, first, whole)
                rank, left, first, run = rank + whole * fit, left - whole * fit, first + whole, run - whole
            if run and left:
                plan.append((length, rank, left, first, capacity - room))
                bins.put(room - left * length, first, 1)
                left, first, run = 0, first + 1, run - 1
            if run:
                bins.put(room, first, run)
    return plan


def _places(plan: list[tuple[int, int, int, int, int]]):
    """A column function: length, rank -> sequence and offset."""
    rows = np.array(sorted(plan), np.int64).reshape(-1, 5)
    starts = (rows[:, 0] << _RANK_BITS) | rows[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        run = rows[np.searchsorted(starts, (length << _RANK_BITS) | rank, side="right") - 1]
        nth = rank - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 3] + nth // run[:, 2], "offset": run[:, 4] + nth % run[:, 2] * length})

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """pieces with sequence_id and offset: their place by best-fit decreasing.

    Every row with a length of 1 to capacity gets a place; others, null among them,
    fail with a message. All columns of pieces are kept with their values; sequence_id
    and offset must not be among them. Repeated rows are pieces of their own. An empty
    table gives an empty result. Which of equally long pieces takes which place depends
    on the order of rows in the written table; how many sequences there are, and how
    full they are, does not.
    """
    if {"sequence_id", "offset"} & set(pieces.columns):
        raise ValueError("pieces must have no columns sequence_id and offset")
    given = F.struct(*[F.col(f"`{c}`") for c in pieces.columns])
    rows = durable(
        pieces.select(given.alias("given"), F.col(f"`{length}`").cast("long").alias("len"), F.monotonically_increasing_id().alias("row")),
        "pieces",
    )
    block = F.shiftright("row", _BLOCK_BITS).alias("block")
    counts = durable(rows.groupBy("len", block).agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    totals = {r["len"]: r["n"] for r in counts.groupBy("len").agg(F.sum("n").alias("n")).limit(capacity + 2).collect()}
    if any(size is None or not 0 < size <= capacity for size in totals):
        raise ValueError(f"every length must be 1 to {capacity}")
    before = Window.partitionBy("len").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("len", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("len", "block").orderBy("row")) - 1
    ranked = rows.withColumn("block", block).withColumn("within", within).join(ahead, ["len", "block"])
    place = _places(best_fit(totals, capacity))
    placed = ranked.select("given", place("len", F.col("ahead") + F.col("within")).alias("at"))
    return placed.select("given.*", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed pieces' ids joined by sequence, as binary."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined: Column = F.aggregate("rows", F.lit(b""), lambda all_, r: F.concat(all_, r["ids"]))
    grouped = packed.groupBy("sequence_id").agg(rows.alias("rows"), F.sum("length").alias("length"))
    return grouped.select("sequence_id", "length", joined.alias("ids"))
