"""Substring dedup by recompression.

A text is a sequence of symbols, first its words. Each round renames runs of one
symbol and then pairs of a left and a right symbol (a bit of the symbol's name
decides which it is), so the sequence shrinks. A new name is a hash of the round
and of what it stands for: every task gives equal passages equal names without a
shared dictionary, which would have to be shuffled once a round.

What a symbol is depends on its own words and on a few symbols next to it. Where
all of those lie inside a window of `width` words, every copy of that window holds
the same symbol at the same place. Each window therefore has a key that depends on
its words alone: the highest of the symbols it decides, then the longest, then the
one of the least name. Windows that share no key with any other block of documents
aren't repeated there. Those that do are compared by a hash of their own words.

Two exchanges of sorted lists between blocks of documents do that, first of keys,
then of the windows behind shared keys. Texts are shuffled once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.blocks import LISTS, block_of, gather, shared, spread
from tidemark.llm.words import Names, mix, split, windows

ROUNDS = 3
#: Text of a block at most, unless one id has more.
BLOCK_BYTES = 16 << 20
DEDUPED = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


class Level:
    """Symbols with the words they span [start, end) and those that decide them [low, high)."""

    def __init__(self, name, start, end, low, high):
        self.name, self.start, self.end, self.low, self.high = name, start, end, low, high

    def runs(self, r: int) -> Level:
        """Runs of one symbol renamed. That a symbol is alone is decided by its neighbours too."""
        n = len(self.name)
        first = np.flatnonzero(np.append(True, self.name[1:] != self.name[:-1]))
        last = np.append(first[1:], n) - 1
        many = last > first
        name = self.name[first]
        length = (last - first + 1).astype(np.uint64)
        name = np.where(many, mix(name * np.uint64(0xD6E8FEB86659FD93) + length + np.uint64(2 * r)), name)
        low = self.low[np.maximum(first - 1, 0)].copy()
        high = self.high[np.minimum(last + 1, n - 1)].copy()
        # The end of the sequence is nothing that a window could see.
        low[first == 0] = -1
        high[last == n - 1] = self.end[-1] + 1
        return Level(name, self.start[first], self.end[last], low, high)

    def pairs(self, r: int) -> Level:
        """A left symbol and a right one after it become one symbol."""
        n = len(self.name)
        side = (mix(self.name + np.uint64(0xA0761D6478BD642F * (r + 1) & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
        joins = np.append(~side[:-1] & side[1:], False)
        head = np.append(True, ~joins[:-1])
        at = np.flatnonzero(head)
        two = joins[at]
        end = at + two
        name = self.name[at]
        name = np.where(
            two, mix(name * np.uint64(0xE7037ED1A0B428DB) + mix(self.name[end] + np.uint64(2 * r + 1))), name
        )
        # Alone, a left symbol has seen the next one and a right symbol the one before.
        before = np.where(two | ~side[at], at, np.maximum(at - 1, 0))
        after = np.where(two | side[at], end, np.minimum(at + 1, n - 1))
        low = np.minimum(self.low[at], self.low[before])
        high = np.maximum(self.high[end], self.high[after])
        low[~two & side[at] & (at == 0)] = -1
        high[~two & ~side[at] & (at == n - 1)] = self.end[-1] + 1
        return Level(name, self.start[at], self.end[end], low, high)


def levels(names: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    at = np.arange(len(names), dtype=np.int64)
    out = [Level(names, at, at + 1, at, at + 1)]
    for r in range(rounds):
        out.append(out[-1].runs(r).pairs(r))
    return out


def window_keys(names: np.ndarray, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """The key of each window of `width` words; equal windows have equal keys."""
    n = len(names) - width + 1
    none = np.uint64((1 << 64) - 1)
    keys = np.full(max(n, 0), none, np.uint64)
    if n <= 0:
        return keys
    for level in reversed(levels(names, rounds)):
        open_ = keys == none
        if not open_.any():
            break
        before = np.append(0, np.cumsum(open_))
        from_ = np.maximum(level.high - width, 0)
        to = np.minimum(level.low, n - 1) + 1  # exclusive
        use = np.flatnonzero((to > from_) & (level.low >= 0))
        use = use[before[to[use]] > before[from_[use]]]
        span = (to - from_)[use]
        window = np.repeat(from_[use] - np.append(0, np.cumsum(span)[:-1]), span) + np.arange(span.sum())
        length = np.minimum((level.end - level.start)[use], 31).astype(np.uint64)
        # Longer first, then by name; the key says both.
        key = ((np.uint64(31) - length) << np.uint64(59)) | (level.name[use] >> np.uint64(5))
        best = np.full(n, none, np.uint64)
        np.minimum.at(best, window, np.repeat(key, span))
        keys[open_] = best[open_]
    return mix(keys)  # spread evenly over all values, by which they are dealt out


class Block:
    """The documents of a block in order of id, their words end to end."""

    def __init__(self, frame: pd.DataFrame, width: int):
        frame = frame.sort_values(["doc_id", "text"], na_position="first", kind="stable", ignore_index=True)
        self.ids, named, self.width = frame["doc_id"], Names(), width
        self.words = [split(x) for x in frame["text"]]
        self.lengths = np.array([len(x) for x in self.words], np.int64)
        parts, ends = [], []
        for k, x in enumerate(self.words):
            parts += [named.of(x), np.array([k], np.uint64)]  # a name between documents that no window crosses
        self.names = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.starts = np.append(0, np.cumsum(self.lengths + 1)[:-1]).astype(np.int64)
        n = max(0, len(self.names) - width + 1)
        whole = np.zeros(n + 1, np.int32)
        for s, k in zip(self.starts, self.lengths):
            if k >= width:
                whole[s] += 1
                whole[s + k - width + 1] -= 1
        self.whole = np.cumsum(whole[:n]) > 0

    def keys(self) -> np.ndarray:
        """Keys of all window starts; those across documents are 0."""
        return np.where(self.whole, window_keys(self.names, self.width), np.uint64(0))

    def hashes(self) -> np.ndarray:
        return windows(self.names, self.width)


def remove_repeats(docs: DataFrame, *, width: int = 20, texts: bool = False) -> DataFrame:
    """docs (doc_id, text) without the words of repeated windows: DEDUPED, `kept` only if texts.

    A window is `width` consecutive words of one document. A word goes if a window
    that covers it also starts earlier, in a smaller doc_id or before it in its own
    document. Null texts have no words; null ids come before all others; of rows
    with one id, the smaller text comes first. Columns other than doc_id and text
    are ignored. Names and windows are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select("doc_id", "text")
    block, blocks = block_of(base, "doc_id", "text", 2 * parts, BLOCK_BYTES)
    # As many ranges of values, so that what meets in one stays bounded too.
    parts = max(parts, blocks // 2)
    dealt = base.withColumn("block", block)

    def keys(frame: pd.DataFrame) -> pd.DataFrame:
        found = np.unique(Block(frame, width).keys())
        return spread(int(frame["block"].iloc[0]), found[found != 0], parts)

    def behind(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(told):
            return spread(0, np.empty(0, np.uint64), parts)
        block, keyed = Block(frame, width), gather(told["packed"])
        own = block.keys()
        at = np.minimum(np.searchsorted(keyed, own), len(keyed) - 1)
        return spread(int(frame["block"].iloc[0]), np.unique(block.hashes()[(keyed[at] == own) & block.whole]), parts)

    def cut(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
        block, elsewhere = Block(frame, width), gather(told["packed"] if len(told) else [])
        start = np.flatnonzero(block.whole)
        value = block.hashes()[start]
        order = np.argsort(value, kind="stable")
        again = np.zeros(len(value), bool)
        again[order[1:]] = value[order[1:]] == value[order[:-1]]
        if len(elsewhere):
            at = np.minimum(np.searchsorted(elsewhere, value), len(elsewhere) - 1)
            again |= elsewhere[at] == value
        covered = np.zeros(len(block.names) + 1, np.int32)
        covered[start[again]] += 1
        np.subtract.at(covered, start[again] + width, 1)
        keep = np.cumsum(covered[:-1]) == 0
        rows = []
        for doc, words, s, n in zip(block.ids, block.words, block.starts, block.lengths):
            mask = keep[s : s + n]
            kept = b" ".join(words if mask.all() else [w for w, k in zip(words, mask) if k])
            digest = hashlib.sha256(kept).hexdigest()
            rows.append((doc, int(n), int(n - mask.sum()), digest, kept.decode("utf-8", "surrogatepass") if texts else None))
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
        return out.astype({"doc_id": "Int64"})

    grouped = dealt.groupBy("block")
    key_lists = grouped.applyInPandas(keys, LISTS)
    repeated = shared(key_lists, spare_first=False)
    window_lists = grouped.cogroup(repeated.groupBy("block")).applyInPandas(behind, LISTS)
    earlier = shared(window_lists, spare_first=True)
    return grouped.cogroup(earlier.groupBy("block")).applyInPandas(cut, DEDUPED)
