"""Benchmark decontamination: gapped pairs of words find candidates, local alignment scores them.

A copy scores the share of the best possible alignment (Smith-Waterman over words), so
copies with changed, dropped or added words count as well. With L words in the item, M
of them matched and E edits between them, 2 M - E >= 2 `least` L. Of the M - 1 pairs of
matches that follow each other at most E / 2 have two edits or more between them, so at
least `least` L - 1 have none or one: the pair stands next to each other or one word
apart, in the item and in the text. All matches of the copy lie on diagonals (place in
the text less place in the item) that differ by E <= 2 (1 - `least`) L at most.

So an item's seeds are its pairs of words at distance one and two, and a stretch of text
is a candidate where enough of them fall on near diagonals. The places whose pairs are
commonest in the documents are left out of an item's seeds, and as many hits less are
asked for: whatever is left out, no copy is lost, at any size of the corpus. Candidates
are aligned with the item and scored. Items that differ only in words which the texts at
hand don't hold are searched and aligned as one, so a preamble that many items share costs
what it costs for one item; hits are followed in portions of bounded size.

Test items are read in blocks of bounded size; each block goes to every task, each
document meets all blocks, and documents aren't shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import word_count
from tidemark.llm.words import mix, split

MATCH, MISS, GAP = 2, -1, -1
FOUND = "doc_id long, item_id long, score double, first_word int, last_word int, short boolean"
_EDGE = ".,;:!?\"'()[]{}<>|*_-"
_EDGE_BYTES = _EDGE.encode()


def plain_word(word: bytes) -> str:
    """A word without case and without marks at its ends."""
    return word.decode("utf-8", "surrogatepass").strip(_EDGE).lower()


class Numbers:
    """Words as numbers of a vocabulary of plain words, 0 for any other word; bare marks are left out.

    Remembers a bounded number of words.
    """

    def __init__(self, vocabulary: dict[str, int], most: int = 400_000):
        self.vocabulary = {w.encode("utf-8", "surrogatepass"): k for w, k in vocabulary.items()}
        self.known: dict[bytes, int] = {}
        self.most = most

    def number(self, word: bytes) -> int:
        # As plain_word(), without decoding what is ASCII.
        plain = word.strip(_EDGE_BYTES)
        plain = plain.lower() if plain.isascii() else plain_word(plain).encode("utf-8", "surrogatepass")
        return self.vocabulary.get(plain, 0) if plain else -1

    def text(self, text: str | None) -> np.ndarray:
        words = split(text)
        numbers = np.fromiter(map(self.known.get, words, repeat(-2)), np.int64, len(words))
        for i in np.flatnonzero(numbers == -2).tolist():
            word = words[i]
            numbers[i] = self.known[word] = self.number(word)
        if len(self.known) > self.most:
            self.known.clear()
        return numbers[numbers >= 0]


def block_count(items: DataFrame, block_words: int) -> int:
    """How many blocks of about block_words words the items fill."""
    total = items.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    return max(1, math.ceil(total / block_words))


def item_blocks(items: DataFrame, blocks: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks, one after the other."""
    slot = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        yield [tuple(r) for r in items.where(slot == k).select("item_id", "text").where("text IS NOT NULL").collect()]


class Buckets(Numbers):
    """Words as numbers of hash buckets, all alike in a bucket; bare marks are left out."""

    def __init__(self, bits: int = 20):
        super().__init__({})
        self.size = 1 << bits

    def number(self, word: bytes) -> int:
        import xxhash

        plain = plain_word(word)
        return xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass")) % self.size if plain else -1


def word_counts(docs: DataFrame, numbers: Numbers, size: int) -> np.ndarray:
    """How often each number comes up in all docs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 100):
                some = [numbers.text(text) for text in batch["text"].iloc[at : at + 100]]
                counts += np.bincount(np.concatenate(some), minlength=size)
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"word": seen, "n": counts[seen]})

    rows = docs.select("text").mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect()
    counts = np.zeros(size)
    for word, n in rows:
        counts[word] = n
    return counts


class Seeds:
    """The seeds of a block of items: sorted hashes of pairs of words, with the item and the place of each."""

    def __init__(self, items: list[np.ndarray], share: np.ndarray, least: float):
        sizes = [len(names) for names in items]
        self.need = np.zeros(len(items), np.int64)  # hits of an item at least
        self.drift = np.array([int(2 * (1 - least) * n + 1e-9) + 1 for n in sizes], np.int64)  # diagonals of a copy
        rows = []
        for k, names in enumerate(items):
            sure = math.ceil(least * len(names) - 1 - 1e-9)
            if sure < 1:  # so short that one word may be enough
                self.need[k] = 1
                rows += [(self._hash(names, 0), np.full(len(names), k), np.arange(len(names)))]
                continue
            freq = share[names]
            pairs = freq[:-1] * (freq[1:] + np.append(freq[2:], 0.0))
            out = sure // 2
            self.need[k] = sure - out
            at = np.sort(np.argsort(pairs, kind="stable")[: len(pairs) - out])
            far = at[at + 2 < len(names)]
            for places, step in ((at, 1), (far, 2)):
                rows.append((self._hash(names[places], names[places + step]), np.full(len(places), k), places))
        values, owner, place = (np.concatenate(x) if rows else np.empty(0, np.int64) for x in (zip(*rows) if rows else [()] * 3))
        order = np.lexsort((values, owner))
        # Entries lie together by item; `value` is the number of an entry's seed among the distinct ones.
        self.values, value = np.unique(values[order].astype(np.uint64), return_inverse=True)
        self.value, self.owner, self.place = value.ravel(), owner[order], place[order]
        self.first = np.searchsorted(self.owner, np.arange(len(items) + 1))
        self.bits = np.uint64((1 << max(20, (16 * len(values)).bit_length())) - 1)
        self.sieve = np.zeros(int(self.bits) + 1, bool)
        self.sieve[(self.values & self.bits).astype(np.int64)] = True
        self.single = bool((self.need == 1).any())
        # The items' words, to see which items are alike as far as a text knows their words.
        self.words = np.concatenate(items) if items else np.empty(0, np.int64)
        self.begin = np.append(0, np.cumsum(sizes)).astype(np.int64)

    @staticmethod
    def _hash(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        """Of a pair of words, or of one word where the second is 0. Numbers of words are below 2^32: no two are alike."""
        return mix((a.astype(np.uint64) << np.uint64(32)) + np.asarray(b).astype(np.uint64))

    def hits(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each hit the place in the text and the number of the seed, ordered by seed."""
        found = []
        at = np.flatnonzero(names > 0)
        for step in (1, 2, 0) if self.single else (1, 2):
            p = at[at + step < len(names)]
            p = p[names[p + step] > 0]
            h = self._hash(names[p], names[p + step] if step else 0)
            some = self.sieve[(h & self.bits).astype(np.int64)]
            p, h = p[some], h[some]
            v = np.searchsorted(self.values, h)
            known = v < len(self.values)
            known[known] = self.values[v[known]] == h[known]
            found.append((p[known], v[known]))
        place, value = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(value, kind="stable")
        return place[order], value[order]

    def candidates(self, names: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Items that the hits may suffice for: one for each class of items alike, and the members of the classes.

        count: hits of each seed. Items of one length that differ only in words the
        texts don't hold score alike everywhere, so one of them is searched for all.
        """
        seen = count[self.value] > 0
        some = np.flatnonzero(np.bincount(self.owner[seen], minlength=len(self.need)) >= self.need)
        if not len(some):
            return some, []
        present = np.zeros(int(max(self.words.max(initial=0), names.max(initial=0))) + 1, bool)
        present[names] = True
        size = self.begin[some + 1] - self.begin[some]
        upto = np.cumsum(size)
        nth = np.arange(upto[-1]) - np.repeat(upto - size, size)
        words = self.words[np.repeat(self.begin[some], size) + nth]
        words = np.where(present[words], words, 0).astype(np.uint64)
        alike = np.add.reduceat(mix(mix(words + np.uint64(1)) ^ nth.astype(np.uint64)), upto - size)
        _, one, back = np.unique(np.stack([alike, size.astype(np.uint64)], axis=1), axis=0, return_index=True, return_inverse=True)
        back = back.ravel()
        members = np.split(some[np.argsort(back, kind="stable")], np.cumsum(np.bincount(back))[:-1])
        order = np.argsort(one)
        return some[one[order]], [members[k] for k in order.tolist()]

    def regions(self, names: np.ndarray, starts: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each class of items that may have a copy: its members, and rows (text, first diagonal, last diagonal), ordered.

        names: texts one after the other, two words 0 behind each; starts: where each
        begins. Items are followed some at a time, with about `most` hits.
        """
        place, value = self.hits(names)
        count = np.bincount(value, minlength=len(self.values))
        begin = np.append(0, np.cumsum(count))
        ones, members = self.candidates(names, count)
        entries = [np.arange(self.first[k], self.first[k + 1]) for k in ones.tolist()]
        weight = np.cumsum([count[self.value[e]].sum() for e in entries]) if entries else np.empty(0)
        at = 0
        while at < len(ones):
            upto = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + most, "right")))
            rows = self._stretches(place, begin, count, np.concatenate(entries[at:upto]), starts)
            for k, own in zip(range(at, upto), np.split(rows, np.searchsorted(rows[:, 1], ones[at + 1 : upto]))):
                if len(own):
                    yield members[k], own[:, [0, 2, 3]]
            at = upto

    def _stretches(self, place, begin, count, entries, starts) -> np.ndarray:
        """Rows (text, item, first diagonal, last diagonal) of the stretches that may hold a copy, ordered by item."""
        n = count[self.value[entries]]
        rows = np.repeat(begin[self.value[entries]] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        place, item, at = place[rows], np.repeat(self.owner[entries], n), np.repeat(self.place[entries], n)
        text = np.searchsorted(starts, place, "right") - 1
        # Buckets of diagonals as wide as a copy's drift: its matches lie in two that follow each other.
        drift = self.drift[item]
        bucket = (place - starts[text] - at) // drift
        least = int(bucket.min(initial=0))
        span = int(bucket.max(initial=0)) - least + 2
        code = (item * len(starts) + text) * span + bucket - least
        # First by counts of hits, then by distinct places of the item.
        keep = self._enough(code, item)
        code, at = code[keep], at[keep]
        order = np.lexsort((at, code))
        code, at = code[order], at[order]
        code = code[np.append(True, (code[1:] != code[:-1]) | (at[1:] != at[:-1]))[: len(code)]]
        code = np.unique(code[self._enough(code, code // span // len(starts))])
        text, item, bucket = code // span % len(starts), code // span // len(starts), code % span + least
        drift = self.drift[item]
        return np.stack([text, item, (bucket - 1) * drift, (bucket + 2) * drift], axis=1)

    def _enough(self, code: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which rows lie in a bucket that has enough of them together with the one before or behind it."""
        own, back, n = np.unique(code, return_inverse=True, return_counts=True)
        next_ = np.append(own[1:] == own[:-1] + 1, False)[: len(own)]
        beside = np.zeros(len(own), np.int64)
        beside[:-1] = np.where(next_[:-1], n[1:], 0)
        beside[1:] = np.maximum(beside[1:], np.where(next_[:-1], n[:-1], 0))
        return (n + beside)[back] >= self.need[item]


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """The best local alignment's share of the full score, and the end of it in the text."""
    n = len(text)
    row, steps = np.zeros(n + 1), -GAP * np.arange(n + 1)
    best, end = 0.0, 0
    for word in item:
        step = np.where(text == word, MATCH, MISS)
        fresh = np.maximum(np.append(0.0, row[:-1] + step), row + GAP)
        fresh = np.maximum(fresh, 0.0)
        row = np.maximum.accumulate(fresh + steps) - steps  # gaps in the item, of any length
        at = int(row.argmax())
        if row[at] > best:
            best, end = float(row[at]), at
    return best / (MATCH * len(item)), end


def best_place(names: np.ndarray, item: np.ndarray, regions: np.ndarray, least: float) -> tuple[float, int, int] | None:
    """(score, first word, last word) of the item's best place in a text, if it scores `least` or more.

    regions: rows (first diagonal, last diagonal), ordered; those that overlap are aligned as one.
    """
    best = None
    joined: list[list[int]] = []
    for low, high in regions.tolist():
        high += len(item)
        if joined and low <= joined[-1][1]:
            joined[-1][1] = high
        else:
            joined.append([low, high])
    for low, high in joined:
        low = max(0, low)
        score, end = align(item, names[low:high])
        if score >= least and score > (best[0] if best else 0.0):
            _, back = align(item[::-1], names[low : low + end][::-1])
            best = (score, low + end - back, low + end - 1)
    return best


class ShortItems:
    """Items of a few words, found as whole runs of words."""

    def __init__(self, items: list[np.ndarray]):
        by_size: dict[int, list[int]] = {}
        for k, names in enumerate(items):
            by_size.setdefault(len(names), []).append(k)
        self.of = {}
        for size, own in by_size.items():
            keys = np.array([self._runs(items[k], size)[0] for k in own], np.uint64)
            order = np.argsort(keys, kind="stable")
            self.of[size] = (keys[order], np.array(own)[order])

    @staticmethod
    def _runs(names: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(max(0, len(names) - size + 1), np.uint64)
        for k in range(size):
            out = mix(out ^ names[k : k + len(out)].astype(np.uint64)) + np.uint64(k)
        return out

    def __call__(self, names: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, 1.0, first word, last word) of the first place of each item in a text."""
        found = []
        for size, (keys, own) in self.of.items():
            seen, first = np.unique(self._runs(names, size), return_index=True)
            low, high = np.searchsorted(keys, seen), np.searchsorted(keys, seen, "right")
            for k in np.flatnonzero(high > low).tolist():
                found += [(int(i), 1.0, int(first[k]), int(first[k]) + size - 1) for i in own[low[k] : high[k]]]
        return sorted(found)


class Scanner:
    """Finds the items of one block in texts; made on the driver, used in tasks."""

    def __init__(
        self, block: list[tuple[int, str]], docs: DataFrame, least: float, min_words: int, short: bool, buckets: np.ndarray | None
    ):
        named = [(i, [w for w in map(plain_word, split(t)) if w]) for i, t in block]
        named = [(i, x) for i, x in named if len(x) >= (1 if short else min_words)]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, x in named for w in x}), 1)}
        numbered = [(i, np.array([self.vocabulary[w] for w in x], np.int64)) for i, x in named]
        whole = [(i, x) for i, x in numbered if len(x) >= min_words]
        few = [(i, x) for i, x in numbered if len(x) < min_words]
        self.ids, self.items = [i for i, _ in whole], [x for _, x in whole]
        self.short_ids, self.short = [i for i, _ in few], ShortItems([x for _, x in few])
        self.least, self.seeds = least, None
        if whole:
            size = len(self.vocabulary) + 1
            if buckets is None:
                counts = word_counts(docs, Numbers(self.vocabulary), size)
            else:  # all words of the documents, counted once for all blocks
                of = Buckets().number
                counts = np.append(0.0, buckets[[of(w.encode("utf-8", "surrogatepass")) for w in self.vocabulary]])
            share = np.maximum(counts, 1) / max((counts if buckets is None else buckets).sum(), 1)
            self.seeds = Seeds(self.items, share, least)

    def __call__(self, texts: Iterable[str | None], together: int = 300_000) -> Iterator[list[tuple]]:
        """For each text the (item_id, score, first_word, last_word, short) found; texts are searched some at a time."""
        numbers, held, size = Numbers(self.vocabulary), [], 0
        for text in texts:
            held.append(numbers.text(text) if self.vocabulary else np.empty(0, np.int64))
            size += len(held[-1]) + 2
            if size >= together:
                yield from self._search(held)
                held, size = [], 0
        yield from self._search(held)

    def _search(self, held: list[np.ndarray]) -> list[list[tuple]]:
        starts = np.append(0, np.cumsum([len(x) + 2 for x in held])).astype(np.int64)
        found: list[list[tuple]] = [[] for _ in held]
        if self.seeds is not None and len(held):
            # Two words 0 between texts, over which no pair reaches.
            names = np.concatenate([y for x in held for y in (x, np.zeros(2, np.int64))])
            for members, rows in self.seeds.regions(names, starts):
                for text in np.unique(rows[:, 0]).tolist():
                    own = rows[np.searchsorted(rows[:, 0], text) : np.searchsorted(rows[:, 0], text, "right"), 1:]
                    best = best_place(held[text], self.items[members[0]], own, self.least)
                    if best:
                        found[text] += [(k, *best) for k in members.tolist()]
        return [
            [(self.ids[k], *x, False) for k, *x in sorted(some)] + [(self.short_ids[k], *x, True) for k, *x in self.short(names)]
            for some, names in zip(found, held)
        ]


def scanners(docs, items, *, least=0.5, min_words=5, block_words=1_000_000, short=False) -> Iterator[Scanner]:
    buckets, blocks = None, block_count(items, block_words)
    if blocks > 1:
        counter = Buckets()
        buckets = word_counts(docs, counter, counter.size)
    for block in item_blocks(items, blocks):
        yield Scanner(block, docs, least, min_words, short, buckets)


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word, short) of every test item found in a document.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Options:
    `least` is the score asked for, items with fewer than `min_words` words are left out
    since any text may hold them, unless `short` asks for their first whole place in each
    text, marked in the column short; `block_words` bounds what of the items is sent to
    the tasks at a time. Without `short` that column is left out.
    Words count without case and without marks at their ends. Null texts hold nothing,
    null ids are returned as they are, repeated rows each give theirs, and of equal
    items each is found. Empty tables give an empty one.
    """
    out = None
    for scan in scanners(docs, items, **options):

        def search(batches: Iterator[pd.DataFrame], scan: Scanner = scan) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(doc, *x) for doc, found in zip(batch["doc_id"], scan(batch["text"])) for x in found]
                frame = pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "first_word", "last_word", "short"])
                yield frame.astype({"doc_id": "Int64", "item_id": "Int64", "short": bool})

        part = docs.select("doc_id", "text").mapInPandas(search, FOUND)
        out = part if out is None else out.unionByName(part)
    return out if options.get("short") else out.drop("short")


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the rows that hold a test item; all columns stay as they are."""
    for scan in scanners(docs, items, **options):

        def clean(batches: Iterator, scan: Scanner = scan) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                # One text at a time: a batch of long texts is not held twice.
                keep = [not found for found in scan(t.as_py() for t in batch.column("text"))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
