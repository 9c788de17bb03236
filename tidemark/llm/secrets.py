"""Secret scans: known forms by pattern, unknown ones by a battery of randomness tests.

Every run of 16 or more letters, digits and the signs of base 64 is a candidate. Its
encoding is inferred as the smallest alphabet that holds it. Two questions follow.

Does it look random in that alphabet? Chi-squared test of uniform use, runs test
about the middle of the alphabet, serial correlation of neighbours. A candidate
that any of them rejects (Bonferroni over the three) is no secret.

Could it be ordinary text? The same three questions are put against the letters of
the whole corpus outside of candidates: how often each is used, how often text moves
between the halves of the alphabet, which letters follow each other. The likelihood
of the candidate as text over that as random letters is a p-value for text, as such a
ratio exceeds 1 / p with chance p at most. A fourth piece of evidence is how often the
candidate changes between capitals, small letters, digits and signs, which words, paths
and names rarely do. The least of the four is the p-value, each over its share of the
level: nine tenths for the changes, the rest for the letters, which tell far more a
character. Strings of one class of characters have three of them. Digits say nothing
by themselves.

Over all candidates of all documents the false discovery rate is controlled
(Benjamini-Hochberg), p-values weighted by length: a long string has more power, so it
gets more of the budget.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import durable

KINDS = ("assign", "access", "hex", "random")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The known forms, and least lengths of what they must hold.
_WORDS = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + f"|{_either('api')}_?{_either('key')}"
ASSIGN = rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
# Alphabets, smallest first.
ALPHABETS = (
    "0123456789",
    "0123456789abcdef",
    "0123456789ABCDEF",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "0123456789abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
)


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_p(x: float, free: int) -> float:
    """Upper tail, by the cube root's normal approximation."""
    if free <= 0:
        return 1.0
    spread = 2 / (9 * free)
    return 0.5 * math.erfc(((x / free) ** (1 / 3) - (1 - spread)) / math.sqrt(2 * spread))


def uniformity_p(places: list[int], size: int) -> float:
    """Chi-squared over equal stretches of the alphabet, five characters expected in each."""
    n = len(places)
    bins = max(2, min(size, n // 5))
    counts, expected = [0] * bins, [0.0] * bins
    for k in range(size):
        expected[k * bins // size] += n / size
    for k in places:
        counts[k * bins // size] += 1
    return chi_squared_p(sum((c - e) ** 2 / e for c, e in zip(counts, expected)), bins - 1)


def runs_p(places: list[int], size: int) -> float:
    """Runs of characters of the lower and of the upper half of the alphabet."""
    upper = [2 * k >= size for k in places]
    n, a = len(upper), sum(upper)
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    runs = 1 + sum(x != y for x, y in zip(upper, upper[1:]))
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    return two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial_p(places: list[int]) -> float:
    """Correlation of each character's place in the alphabet with the next one's."""
    n = len(places)
    mean = sum(places) / n
    off = [x - mean for x in places]
    var = sum(x * x for x in off)
    if not var:
        return 0.0
    r = sum(x * y for x, y in zip(off, off[1:])) / var
    return two_sided((r + 1 / n) * math.sqrt(n))


def alphabet_of(token: str) -> str:
    own = set(token)
    return next(a for a in ALPHABETS if own <= set(a))


def randomness_p(token: str) -> float:
    """Small if any test rejects that the token is uniformly random in its alphabet."""
    alphabet = alphabet_of(token)
    at = {c: k for k, c in enumerate(alphabet)}
    places = [at[c] for c in token]
    size = len(alphabet)
    return min(1.0, 3 * min(uniformity_p(places, size), runs_p(places, size), serial_p(places)))


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def language_p(token: str, rate: float) -> float:
    """Chance that ordinary text of this length changes its kind of character so often: a binomial tail."""
    kinds = [_class(c) for c in token]
    n, t = len(kinds) - 1, sum(x != y for x, y in zip(kinds, kinds[1:]))
    if t == 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log(1 - rate) for k in range(t, n + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in log))


# Letters, any other character being one more; pseudo-counts of a row of pairs, so
# that a corpus of a few hundred letters says next to nothing.
LETTERS = 26
PRIOR = 676.0
CHANGES = 0.9  # of the level, for changes of class
_FOLD = np.full(256, LETTERS, np.uint16)
for _k in range(LETTERS):
    _FOLD[ord("a") + _k] = _FOLD[ord("A") + _k] = _k


def folded(text: str) -> np.ndarray:
    """Letters as numbers without case, one number for all else."""
    return _FOLD[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


class Background:
    """How ordinary text uses letters, from the counts of pairs of neighbours, LETTERS standing for all else."""

    def __init__(self, pairs: np.ndarray):
        letters = pairs[:LETTERS].sum(axis=1) + pairs[:, :LETTERS].sum(axis=0)
        self.single = (letters + PRIOR / LETTERS) / (letters.sum() + PRIOR)
        inner = pairs[:LETTERS, :LETTERS]
        self.next = (inner + PRIOR * self.single) / (inner.sum(axis=1, keepdims=True) + PRIOR)
        self.known: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def ratios(self, alphabet: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logs of text over random letters of the alphabet: of a letter, of a letter's half after another, of a pair.

        Nothing is said where a character is no letter.
        """
        if alphabet not in self.known:
            own = np.unique(folded(alphabet))
            own = own[own < LETTERS].astype(np.int64)
            n = len(own)
            use, runs, pairs = np.zeros(LETTERS + 1), np.zeros((LETTERS + 1,) * 2), np.zeros((LETTERS + 1,) * 2)
            if n:
                single = self.single[own] / self.single[own].sum()
                follow = self.next[np.ix_(own, own)]
                follow = follow / follow.sum(axis=1, keepdims=True)
                use[own], pairs[np.ix_(own, own)] = np.log(single * n), np.log(follow * n)
                half = 2 * np.arange(n) >= n
                for x in (False, True):
                    for y in (False, True):
                        if (half == x).any() and (half == y).any():
                            text = single[half == x] @ follow[np.ix_(half == x, half == y)].sum(axis=1)
                            text /= single[half == x].sum() * (half == y).mean()
                            runs[np.ix_(own[half == x], own[half == y])] = math.log(text)
            self.known[alphabet] = use, runs, pairs
        return self.known[alphabet]

    def text_p(self, token: str) -> tuple[float, float, float]:
        """Chances that ordinary text has letters, runs and neighbours as random as those of the token."""
        use, runs, pairs = self.ratios(alphabet_of(token))
        at = folded(token)
        a, b = at[:-1], at[1:]
        first = use[at[:1]].sum()  # no letter before it
        # A letter after another character starts anew.
        fresh = first + use[b[a == LETTERS]].sum()
        return tuple(math.exp(min(0.0, x)) for x in (use[at].sum(), runs[a, b].sum(), fresh + pairs[a, b].sum()))


def background(docs: DataFrame) -> Background:
    """The letters of all texts outside of candidates."""
    side = LETTERS + 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        candidate, counts = re.compile(CANDIDATE), np.zeros(side * side, np.int64)
        for batch in batches:
            for text in batch["text"]:
                at = folded(candidate.sub(" ", text or ""))
                counts += np.bincount(at[:-1] * side + at[1:], minlength=side * side)
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"pair": seen, "n": counts[seen]})

    counts = np.zeros(side * side)
    for pair, n in docs.select("text").mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        counts[pair] = n
    return Background(counts.reshape(side, side))


def text_p(token: str, letters: Background, rate: float) -> float:
    """Chance that ordinary text looks as random as the token: the least of four, each over its share of the level."""
    return min(1.0, language_p(token, rate) / CHANGES, *(3 * p / (1 - CHANGES) for p in letters.text_p(token)))


_SPAN = "array<struct<start: int, kind: int, end: int>>"
FOUND = (
    f"doc_id long, base {_SPAN}, tested long, letters long, "
    "open array<struct<start: int, end: int, length: int, log_p: double>>"
)


def scan(docs: DataFrame, letters: Background, rate: float, level: float, reject: float) -> DataFrame:
    """Known spans of each document, its candidates counted, and those that may be secrets."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        assign, access, hexes, candidate = (re.compile(x) for x in (ASSIGN, ACCESS, HEX, CANDIDATE))
        for batch in batches:
            rows = []
            for doc, text in batch.itertuples(index=False, name=None):
                text = text or ""
                base = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
                base += [(m.start(), 1, m.end()) for m in access.finditer(text)]
                base += [(m.start(), 2, m.end()) for m in hexes.finditer(text)]
                base.sort()
                starts = [a for a, _, _ in base]
                ends = list(accumulate((b for _, _, b in base), max))
                tested = size = 0
                open_ = []
                for m in candidate.finditer(text):
                    token = m[0].rstrip("=")
                    tested += 1
                    size += len(token)
                    before = bisect_left(starts, m.end())  # known spans that begin before its end
                    if before and ends[before - 1] > m.start():
                        continue
                    p = text_p(token, letters, rate)
                    # No weight lets more than level * length / 16 through.
                    if p > level * len(token) / 16:
                        continue
                    if randomness_p(token) >= reject:
                        open_.append((m.start(), m.end(), len(token), math.log10(max(p, 1e-300))))
                rows.append((doc, base, tested, size, open_))
            yield pd.DataFrame(rows, columns=["doc_id", "base", "tested", "letters", "open"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(search, FOUND)


def find_secrets(docs: DataFrame, *, level: float = 0.01, reject: float = 0.01, rate: float = 0.12) -> DataFrame:
    """(doc_id, base, spans): arrays of struct<start, kind, end>, kinds numbered as in KINDS, code points, end exclusive.

    base holds the known forms, spans those and the random strings that overlap none
    of them. `level` is the false discovery rate over all documents, `reject` the
    level of the randomness battery, `rate` how often ordinary text changes its kind
    of character. One row for each row of docs; null texts are empty; ids may be null
    or repeated; other columns are ignored.
    """
    found = durable(scan(docs, background(docs), rate, level, reject), "secrets")
    total = found.agg(F.sum("tested").alias("m"), F.sum("letters").alias("n")).first()
    m, mean = total["m"] or 0, (total["n"] or 0) / max(total["m"] or 0, 1)
    # Weighted p-values in steps of a fiftieth of a power of ten, rounded up: a short table, whatever the input.
    step = 50
    weighted = F.col("o.log_p") - F.log10(F.col("o.length") / F.lit(max(mean, 1.0)))
    table = (
        found.select(F.explode("open").alias("o"))
        .groupBy(F.greatest(F.lit(0), F.floor(-weighted * step)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    cut, rank = None, 0
    for row in sorted(table, key=lambda r: -r["bin"]):
        rank += row["n"]
        if 10 ** (-row["bin"] / step) <= level * rank / max(m, 1):
            cut = row["bin"]

    def passes(o):
        bin_ = F.floor(-(o["log_p"] - F.log10(o["length"] / F.lit(max(mean, 1.0)))) * step)
        return bin_ >= F.lit(cut) if cut is not None else F.lit(False)

    random = F.transform(
        F.filter("open", passes),
        lambda o: F.struct(o["start"].alias("start"), F.lit(3).alias("kind"), o["end"].alias("end")),
    )
    return found.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def spans_text(spans):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
