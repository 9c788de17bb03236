"""Users' columns keep their values, null ids follow one rule, and one hot input doesn't stop an operator."""

import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, minhash, mixing, secrets, sharding

HELPERS = [
    "_h", "_key", "_n", "_copies", "_copy", "_size", "_part", "_order", "_block", "_rank", "_least", "_most", "_sum", "_rows",
    "_more", "_start", "doc", "id", "text_key", "key", "nth", "copies", "copy", "size", "least", "more", "cells", "component_id",
    "kept", "rows", "grp", "part", "set_key", "n_shingles", "a.b", "we`ird", "tab le",
]


def corpus(spark):
    rng = random.Random(8)
    texts = {k: " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(6, 30))) for k in range(60)}
    rows = [(k, t, ["a", "b", None][k % 3]) for k, t in texts.items()]
    rows += [(100 + k, texts[k], "b") for k in range(10)]  # copies
    rows += [(None, texts[0], "a"), (None, "only here and nowhere else at all", "a"), (None, None, None)]
    rows += [(5, texts[5], ["a", "b", None][2])]  # a repeated row
    names = [f"`{c.replace('`', '``')}` string" for c in HELPERS]
    data = [(*r, *[f"{c}:{i}" for c in HELPERS]) for i, r in enumerate(rows)]
    return rows, spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(names))


def whole(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_near_duplicates_keep_columns_and_null_ids(spark):
    rows, docs = corpus(spark)
    out = minhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    left, given = whole(out), whole(docs)
    assert all(given[r] >= n for r, n in left.items())
    ids = Counter(r[0] for r in left.elements())
    # Copies go, whether they have an id or not; what is there once stays, with an id or not.
    assert ids == Counter([*range(60), None, None])
    assert {r[1] for r in left if r[0] is None} == {"only here and nowhere else at all", None}
    placed = minhash.near_duplicates(docs.select("doc_id", "text"))
    assert placed.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    # Both functions agree: rows of one id and text count once.
    kept = {(r["doc_id"], r["n_shingles"]) for r in placed.where("kept").collect()}
    assert len(kept) == 62 and sum(ids.values()) == 62


def test_one_id_with_two_texts_is_two_documents(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(20)) for x in "ab")
    docs = spark.createDataFrame([(1, a, "x"), (2, a, "y"), (2, b, "z"), (2, b, "v")], "doc_id long, text string, lang string")
    kept = minhash.drop_near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(1, a), (2, b)])


def test_mixing_keeps_columns(spark):
    _, docs = corpus(spark)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    given, taken = whole(docs), whole(out)
    assert taken and all(r in given and n <= 2 * given[r] for r, n in taken.items())
    assert whole(mixing.mix_documents(docs.repartition(7, F.rand(3)))) == taken


def test_mixing_tells_rows_without_id_apart_by_text(spark):
    """Rows alike in id, source and size: reruns take the same texts, in whatever order they come."""
    docs = spark.createDataFrame([(None, f"one two t{k}", "a") for k in range(40)] + [(1, "x " * 90, "b")], "doc_id long, text string, source string")
    first = whole(mixing.mix_documents(docs))
    for seed in (1, 2):
        assert whole(mixing.mix_documents(docs.repartition(5, F.rand(seed)))) == first


def test_shards_keep_columns(spark):
    _, docs = corpus(spark)
    out = sharding.shuffle_into_shards(docs, 4)
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert whole(out.drop("shard", "slot")) == whole(docs)
    replaced = sharding.shuffle_into_shards(docs.withColumn("slot", F.lit("old")), 4)
    assert dict(replaced.dtypes)["slot"] == "bigint"


# --- secrets ---------------------------------------------------------------------------


def test_many_known_spans_are_merged(spark):
    rng = random.Random(3)
    lines = [f"{rng.getrandbits(160):040x}  file{k}.bin" for k in range(200_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "plain words only")], "doc_id long, text string")
    start = time.time()
    rows = {r["doc_id"]: r for r in secrets.find_secrets(docs).select("doc_id", secrets.count_kind("base", "hex").alias("n")).collect()}
    assert rows[1]["n"] == 200_000 and rows[2]["n"] == 0
    assert time.time() - start < 120


def test_candidates_beside_overlapping_known_spans(spark):
    """A candidate is left out exactly where a known span touches it, nested and crossing ones included."""
    rng = random.Random(4)
    token = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    text = " ".join(
        rng.choice([f"password={token(20)}", f"secret: AKIA{token(16)}", f"{rng.getrandbits(80):020x}", token(32), "word", f"key {token(40)}"])
        for _ in range(300)
    )
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = secrets.scan(docs, secrets.background(docs), 0.12, 1e9, 0.0).first()  # lets every free candidate through
    known = [(s["start"], s["end"]) for s in row["base"]]
    free = [m.span() for m in re.finditer(secrets.CANDIDATE, text) if not any(a < m.end() and m.start() < b for a, b in known)]
    assert known and free and [(s["start"], s["end"]) for s in row["open"]] == free
    assert len(free) < row["tested"]


# --- decontamination -------------------------------------------------------------------


def brute_matches(docs, items, least=0.5):
    found = set()
    for doc, text in docs:
        for item, words in items:
            vocabulary = {w: k for k, w in enumerate(sorted(set(words.split())), 1)}
            x = np.array([vocabulary[w] for w in words.split()])
            y = np.array([vocabulary.get(w, 0) for w in text.split()])
            score, _ = decontaminate.align(x, y)
            if score >= least:
                found.add((doc, item, round(score, 9)))
    return found


def test_items_with_shared_preambles(spark):
    """Items share preambles of several lengths and common tails; texts repeat them, with and without edits."""
    rng = random.Random(12)
    long_, short_ = [f"p{k}" for k in range(12)], [f"q{k}" for k in range(8)]
    common = [f"c{k}" for k in range(6)]
    items = []
    for k in range(60):
        head = long_ if k % 2 else short_
        tail = [rng.choice(common) if rng.random() < 0.3 else f"u{k}x{j}" for j in range(20 - len(head))]
        items.append((k, " ".join(head + tail)))
    docs = [(1, " ".join(long_ * 40)), (2, " ".join(short_ * 50)), (3, " ".join((long_ + common) * 20 + short_))]
    for k in range(12):
        w = items[rng.randrange(60)][1].split()
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = "changed"
        docs.append((10 + k, " ".join(rng.choices(common, k=30) + w + long_[: rng.randrange(12)])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontaminate.contaminated(frame, bench).collect()}
    want = brute_matches(docs, items)
    assert got == want and len({d for d, _, _ in want}) > 5
    # In blocks of items, counted in one pass over the documents.
    again = decontaminate.contaminated(frame, bench, block_words=300)
    assert {(r["doc_id"], r["item_id"], round(r["score"], 9)) for r in again.collect()} == want


def test_hot_preamble_costs_little():
    """20,000 items with one preamble over a text of 300,000 words that repeats it."""
    import tracemalloc

    rng = random.Random(2)
    for share, hits in ((12, 20_000), (8, 0)):
        head = [f"p{k}" for k in range(share)]
        block = [(k, " ".join(head + [f"u{rng.randrange(10**6)}" for _ in range(20 - share)])) for k in range(20_000)]
        text = " ".join(head * (300_000 // share))
        counts = {f"p{k}": 25_000.0 for k in range(share)}
        scan = _scanner(block, counts)
        start = time.time()
        tracemalloc.start()
        (found,) = list(scan([text]))
        _, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert len(found) == hits and time.time() - start < 60
        assert peak < 1e9


def _scanner(block, counts):
    """A scanner without documents to count, the counts given."""
    buckets = np.zeros(decontaminate.Buckets().size)
    number = decontaminate.Buckets().number
    for w, n in counts.items():
        buckets[number(w.encode())] = n
    return decontaminate.Scanner(block, None, 0.5, 5, False, buckets)


def test_short_items_are_matched_whole_where_asked_for(spark):
    docs = spark.createDataFrame(
        [(1, "It is said: Yes, no! yes no"), (2, "no such thing"), (3, None), (4, ""), (5, "one two three four five six")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame(
        [(7, "yes no"), (8, "no"), (9, "..."), (10, None), (11, "yes no"), (12, "one two three four five six")],
        "item_id long, text string",
    )
    got = {tuple(r) for r in decontaminate.contaminated(docs, items, short=True).collect()}
    assert got == {
        (1, 7, 1.0, 3, 4, True), (1, 11, 1.0, 3, 4, True), (1, 8, 1.0, 4, 4, True), (2, 8, 1.0, 0, 0, True),
        (5, 12, 1.0, 0, 5, False),
    }
    assert decontaminate.contaminated(docs, items).columns == ["doc_id", "item_id", "score", "first_word", "last_word"]
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()} == {1, 2, 3, 4}
