"""Null and repeated ids, ties and very long texts in the corpus operators, and evidence that the methods act."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import blocks, codes, minhash, recompression, secrets, syncmers, toxicity, warc
from tidemark.llm.vectors import integers


def docs_of(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_substring_dedup_of_null_ids_and_long_texts(spark):
    """Null ids come before all others; of one id the smaller text comes first."""
    rng = random.Random(5)
    noise = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage, long_ = noise(40), noise(150_000)
    rows = [(1, f"a {passage}"), (None, f"b {passage}"), (None, f"c {noise(5)} {passage}"), (2, long_), (3, noise(3) + long_[-4000:])]
    rows += [(4, passage), (4, passage), (-5, f"z {passage}"), (None, None), (6, None)]
    seen, want = set(), Counter()
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        w, gone = split(text), set()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone.update(range(i, i + 20))
            seen.add(key)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    frame = docs_of(spark, rows).withColumns({"block": F.lit("b"), "packed": F.lit(1)})
    got = Counter(tuple(r) for r in recompression.remove_repeats(frame).drop("kept").collect())
    assert got == want


def test_blocks_are_cut_by_bytes(spark):
    """A few long texts among many short ones: blocks hold about equal bytes, in order of ids, whatever the bounds."""
    rng = random.Random(1)
    rows = [(3 * k, "x" * (20_000 if 400 <= k < 440 else rng.randrange(100))) for k in range(3000)] + [(None, "y" * 50)] * 5
    frame = docs_of(spark, rows)
    for least, most in ((8, 1 << 20), (1, 40_000), (64, 1 << 30)):
        block, n = blocks.block_of(frame, "doc_id", "text", least, most)
        got = frame.select("doc_id", F.octet_length("text").alias("n"), block.alias("b")).collect()
        total, held = sum(r["n"] for r in got), Counter()
        for r in got:
            held[r["b"]] += r["n"]
        assert set(held) <= set(range(n)) and n >= min(least, 40)
        wanted = max(least, -(-total // most))
        assert max(held.values()) <= total / wanted + 65_000  # and a fine bin at most
        ordered = sorted((r["doc_id"], r["b"]) for r in got if r["doc_id"] is not None)
        assert [b for _, b in ordered] == sorted(b for _, b in ordered)
        assert {r["b"] for r in got if r["doc_id"] is None} == {0}
    assert blocks.block_of(frame.limit(0), "doc_id", "text", 4, 100)[1] == 1
    assert blocks.block_of(docs_of(spark, [(7, "a")] * 9), "doc_id", "text", 4, 1)[1] <= 2


def test_cuts():
    rng = random.Random(2)
    for _ in range(50):
        sizes = {k: rng.randrange(1, 100) for k in range(rng.randrange(1, 60))}
        n = rng.randrange(1, 12)
        ends = blocks.cuts(sizes, n)
        assert ends == sorted(set(ends)) and len(ends) <= n and all(0 <= e < max(sizes) or len(sizes) == 1 for e in ends)
        parts = np.split([sizes[k] for k in sorted(sizes)], [e + 1 for e in ends])
        assert max(p.sum() for p in parts) <= sum(sizes.values()) / n + 2 * 100


def test_bounds_in_two_steps(spark):
    frame = spark.range(-3, 60).select(F.col("id").alias("doc_id")).unionByName(docs_of(spark, [(None,)], "doc_id long"))
    for bounds in ([], [5], [0, 7, 8, 20], list(range(0, 50, 3))):
        got = {r[0]: r[1] for r in frame.select("doc_id", blocks._behind("doc_id", bounds)).collect()}
        assert got == {k: sum(k is not None and k > b for b in bounds) for k in got}


def like(a, b, m=64):
    """The share of the m smallest hashes of both fingerprints together that both hold."""
    x, y = (set(re.findall("[0-9a-f]{10}", f)) for f in (a, b))
    if not x and not y:
        return 1.0
    least = sorted(x | y)[:m]
    return len([h for h in least if h in x and h in y]) / len(least)


def test_likeness_against_brute_force(spark):
    """near_edited and near_next of all rows, in descending order of ids with ties by the text's hash, nulls last."""
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("abcdefgh é\U0001f600") for _ in range(n))
    base = noise(9000)
    rows = [(k, noise(rng.choice([0, 3, 11, 12, 13, 200, 2500]))) for k in range(40)]
    rows += [(50, base), (51, base[:4000] + noise(200) + base[4000:]), (52, base), (None, noise(300)), (None, base[:6000]), (7, rows[7][1]), (8, "twin")]
    frame = docs_of(spark, rows).withColumns({"_h": F.lit(1), "_block": F.lit(2), "fingerprint": F.lit("x")})
    keyed = frame.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(keyed, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), -r["h"]))
    got = syncmers.compare_edited(frame.select("doc_id", "text")).collect()
    assert len(got) == len(rows)
    prints = {}
    for r in got:
        assert r["near_edited"] == like(r["fingerprint"], r["edited_fingerprint"])
        prints[r["edited_sha256"], r["doc_id"]] = r
    for k, r in enumerate(order):
        text, follows = r["text"], order[(k + 1) % len(order)]["text"]
        third = len(text) // 3
        edited = text[: len(text) - third] + follows[:third]
        row = prints[hashlib.sha256(edited.encode()).hexdigest(), r["doc_id"]]
        other = next(x for x in got if x["doc_id"] == order[(k + 1) % len(order)]["doc_id"] and x["n_chars"] == len(follows))
        assert row["near_next"] == like(row["fingerprint"], other["fingerprint"])


def test_secrets_of_null_ids_and_long_texts(spark):
    text = "word " * 300_000 + "password = 'Tr0ub4dor&3xyzQWE' " + "f00d" * 10
    rows = [(None, text), (None, None), (1, ""), (1, "AKIA" + "Z" * 16), (1, "AKIA" + "Z" * 16)]
    found = secrets.find_secrets(docs_of(spark, rows).withColumns({"base": F.lit(1), "spans": F.lit(2)})).collect()
    assert Counter(r["doc_id"] for r in found) == Counter({None: 2, 1: 3})
    long_ = next(r for r in found if len(r["base"]) == 1 and r["base"][0]["kind"] == 2)
    assert long_["doc_id"] is None and long_["base"][0]["end"] == len(text)
    assert sum(len(r["base"]) for r in found if r["doc_id"] == 1) == 2


def test_near_duplicates_of_long_texts(spark):
    rng = random.Random(9)
    w = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    edited = list(w)
    for k in range(0, len(w), 1000):
        edited[k] = "changed"
    rows = [(1, " ".join(w)), (2, " ".join(edited)), (3, " ".join(w[:60_000])), (None, " ".join(w)), (4, "again " * 100_000), (5, "again again again again again")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert got[2][1] == got[None][1] == 1 and got[3][1] == 3
    assert got[4] == (1, 4) and got[5] == (1, 4)


def test_warc_of_null_ids(spark):
    rows = [(None, "u", "same"), (None, "v", "same"), (3, "w", "same"), (2, None, "same"), (None, "x", "alone"), (None, "y", None)]
    got = warc.archive_pages(docs_of(spark, rows, "page_id long, url string, html string")).collect()
    kinds = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == Counter(
        {(None, 4, "revisit", 2): 2, (3, 4, "revisit", 2): 1, (2, 4, "response", None): 1, (None, 5, "response", None): 1, (None, 0, "response", None): 1}
    )


def test_toxicity_of_null_ids_and_two_labels(spark):
    rng = random.Random(3)
    filler = lambda: " ".join(f"w{rng.randrange(60)}" for _ in range(15))
    rows = [(k, filler() + (" idiot scum" if k % 2 else "")) for k in range(200)] + [(None, "idiot scum " + filler()), (None, None), (5, rows_text := filler())]
    labels = [(k, k % 2) for k in range(200)] + [(5, 0), (6, None), (None, 1), (777, 1)]
    docs = docs_of(spark, rows)
    model = toxicity.train(docs, docs_of(spark, labels, "doc_id long, toxic int"))
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(0.0 <= r["score"] <= 1.0 for r in got)
    assert sum(r["predicted"] for r in got if r["doc_id"] is None) == 1 and rows_text


def test_counterfactuals_lower_false_positives(spark):
    """One group of several is named in nine toxic texts of ten and in no clean one: a plain fit flags whoever names it."""
    rng = random.Random(21)
    name = toxicity.IDENTITIES[3][0]
    insults = ["".join(rng.choice("bcdfghjk") + rng.choice("aeiou") for _ in range(4)) for _ in range(15)]
    filler = lambda: " ".join(f"w{rng.randrange(80)}" for _ in range(14))
    rows, labels = [], []
    for k in range(1200):
        toxic = k % 3 == 0
        named = toxic and rng.random() < 0.9
        rows.append((k, f"{filler()} {name if named else ''} {rng.choice(insults) if toxic else ''} {filler()}"))
        labels.append((k, int(toxic)))
    neutral = [(10_000 + k, f"{filler()} {name} {filler()}") for k in range(200)]
    docs, marks = docs_of(spark, rows), docs_of(spark, labels, "doc_id long, toxic int")
    flagged, right = {}, {}
    for fairness in (0.0, 10.0):
        model = toxicity.train(docs, marks, fairness=fairness)
        flagged[fairness] = sum(r["predicted"] for r in toxicity.score_documents(docs_of(spark, neutral), model).collect())
        scored = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, model).where("held_out").collect()}
        right[fairness] = np.mean([p == int(k % 3 == 0) for k, p in scored.items()])
    print("false positives of 200", flagged, "right", right)
    assert flagged[0.0] >= 150 and flagged[10.0] <= 5
    assert right[10.0] > 0.97


def test_share_of_entries_looked_at(spark):
    """On the given embeddings the search leaves out entries, with the codebooks trained on them."""
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    books = codes.train(frame)
    x = np.array([r[0] for r in frame.select(integers(F.col("embedding"))).collect()])
    looked = books.search(x)[2] / (len(x) * 16 * 64)
    print("entries looked at", looked)
    assert looked < 0.8
