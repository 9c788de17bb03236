"""Packing, vector codes and clustering: against brute force, and on nulls, ties, empty and odd tables."""

import bisect
import functools
import hashlib
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import centroids, codes, packing, queries

FILE = public_tokenizers.path("word_bpe_49k.json")
NAN, INF = float("nan"), float("inf")

# --- packing ---------------------------------------------------------------------------


def one_by_one(lengths, capacity):
    """Best-fit decreasing, document by document: remaining capacities of all bins."""
    rooms = []
    for size in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, size)
        room = capacity if at == len(rooms) else rooms.pop(at)
        bisect.insort(rooms, room - size)
    return rooms


def filled(plan, counts, capacity):
    """Remaining capacities of the bins of a plan; every rank has one place, places have no gaps."""
    bins = defaultdict(list)
    for length, n in counts.items():
        runs = sorted(r for r in plan if r[0] == length)
        for k, (_, first_rank, fit, first, offset) in enumerate(runs):
            upto = runs[k + 1][1] if k + 1 < len(runs) else n
            for rank in range(first_rank, upto):
                nth = rank - first_rank
                bins[first + nth // fit].append((offset + nth % fit * length, length))
        assert runs[0][1] == 0
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
    return sorted(capacity - sum(length for _, length in held) for held in bins.values())


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=20), st.integers(40, 64))
def test_best_fit_is_that_of_single_documents(counts, capacity):
    plan = packing.best_fit(counts, capacity)
    lengths = [size for size, n in counts.items() for _ in range(n)]
    assert filled(plan, counts, capacity) == one_by_one(lengths, capacity)


def test_plan_does_not_grow_with_the_data():
    rng = random.Random(5)
    counts = {size: rng.randint(1, 50) for size in range(1, 2049)}
    more = {size: n * 1_000_000 for size, n in counts.items()}
    assert len(packing.best_fit(more)) < 60_000
    with pytest.raises(ValueError):
        packing.best_fit({0: 1})


def test_tightest_open_bin():
    bins = packing.OpenBins(100)
    assert bins.tightest(1) is None
    for room in (0, 7, 40, 100):
        bins.put(room, room, 1)
    assert [bins.tightest(x) for x in (1, 7, 8, 40, 41, 100)] == [7, 7, 40, 40, 100, 100]
    bins.take(40)
    assert bins.tightest(8) == 100


@functools.cache
def tokenizer():
    words = packing.open_tokenizer(FILE)
    assert isinstance(words, packing.WordIds)
    return words


BITS = list("aAbZ éÉİßΣσς'\t\n\x0b\x1c\x85 ,.!<|>-_09½ﬁ漢🙂́‍\x00") + [
    "<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'LL", "don't", "...", "\ud800",
]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=14).map("".join))
def test_words_one_by_one_give_the_ids_of_the_text(text):
    words = tokenizer()
    whole = text.encode("utf-8", "replace").decode() if "\ud800" in text else text
    if "\ud800" not in text:
        assert words.of(whole).tolist() == words.tokenizer.encode(whole, add_special_tokens=False).ids


def test_word_cache_is_bounded_and_other_tokenizers_see_whole_texts():
    words = packing.open_tokenizer(FILE)
    words.most = 50
    text = " ".join(f"word{k}, thing{k}." for k in range(200))
    assert words.of(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(words) <= 51
    other = packing.open_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert isinstance(other, packing.WholeTexts)
    assert other.of("a  b\n c").tolist() == other.tokenizer.encode("a  b\n c", add_special_tokens=False).ids
    with open(FILE, encoding="utf-8") as f:
        assert packing.keeps_words_apart(json.load(f))


DOCS = [
    (0, None), (1, ""), (2, " \t\n"), (3, "One two, three."), (3, "One two, three."), (None, "no id"), (4, "x " * 5000),
    (5, "long " * 2047), (6, "long " * 2048), (7, "a" * 30_000), (8, "é ü x\x0by\x1cz 'tis <|endoftext|> İ"),
] + [(20 + k, "word " * (k * 37 % 300)) for k in range(60)]


def test_documents_packed(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("row", F.lit("kept out"))
    packed = packing.pack(packing.tokenized_pieces(docs, FILE))
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    rows = packed.collect()
    tok = Tokenizer.from_file(FILE)
    want = defaultdict(int)
    for doc, text in DOCS:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[doc, k, at, tuple(ids[at : at + 2048])] += 1
    got = defaultdict(int)
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())] += 1
    assert got == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"], r["ids"]))
    assert sorted(2048 - sum(x[1] for x in b) for b in bins.values()) == one_by_one([r["length"] for r in rows], 2048)
    joined = {r["sequence_id"]: (r["length"], r["ids"]) for r in packing.sequences(packed).collect()}
    for b, held in bins.items():
        held.sort()
        at = 0
        for offset, length, _ in held:
            assert offset == at
            at += length
        assert joined[b] == (at, b"".join(x[2] for x in held))


def test_packing_keeps_user_columns_and_bad_lengths_are_told(spark):
    names = ["given", "len", "row", "block", "within", "ahead", "n"]
    rows = [(k % 3 + 1, *[k * 10 + j for j in range(len(names))]) for k in range(50)]
    schema = "length int, " + ", ".join(f"{n} int" for n in names)
    packed = packing.pack(spark.createDataFrame(rows, schema), 4)
    assert sorted(tuple(r)[: len(names) + 1] for r in packed.collect()) == sorted(rows)
    assert packing.pack(spark.createDataFrame([], schema), 4).count() == 0
    for bad in (0, 5, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(bad,)], "length int"), 4)
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 1)], "length int, offset int"), 4)


def test_packing_query(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op11_packing(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(FILE)
    want = sorted(
        (str(doc), at, zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes()))
        for doc, text in DOCS
        for ids in [tok.encode(text or "", add_special_tokens=False).ids + [0]]
        for at in range(0, len(ids), 2048)
    )
    assert sorted((str(r["doc_id"]), r["start"], r["ids_crc32"]) for r in rows) == want


# --- vectors ---------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, v int"


def whole(vector):
    return np.floor(np.array(vector, float) * 256).astype(np.int64)


def good(vector, dims):
    return vector is not None and len(vector) == dims and all(x is not None and np.isfinite(x) and abs(x) < 2**22 / dims for x in vector)


def some_vectors(dims, n, seed, grid=4):
    """Clustered vectors on a coarse grid, so that many distances tie; repeats, nulls and odd ones among them."""
    rng = np.random.default_rng(seed)
    spots = rng.integers(-3, 4, (7, dims)) / 2
    rows = [(int(k), (spots[k % 7] + rng.integers(-grid, grid + 1, dims) / 256).tolist(), int(k % 3) if k % 5 else None) for k in range(n)]
    rows += [rows[3], rows[3], (None, rows[5][1], 1), (n + 1, None, 1), (n + 2, [], 1), (n + 3, [None] * dims, 1)]
    for bad in (NAN, INF, -INF, 1e300):
        rows.append((-5, [bad] + [0.0] * (dims - 1), 2))
    rows += [(-6, [0.0] * (dims - 1), 0), (-7, [0.0] * 2 * dims, 0), (n + 9, [1000.0, -1000.0] * (dims // 2), 0)]
    return [(*r, 9) for r in rows]


def brute_codes(rows, parts, entries, rounds, dims):
    kept = sorted(((r[0], whole(r[1]).tolist(), r[2]) for r in rows if good(r[1], dims)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([r[1] for r in kept]).reshape(len(kept), parts, dims // parts)
    book = x[:entries].transpose(1, 0, 2).copy()

    def near():
        d = ((x[:, :, None, :] - book[None]) ** 2).sum(-1)
        return d.argmin(2), d.min(2).sum(1)

    for _ in range(rounds):
        code, _ = near()
        for p in range(parts):
            for e in range(book.shape[1]):
                mine = x[code[:, p] == e, p]
                if len(mine):
                    book[p, e] = mine.sum(0) // len(mine)
    code, error = near()
    total = defaultdict(int)
    for r, e in zip(kept, error):
        total[r[2]] += int(e)
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return [(r[0], r[2], bytes(c.astype(np.uint8)), int(e), total[r[2]], digest) for r, c, e in zip(kept, code, error)]


def in_order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("parts, entries, dims, n", [(4, 8, 16, 300), (2, 5, 16, 40), (16, 64, 64, 150), (4, 64, 16, 20)])
def test_vector_codes(spark, parts, entries, dims, n):
    rows = [r for r in some_vectors(dims, n, parts) if r[0] != -7 or True]
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    # The smallest id of a vector that can be cut decides the length; -7 has twice as many components.
    frame = frame.filter("vec_id is null or vec_id != -7")
    rows = [r for r in rows if r[0] != -7]
    if dims - 1 > 0 and (dims - 1) % parts == 0:
        pytest.fail("the fixture's short vector must not be cut evenly")
    got = [tuple(r) for r in codes.compress(frame, parts, entries, 2).collect()]
    assert in_order(got) == in_order(brute_codes(rows, parts, entries, 2, dims))


def test_vector_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert codes.compress(empty).collect() == []
    assert codes.compress(empty).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    none = spark.createDataFrame([(1, None, 1, 1), (2, [NAN] * 16, 1, 1), (3, [1.0] * 15, 1, 1)], VECTORS)
    assert codes.compress(none).collect() == []
    with pytest.raises(ValueError):
        codes.compress(empty, entries=257)
    # Vectors of the other length are left out, whichever comes first decides.
    two = spark.createDataFrame([(-1, [0.5] * 32, 1, 1), (0, [0.5] * 16, 1, 1), (1, [0.5] * 32, 1, 1)], VECTORS)
    assert sorted(r["vec_id"] for r in codes.compress(two).collect()) == [-1, 1]
    floats = two.withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert sorted(r["error"] for r in codes.compress(floats).collect()) == [0, 0]


def test_codes_decode_to_their_error(spark):
    frame = spark.createDataFrame(some_vectors(16, 80, 3), VECTORS).filter("vec_id >= 0")
    books = codes.train(frame, 4, 8, 2)
    rows = codes.decode(codes.encode(frame, books), books).collect()
    given_ = defaultdict(list)
    for r in frame.collect():
        if good(r["embedding"], 16):
            given_[r["vec_id"]].append(whole(r["embedding"]))
    for r in rows:
        assert any(((x - np.array(r["decoded"])) ** 2).sum() == r["error"] for x in given_[r["vec_id"]])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 4), st.integers(1, 30), st.integers(1, 5))
def test_equal_average_search_is_exact(seed, parts, entries, dims):
    rng = np.random.default_rng(seed)
    reach = int(rng.choice([2, 5, 300, 2**25]))
    books = codes.Codebooks(rng.integers(-reach, reach + 1, (parts, entries, dims)))
    x = rng.integers(-reach, reach + 1, (50, parts * dims))
    code, error, looked = books.search(x)
    d = ((x.reshape(50, parts, 1, dims) - books.entries[None]) ** 2).sum(-1)
    assert (code == d.argmin(2)).all() and (error == d.min(2)).all()
    assert looked <= 50 * parts * entries


def test_equal_average_search_leaves_out_entries():
    rng = np.random.default_rng(1)
    books = codes.Codebooks(rng.integers(-1000, 1000, (4, 64, 4)))
    x = rng.integers(-1000, 1000, (2000, 16))
    assert books.search(x)[2] < 0.6 * 2000 * 4 * 64


def brute_clusters(rows, clusters, rounds, dims, salt=2):
    key = lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest(), r[1])
    kept = sorted(((r[0], whole(r[1]).tolist()) for r in rows if good(r[1], dims)), key=key)
    x = np.array([r[1] for r in kept])
    c = x[:clusters].copy()
    for _ in range(rounds):
        near = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].sum(0) // (near == j).sum()
    d = ((x[:, None] - c[None]) ** 2).sum(-1)
    near, d = d.argmin(1), d.min(1)
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    return [(r[0], int(j), int(e), int(d[near == j].sum()), int(d.sum()), digest[j]) for r, j, e in zip(kept, near, d)]


@pytest.mark.parametrize("clusters, n, rounds, block", [(6, 400, 5, 64), (10, 60, 3, 7), (40, 20, 5, 4096), (1, 30, 2, 16), (5, 50, 0, 16)])
def test_clusters(spark, clusters, n, rounds, block):
    rows = some_vectors(16, n, clusters, grid=30 if n == 400 else 2)
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = [tuple(r) for r in centroids.cluster(frame, clusters, rounds, 16, block=block).collect()]
    assert in_order(got) == in_order(brute_clusters(rows, clusters, rounds, 16))


def test_heaps_spare_vectors(spark):
    """Far clusters: after the first rounds only vectors near a border are looked at."""
    rng = np.random.default_rng(4)
    spots = rng.normal(0, 40, (12, 16))
    rows = [(int(k), (spots[k % 12] + rng.normal(0, 0.5, 16)).tolist(), 0, 0) for k in range(1200)]
    log = []
    got = [tuple(r) for r in centroids.cluster(spark.createDataFrame(rows, VECTORS), 12, 6, 16, log=log).collect()]
    assert in_order(got) == in_order(brute_clusters(rows, 12, 6, 16))
    assert log[0] == 1200 and log[-1] < 600


def test_clusters_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    out = centroids.cluster(empty)
    assert out.collect() == []
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    same = spark.createDataFrame([(k, [0.25] * 64, 0, 0) for k in range(90)], VECTORS)
    rows = centroids.cluster(same).collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in rows} == {(0, 0, 0)} and len(rows) == 90


def test_distances_of_large_components_are_exact():
    rng = np.random.default_rng(2)
    for reach in (100, 2**24):
        x, c = rng.integers(-reach, reach, (40, 64)), rng.integers(-reach, reach, (7, 64))
        assert (centroids.distances(x, c) == ((x[:, None] - c[None]) ** 2).sum(-1)).all()


def test_scratch_tables_are_gone(spark):
    frame = spark.createDataFrame([(k, [k / 8] * 16, 0, 0) for k in range(30)], VECTORS)
    before = {t.name for t in spark.catalog.listTables()}
    centroids.cluster(frame, 3, 2, 16).collect()
    assert {t.name for t in spark.catalog.listTables()} == before
