"""The pipeline and its stages on small tables, against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators_small import brute_near, brute_targets

import corpus_pipeline
from tidemark.llm import queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with planted toxic texts, near copies, benchmark passages, nulls, repeats and a long text."""
    rng = random.Random(21)
    words = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    items = [(k, " ".join(f"b{rng.randrange(400)}" for _ in range(25))) for k in range(6)]
    docs, toxic = {}, set()
    for k in range(240):
        text = words(rng.randint(20, 60))
        if k % 6 == 0:
            text += " idiot scum " + words(5)
            toxic.add(k)
        docs[k] = text
    for k in range(12):  # near copies of clean documents
        text = docs[6 * k + 1].split()
        text[3] = "changed"
        docs[300 + k] = " ".join(text)
    for k in range(6):
        docs[400 + k] = f"{words(10)} {items[k][1]} {words(10)}"
    docs[500], docs[501], docs[502] = "", None, " ".join(["again"] * 20_000)
    rows = [(k, t, "en", ["a", "a", "b", "c", None][k % 5], None if t is None else len(t)) for k, t in docs.items()]
    rows += [(7, docs[7], "en", ["a", "a", "b", "c", None][2], 1)] * 3 + [(None, "no id but a text", None, None, None)]
    root = str(tmp_path_factory.mktemp("tables"))
    write = lambda frame, name: frame.coalesce(1).write.parquet(f"{root}/{name}.parquet")
    write(spark.createDataFrame(rows, DOCS).withColumns({"shard": F.lit("old"), "_n": F.lit(1), "item_id": F.lit(2)}), "documents")
    write(spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(240)], "doc_id long, quality int, toxic int"), "labels")
    write(spark.createDataFrame(items + [(9, None)], "item_id long, text string"), "benchmark")
    return root, rows, toxic


def test_stages(spark, tables):
    root, rows, toxic = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    seen = Counter(r[0] for r in rows)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, root)
        if name != "sharding":
            assert out.columns == docs.columns
        path = f"{root}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = Counter(r["doc_id"] for r in docs.collect())
    # Toxic documents go, all others stay as often as they were.
    assert kept["toxicity"] == Counter({d: n for d, n in seen.items() if d not in toxic})
    texts = {r[0]: r[1] for r in rows if r[0] is not None and r[0] in kept["toxicity"]}
    near = brute_near(list(texts.items()))
    assert kept["near_duplicates"] == Counter([d for d, (_, root_) in near.items() if d == root_] + [None])
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {400 + k for k in range(6)}
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    source = {r[0]: r[3] for r in rows}
    sizes, taken = Counter(), Counter()
    for d in kept["decontamination"]:
        sizes[source[d]] += size[d]
    for d, n in kept["mixing"].items():
        assert d in kept["decontamination"] and n <= 2
        taken[source[d]] += n * size[d]
    for s, target in brute_targets(sizes).items():
        assert abs(taken[s] - target) <= 2 * max(size[d] for d in kept["decontamination"] if source[d] == s)
    assert kept["sharding"] == kept["mixing"]
    slots = defaultdict(list)
    for r in docs.select("shard", "slot").collect():
        slots[r["shard"]].append(r["slot"])
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_run_applies_all_stages(spark, tables):
    root, rows, toxic = tables
    got = corpus_pipeline.run(spark, root)
    ids = {r["doc_id"] for r in got.collect()}
    assert got.columns[-2:] == ["shard", "slot"] and len(ids) > 50
    assert not ids & toxic and not ids & {400 + k for k in range(6)}


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op6_near_duplicates", "op7_chat_format", "op8_warc"])
def test_queries_equal_their_sql(spark, name):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
    import check

    run, text = queries.QUERIES[name]
    sf = "/root/testdata/sf0.001"
    assert check.difference(run(spark, sf).toPandas(), check.connect(sf).execute(text).df()) is None


def test_queries_return_a_row_for_every_document(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op2_mixing", "op3_fingerprints", "op4_secrets", "op5_toxicity", "op9_sharding"):
        rows = queries.QUERIES[name][0](spark, sf)
        assert rows.count() == n == rows.select("doc_id").distinct().count(), name


def test_held_out_rows_are_never_read(spark):
    docs = spark.createDataFrame([(k, f"only{k} idiot" if k % 2 else f"only{k}") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    held = {r["doc_id"] for r in docs.where(toxicity.held_out()).collect()}
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert 20 < len(held) < 70 and (a.weights == b.weights).all() and a.bias == b.bias
