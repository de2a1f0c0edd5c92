"""The pivot index against brute force, in few shards and in many, and what it skips."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators import packets, retrieval, store, vector_index
from tessera.plans.retrieve import retrieve

VECTOR = "chunk_id string, vector array<double>"


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    out = []
    for i in range(400):
        c = rng.choice(centres)
        out.append((f"c{i:03d}", [x + rng.gauss(0, 0.1) for x in c]))
    out += [(f"d{i:03d}", list(centres[0])) for i in range(60)]  # a hot vector
    out += [(f"e{i}", [rng.random() - 0.5 for _ in range(3)]) for i in range(30)]
    return [*out, ("x1", None), ("x2", []), ("x3", [0.0] * 6), ("x4", [1.0, None, 0.0, 0.0, 0.0, 0.0]), ("x5", [float("nan")] * 6), ("x6", [float("inf")] + [1.0] * 5), ("x7", [1e-200] * 6), ("x8", [1e200] * 6)]


@pytest.mark.parametrize(("shard", "k"), [(10_000, 5), (20, 5), (20, 80)])
def test_search_equals_brute_force(spark, rows, monkeypatch, shard, k):
    monkeypatch.setattr(vector_index, "SHARD_VECTORS", shard)
    rng = random.Random(6)
    asked = [(i, rows[i * 17][1]) for i in range(20)] + [(20, [1.0, 2.0, 3.0]), (21, None), (22, [1.0]), (23, [0.0] * 6), (24, [-x for x in rows[0][1]]), (25, [rng.random() for _ in range(6)])]
    index = vector_index.build(spark.createDataFrame(rows, VECTOR))
    hits, counts = vector_index.search(index, spark.createDataFrame(asked, "query_id int, vector array<double>"), k, decimals=9, counts=True)
    got: dict = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["similarity"], 8)))
    want, positive = {}, {}
    for q, v in asked:
        if not fine(v):
            continue
        found = [(cosine([x / max(map(abs, c)) for x in c], v), i) for i, c in rows if fine(c) and len(c) == len(v)]
        found = [(s, i) for s, i in found if s > 1e-12]
        if found:
            positive[q] = len(found)
            want[q] = [(i, round(s, 8)) for s, i in sorted(found, key=lambda x: (-round(x[0], 9), x[1]))[:k]]
    assert got == want
    assert {r["query_id"]: r["vector"] for r in counts.collect() if r["vector"]} == positive


def test_shards_are_skipped(spark, rows, monkeypatch):
    monkeypatch.setattr(vector_index, "SHARD_VECTORS", 20)
    monkeypatch.setattr(vector_index, "COUNT_PRODUCTS", True)
    some = [r for r in rows if fine(r[1]) and len(r[1]) == 6]
    index = vector_index.build(spark.createDataFrame(some, VECTOR))
    asked = spark.createDataFrame([(i, some[i * 11][1]) for i in range(30)], "query_id int, vector array<double>")
    hits, none = vector_index.search(index, asked, 5)
    assert none is None and hits.count() == 150
    assert index.skipped > index.products and index.made <= 5 * (index.products + 30 * 3)
    # The hot vector's shard is split.
    assert max(p.max() for p in index.parts.values()) > 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], VECTOR)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    index = vector_index.build(none)
    hits, counts = vector_index.search(index, asked, 3, counts=True)
    assert hits.count() == counts.count() == 0
    index = vector_index.build(spark.createDataFrame([("a", [1.0, 1.0])], VECTOR))
    assert vector_index.search(index, asked.limit(0), 3)[0].count() == 0
    assert vector_index.search(index, asked, 3)[0].first()["chunk_id"] == "a"


def test_selection_equals_that_from_all_positive_cosines(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "SHARD_VECTORS", 12)
    rng = random.Random(3)
    words = ["note", "link", "tea", "leaf", "method", "stone", "river"]
    given = []
    for i in range(80):
        text = " ".join(rng.choices(words, k=rng.randint(1, 7)))
        path = rng.choice([f"n{i}.md", f"template/n{i}.md"])
        given.append((f"c{i:02d}", f"n{i}", i, 0, rng.choice(["T", "note"]), path, "S", text, text if rng.random() < 0.5 else f"h{i}"))
    chunks = spark.createDataFrame(given, "chunk_id string, note_id string, note_seq long, chunk_seq int, note_title string, relative_path string, section_label string, paragraph_text string, chunk_hash string")
    vectors = store.probe_embedding(chunks.select("chunk_id", F.col("paragraph_text").alias("text"))).select("chunk_id", "vector")
    asked = spark.createDataFrame([("q", "note link", "", []), ("r", "zzz", "", []), ("s", "river template", "", [])], "query_id string, message string, previous_message string, focus_terms array<string>")
    made = packets.complete(packets.compile_packets(asked).withColumn("payload", F.struct("query"))).withColumn("vector_query", F.lit("link link note"))
    config = Config(max_retrieval_chunks=9)
    selected, decided = retrieve(made, {"chunks": chunks, "chunk_vectors": vectors}, store.probe_embedding, config)
    every = retrieval.vector(vectors, store.probe_embedding(made.select("query_id", F.col("vector_query").alias("text"))))
    found = retrieval.lexical(chunks, made.select("query_id", F.col("retrieval_terms").alias("terms"))).unionByName(every)
    flags = retrieval.is_boilerplate(F.col("note_title"), F.col("relative_path"), F.col("section_label"), F.col("paragraph_text"))
    demoted = retrieval.demote(found.join(chunks, "chunk_id"), flags & (F.col("query_id") != "s"))
    fused = retrieval.fuse(demoted.select("query_id", "chunk_id", "source", "score", "reason", "demoted")).join(chunks.select("chunk_id", "chunk_hash"), "chunk_id")
    fields = ("query_id", "rank", "chunk_id", "source", "score", "reason", "demoted")
    want = [(*r[:4], round(r[4], 9), *r[5:]) for r in retrieval.select_top(fused, 9).select(*fields).collect()]
    got = [(*r[:4], round(r[4], 9), *r[5:]) for r in selected.select(*fields).collect()]
    assert sorted(got) == sorted(want) and {r[3] for r in got} == {"lexical", "vector"}
    assert {r["query_id"]: r["manifest"].candidate_counts.vector for r in decided.collect()} == {r["query_id"]: r["count"] for r in every.groupBy("query_id").count().collect()}


@pytest.mark.parametrize("counted", [False, True])
def test_products_held_at_once_do_not_grow_with_the_queries(counted):
    rng = np.random.default_rng(1)
    stored, asked = rng.normal(size=(1500, 4)), rng.normal(size=(4000, 4))
    left = pd.DataFrame({"chunk_id": np.arange(1500), "vector": list(stored), "content": [f"id:{i}" for i in range(1500)], "flag": False})
    right = pd.DataFrame({"query_id": np.arange(4000), "vector": list(asked), "templates": False, "least": 0.0, "counted": counted})
    tracemalloc.start()
    found = vector_index._nearest(2, None)(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1500 * 4000 * 8  # one matrix of all products
    product = asked @ stored.T
    hits = found[found["chunk_id"].notna()]
    assert hits["chunk_id"].tolist() == [int(c) for row in product for c in np.argsort(-row, kind="stable")[:2]]
    assert found["n"].dropna().tolist() == ((product > 0).sum(axis=1).tolist() if counted else [])
