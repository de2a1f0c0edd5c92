"""Top-k against brute force, and what MaxScore leaves out."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import topk


def clamp(score):
    return max(-(1 << 63), min((1 << 63) - 1, score))


def brute(rows, queries, k):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(1024 * x) for x in v]
            whole[i] = min(whole.get(i, w), w)
    out = {}
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        out[q] = [(n + 1, i, clamp(-s)) for n, (s, i) in enumerate(scored[:k])]
    return out


def clustered(rng, rows, width, spread):
    centres = [rng.normal(size=width) for _ in range(8)]
    vectors = [centres[i % 8] + spread * rng.normal(size=width) for i in range(rows)]
    return [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("shape", ["plain", "clusters", "ties", "large", "one term", "huge"])
def test_top_k(spark, monkeypatch, shape):
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(topk, "BLOCK_SHARDS", 3)
    rng = random.Random(6)
    size = {"ties": 0.002, "large": 1e9, "huge": 1e300}.get(shape, 1.0)
    rows = [(i, [rng.uniform(-size, size) for _ in range(16)]) for i in range(300)]
    if shape == "clusters":
        rows = clustered(np.random.default_rng(1), 300, 16, 0.1)
    if shape == "one term":  # all rows in the shards of one term
        rows = [(i, [5.0, *v[1:]]) for i, v in rows]
    rows += [(300, None), (301, [1.0, None] * 8), (302, [float("nan")] * 16), (303, [float("inf")] * 16), (None, [1.0] * 16), (304, []), rows[0], (5, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("term", F.lit("clash")).withColumn("shard", F.lit(1))
    vectors = topk.whole_vectors(df)
    got = collections.defaultdict(list)
    for r in topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 5).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute(rows, (0, 100, 200), 5)
    if shape in ("large", "huge"):  # scores beyond a long are clamped, and so tie
        assert {q: [s for _, _, s in sorted(x)] for q, x in got.items()} == {q: [s for _, _, s in x] for q, x in want.items()}
    else:
        assert {q: sorted(x) for q, x in got.items()} == want


def test_few_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "vec_id long, embedding array<double>")
    vectors = topk.whole_vectors(df)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in topk.top_k(vectors, vectors.where("vec_id = 0")).collect())
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert topk.top_k(vectors, vectors.limit(0)).count() == 0 and topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    assert topk.top_k(vectors.limit(0), vectors).count() == 0


def test_max_score_leaves_products_out():
    """At the shipped constants: a shard of unit vectors as large as in production, with thresholds as from home."""
    rows = clustered(np.random.default_rng(3), topk.SHARD_ROWS, 64, 0.02)
    stored = np.floor(1024 * np.array([v for _, v in rows]))
    ids = np.arange(len(rows))
    queries = stored[::100]
    search = topk.Search(queries, ids[::100], np.full(len(queries), -np.inf), 10)
    found = search.among(stored, ids)
    for q, (scores, names) in zip(ids[::100], found):
        exact = stored @ stored[q]
        order = [i for i in np.lexsort((ids, -exact)) if i != q][:10]
        assert names.tolist() == order and scores.tolist() == exact[order].tolist()
    assert search.skipped > 0.5 * search.products
    plain = np.floor(1024 * np.random.default_rng(4).normal(size=(topk.SHARD_ROWS, 64)) / 8)
    search = topk.Search(plain[::100], ids[::100], np.full(len(plain[::100]), -np.inf), 10)
    search.among(plain, ids)
    assert search.skipped > 0  # little is left out where nothing is like anything else


def test_queries_go_to_competitive_shards_only(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    rows = [(i, [1.0 + i % 3 / 100, 0.01] if i % 2 else [0.01, 1.0 + i % 3 / 100]) for i in range(400)]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    sent, real = [], topk.stage

    def staged(df):
        out = real(df)
        if df.columns == ["query_id", "shard"]:
            sent.append(out.count())
        return out

    monkeypatch.setattr(topk, "stage", staged)
    got = topk.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect()
    assert len(got) == 80 and sent[0] <= 2 * 8  # of 4 shards: at most the other one of the same term


def test_terms_of_few_rows_share_a_shard(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    terms = spark.createDataFrame([(t, n) for t, n in enumerate([30, 40, 50, 250, 60, 10, 99, 5])], "term int, n long")
    got = {r["term"]: (r["first"], r["parts"]) for r in topk._terms_together(terms).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (0, 1), 3: (3, 3), 4: (4, 1), 5: (4, 1), 6: (4, 1), 7: (7, 1)}


def test_clusters_are_searched_in_few_shards(spark, monkeypatch):
    """Of the pairs of query and shard most are left out where rows come in clusters."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    rows = clustered(np.random.default_rng(7), 640, 16, 0.02)
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    sent, real = [], topk.stage

    def staged(df):
        out = real(df)
        if df.columns == ["query_id", "shard"]:
            sent.append(out.count())
        return out

    monkeypatch.setattr(topk, "stage", staged)
    got = collections.defaultdict(list)
    for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 5).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute(rows, range(0, 640, 20), 5)
    assert {q: sorted(x) for q, x in got.items()} == want
    assert sent[0] < 0.35 * 32 * 16
