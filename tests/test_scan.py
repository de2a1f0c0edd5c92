"""One pass over the texts against a plain search, in one pack and in many."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import scan, term_index
from tessera.plans import catalogue
from tests.test_term_index import SCHEMA, brute, chunks, queries  # noqa: F401


@pytest.mark.parametrize(("pack", "size", "group", "k"), [(7, 1 << 20, 4, 3), (1000, 40, 100, 18), (1000, 1 << 20, 100, 5)])
def test_search_equals_a_plain_one(spark, chunks, queries, monkeypatch, pack, size, group, k):  # noqa: F811
    monkeypatch.setattr(scan, "PACK_CHUNKS", pack)
    monkeypatch.setattr(scan, "PACK_BYTES", size)
    monkeypatch.setattr(scan, "BLOCK_QUERIES", group)
    monkeypatch.setattr(scan, "LONG", 4)
    given = spark.createDataFrame(chunks, SCHEMA)
    asked = spark.createDataFrame(queries, "query_id int, terms array<string>, templates boolean")
    top, counts = scan.search(given, asked, k)
    got = {q: [] for q, _, _ in queries}
    for r in top.orderBy("query_id", "rank").collect():
        assert r["source"] == "lexical" and r["reason"] == "lexical match: " + ", ".join(r["matched"])
        got[r["query_id"]].append((r["chunk_id"], r["score"], r["demoted"], r["matched"]))
    wanted, numbers = brute(chunks, queries, k)
    assert got == wanted
    assert {r["query_id"]: r["lexical"] for r in counts.collect()} == numbers


def test_terms_within_words(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choices("abü日😀'", k=rng.randint(1, 12))) for _ in range(300)]
    terms = list({"".join(rng.choices("abü日😀'", k=rng.randint(1, 9))) for _ in range(400)})
    wanted = [(i, j) for i, w in enumerate(words) for j, t in enumerate(terms) if t in w]
    for factor, long in ((scan.FACTOR, 24), (scan.FACTOR, 3), (scan.np.uint64(1), 24)):  # the last: many equal hashes
        monkeypatch.setattr(scan, "FACTOR", factor)
        monkeypatch.setattr(scan, "LONG", long)
        word, term = scan._within(words, terms)
        assert sorted(zip(word.tolist(), term.tolist())) == wanted
    assert [len(x) for x in scan._within([], ["a"])] == [len(x) for x in scan._within(["a"], [])] == [0, 0]


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([(1, ["tea"])], "query_id int, terms array<string>")
    some = spark.createDataFrame([("c", None, None, None, "tea", None), ("d", None, None, None, None, None), (None, None, None, None, "tea", None)], SCHEMA)
    for rows, queries_of in ((none, asked), (some, asked.limit(0)), (some, asked.withColumn("terms", F.expr("array(cast(null AS string))")))):
        top, counts = scan.search(rows, queries_of, 3)
        assert top.count() == counts.count() == 0
    top, counts = scan.search(some, asked, 3)
    assert [r["chunk_id"] for r in top.collect()] == ["c"] and counts.first()["lexical"] == 1


def test_a_batch_builds_no_index(spark, monkeypatch):
    monkeypatch.setattr(term_index, "postings_of", lambda *_: pytest.fail("postings of all words for one batch"))
    assert catalogue.lexical_batch(spark, "/root/testdata/sf0.001").count() == 5 * 40
