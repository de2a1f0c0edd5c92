"""The stored term index against one pass over the texts, in one block and in many."""

import random

import pytest

from tessera.operators import retrieval, term_index

SCHEMA = "chunk_id string, note_title string, section_label string, relative_path string, paragraph_text string, chunk_hash string"


def brute(chunks, queries, k):
    def flat(text):
        return (text or "").lower()

    out, counts = {}, {}
    for query_id, terms, templates in queries:
        rows = []
        for chunk_id, title, label, path, text, content in chunks:
            hay = " ".join(flat(x) for x in (title, label, path, text))
            matched = [t for t in terms or [] if t is not None and t in hay]
            if matched:
                boiler = ("template" in flat(path) or "template" in flat(title)) and ("template" in flat(label) or "stop_rule" in flat(text))
                rows.append((boiler and not templates, -len(matched), chunk_id, matched, content or f"id:{chunk_id}"))
        counts[query_id] = len(rows)
        seen, kept = set(), []
        for row in sorted(rows):
            if row[4] not in seen and len(kept) < k:
                seen.add(row[4])
                kept.append(row)
        out[query_id] = [(r[2], float(2 - r[1]), r[0], r[3]) for r in kept]
    return out, {q: n for q, n in counts.items() if n}


@pytest.fixture(scope="module")
def chunks():
    rng = random.Random(6)
    words = ["tea", "steam", "a", "it's", "green-tea", "über", "日本", "x1", "leaf,", "ation", "ration", "stations", "Tea", "stop_rule"]
    out = []
    for i in range(90):
        text = rng.choice([" ", "\n", "  ", "\t"]).join(rng.choices(words, k=rng.randint(0, 9)))
        content = rng.choice([None, "", f"h{rng.randrange(12)}", f"u{i}"])
        out.append((f"c{i * 7 % 90:02d}", rng.choice(["Title", "", None, "Template"]), rng.choice([None, "template part", "x"]), f"p/{i}.md", rng.choice([text, text, text, None]), content))
    return out


@pytest.fixture(scope="module")
def queries():
    rng = random.Random(7)
    pool = ["tea", "ea", "t", "tio", "ation", "stati", "green-tea", "leaf, tea", "a  a", "tea steam", "Tea", "ü", "日本 x1", "本", "md", "p/1", "zz", "zzzz", "ationx", "x1\na", " ", "", "  ", "it's a", "stop_rule", "template"]
    rows = [(i, [rng.choice(pool) for _ in range(rng.randint(0, 7))], rng.random() < 0.4) for i in range(30)]
    return [*rows, (30, None, False), (31, [None, "tea"], None), (32, ["tea", "tea"], False)]


@pytest.mark.parametrize(("block", "group", "k"), [(7, 4, 3), (7, 100, 18), (1000, 100, 5)])
def test_search_equals_one_pass(spark, chunks, queries, monkeypatch, block, group, k):
    monkeypatch.setattr(term_index, "BLOCK_CHUNKS", block)
    monkeypatch.setattr(term_index, "BLOCK_QUERIES", group)
    given = spark.createDataFrame(chunks, SCHEMA)
    asked = spark.createDataFrame(queries, "query_id int, terms array<string>, templates boolean")
    index = term_index.build(given)
    top, counts = term_index.search(index, asked, k, given)
    got = {q: [] for q, _, _ in queries}
    for r in top.orderBy("query_id", "rank").collect():
        assert r["source"] == "lexical" and r["reason"] == "lexical match: " + ", ".join(r["matched"])
        got[r["query_id"]].append((r["chunk_id"], r["score"], r["demoted"], r["matched"]))
    wanted, numbers = brute(chunks, queries, k)
    assert got == wanted
    assert {r["query_id"]: r["lexical"] for r in counts.collect()} == numbers
    # The surface without an index finds as many.
    plain = retrieval.lexical(given, asked.withColumn("terms", term_index.F.filter("terms", lambda t: t.isNotNull())))
    assert {r["query_id"]: r["count"] for r in plain.groupBy("query_id").count().collect()} == numbers


def test_rows_out_of_rounds_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(term_index, "BLOCK_CHUNKS", 25)
    monkeypatch.setattr(term_index, "_COUNT_ROWS", True)
    rng = random.Random(2)
    rows = [(i, None, None, None, " ".join(rng.choices("alpha beta gamma delta omega kappa".split(), k=4)), str(i)) for i in range(3000)]
    given = spark.createDataFrame(rows, SCHEMA.replace("chunk_id string", "chunk_id long"))
    asked = spark.createDataFrame([(q, ["alpha", "beta", "gamma", "delta"]) for q in range(5)], "query_id int, terms array<string>")
    top, counts = term_index.search(term_index.build(given), asked, 10)
    matching = sum(r["lexical"] for r in counts.collect())
    assert matching > 14_000 and top.count() == 50
    # k rows of the first block, and about GROWTH * k of each of three rounds.
    assert 50 <= top.rows_made <= (1 + 3 * term_index.GROWTH) * 10 * 5


def test_rounds():
    assert list(term_index.rounds(0)) == [] and list(term_index.rounds(1)) == [(0, 1)]
    assert list(term_index.rounds(40)) == [(0, 1), (1, 5), (5, 25), (25, 40)]


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([(1, ["tea"])], "query_id int, terms array<string>")
    top, counts = term_index.search(term_index.build(none), asked, 3)
    assert top.count() == counts.count() == 0
    some = spark.createDataFrame([("c", None, None, None, "tea", None), ("d", None, None, None, None, None)], SCHEMA)
    index = term_index.build(some)
    top, counts = term_index.search(index, asked.limit(0), 3)
    assert top.count() == counts.count() == 0
    with pytest.raises(ValueError, match="blanks"):
        term_index.search(index, spark.createDataFrame([(1, ["a b"])], "query_id int, terms array<string>"), 3)
