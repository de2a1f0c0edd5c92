"""The pipeline stage by stage, and the entry points."""

import collections

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    words = {"en": "the of and river stone under light house", "de": "der und nicht schule zeit über haus wald"}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        parts = words[lang].split()
        text = " ".join(parts[(i * k + k) % 8] + (str(i) if k % 9 == 0 else "") for k in range(1, 80))
        rows.append((i, text, lang, "s", len(text)))
    rows += [(100 + i, rows[3][1], "en", "s", 1) for i in range(3)] + [(200, None, None, None, None), (201, "123", "en", None, 3)]
    rows += [(300, rows[5][1] + "\nwrite to ann@example.org", "en", "s", 9)]
    rows += [(400, "ψωχ φυτσρ θξπζ " * 20, None, "s", 1)]  # no learnt language
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "line dedup", "near-dedup", "PII", "packing"]
    columns, seen = docs.columns, {}
    for name, function in pipeline.STAGES:
        docs = function(spark, docs, folder)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    assert {r.doc_id for r in seen["language ID"]} == {*range(60), 100, 101, 102, 300}
    # Copies of a long line are emptied by line dedup, which keeps the first.
    assert {r.doc_id for r in seen["line dedup"] if r.text == ""} == {100, 101, 102}
    assert {r.doc_id: r.text for r in seen["line dedup"]}[300] == "write to ann@example.org"
    assert {r.doc_id for r in seen["near-dedup"]} == {*range(60), 100, 300}  # empty texts are copies of each other
    assert any("[EMAIL]" in r.text for r in seen["PII"]) and not any("ann@" in r.text for r in seen["PII"])
    assert {r.doc_id for r in seen["packing"]} == {r.doc_id for r in seen["PII"]}


def test_run(spark, folder):
    rows = pipeline.run(spark, folder).collect()
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for sequence in held.values():
        assert sum(n for _, n in sequence) == max(o + n for o, n in sequence) <= 4096


def test_entry_points():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False))
    for _, function in pipeline.STAGES:
        docs = function(spark, docs, folder)
    assert docs.count() == 0
