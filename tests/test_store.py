"""The store in buckets: what a run writes, what a failed run leaves, logs, and what is deleted."""

import pytest
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators import packets, store, term_index
from tessera.plans.retrieve import retrieve
from tessera.sources import vault


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "vault"
    root.mkdir()
    for i in range(60):
        (root / f"n{i:03d}.md").write_text(f"# Note {i}\n\nbody {i} about tea\n\nmore of word{i % 7}\n", encoding="utf-8")
    return root


def files(spark, folder):
    return vault.read_vault(spark, [("main", str(folder))])


def rows(table):
    return sorted(map(str, table.collect()))


def test_a_changed_note_writes_its_bucket(spark, folder, tmp_path):
    own = store.Store(spark, str(tmp_path / "store"), buckets=8)
    first = store.ingest(own, files(spark, folder), ["main"])
    assert len(first["written"]["chunks"]) == 8
    again = store.ingest(own, files(spark, folder), ["main"])
    assert {k: v for k, v in again["written"].items() if v} == {"runs": [0]}
    (folder / "n007.md").write_text("# Note 7\n\nbody 7 about coffee\n\nmore of word0\n", encoding="utf-8")
    third = store.ingest(own, files(spark, folder), ["main"])
    assert [len(third["written"][n]) for n in ("notes", "chunks", "postings", "members", "chunk_vectors", "manifest")] == [1, 1, 1, 1, 1, 1]
    assert third["written"]["chunks"] == third["written"]["postings"] == third["written"]["notes"]
    assert own.read("notes").count() == 60 and own.read("chunks").where("paragraph_text LIKE '%coffee%'").count() == 1
    assert [r["updated"] for r in own.read("runs").orderBy("generated_at", "inserted").collect()].count(1) <= 1 and own.read("runs").count() == 3
    assert store.Store(spark, str(tmp_path / "store"), buckets=99).buckets == 8
    # The index that deltas keep is the one that would be built anew.
    chunks = own.read("chunks")
    fresh = term_index.build(chunks, own.bucket_of("note_id"))
    assert rows(own.read("members")) == rows(fresh.members)
    ordered = lambda t: t.select("block", "key", F.array_sort("places").alias("places"))
    assert rows(ordered(own.read("postings"))) == rows(ordered(fresh.postings))
    assert set(rows(fresh.lexicon)) <= set(rows(own.read("lexicon")))
    (folder / "n007.md").unlink()
    last = store.ingest(own, files(spark, folder), ["main"])
    assert last["deleted"] == 2 and own.read("notes").count() == 59 and own.read("chunks").where("paragraph_text LIKE '%coffee%'").count() == 0


def test_retrieval_through_the_stored_index(spark, folder, tmp_path):
    own = store.Store(spark, str(tmp_path / "store"), buckets=4)
    store.ingest(own, files(spark, folder), ["main"])
    asked = spark.createDataFrame([("q", "tea", "", []), ("r", "word3 body", "", []), ("s", "zzz", "", [])], "query_id string, message string, previous_message string, focus_terms array<string>")
    made = packets.complete(packets.compile_packets(asked).withColumn("payload", F.struct("query")))
    names = ("chunks", "graph_nodes", "graph_edges")
    plain = {n: own.read(n) for n in names}
    indexed = plain | {n: own.read(n) for n in ("postings", "members", "lexicon")}
    one, two = retrieve(made, plain, None, Config()), retrieve(made, indexed, None, Config())
    fields = ("query_id", "rank", "chunk_id", "score", "source", "reason", "demoted")
    assert rows(one[0].select(*fields)) == rows(two[0].select(*fields)) and one[0].count() > 30
    assert rows(one[1].select("query_id", "manifest", "decision")) == rows(two[1].select("query_id", "manifest", "decision"))
    assert two[1].where("query_id = 'q'").first()["manifest"].candidate_counts.lexical == 60


@pytest.mark.parametrize("step", range(5))
def test_a_failure_leaves_the_old_state(spark, tmp_path, monkeypatch, step):
    own = store.Store(spark, str(tmp_path / "store"), buckets=4)

    def tables(n):
        some = spark.range(n).select(F.col("id").cast("string").alias("k"), (F.col("id") * n).alias("v"))
        return {"a": store.Part(some, "k"), "b": store.Part(some), "log": store.Part(some, "k", log=True)}

    own.commit(tables(10), {})
    before = {n: rows(own.read(n)) for n in ("a", "b", "log")}
    calls = []

    def failing(real):
        def run(*args, **kwargs):
            calls.append(real)
            if len(calls) == step + 1:
                raise OSError("lost")
            return real(*args, **kwargs)

        return run

    with monkeypatch.context() as patch:
        patch.setattr(own, "_write", failing(own._write))
        patch.setattr(own, "write_json", failing(own.write_json))
        with pytest.raises(OSError, match="lost"):
            own.commit(tables(20), {})
    assert {n: rows(own.read(n)) for n in ("a", "b", "log")} == before
    own.commit(tables(20), {})
    assert own.read("a").count() == 20 and own.read("log").count() == 30
    kept = {n: rows(own.read(n)) for n in ("a", "b", "log")}
    assert own.vacuum() > 0 and own.vacuum() == 0
    assert {n: rows(own.read(n)) for n in ("a", "b", "log")} == kept


def test_logs_are_written_anew_when_they_have_many_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "LOG_SEGMENTS", 3)
    own = store.Store(spark, str(tmp_path / "store"), buckets=2)
    for i in range(8):
        own.commit({"log": store.Part(spark.createDataFrame([(f"t{i % 2}", i, [i] * i)], "k string, v int, a array<int>"), "k", log=True)}, {})
        assert sorted(r["v"] for r in own.read("log").collect()) == list(range(i + 1))
        assert max(sum(s[1] == b for s in own.segments(own.current())) for b in range(2)) <= 3
    assert own.read("none") is None and own.read("log", [99]).count() == 0


def test_tables_of_odd_rows(spark, tmp_path):
    own = store.Store(spark, str(tmp_path / "store"), buckets=3)
    assert own.read("t") is None and own.vacuum() == 0
    schema = "k string, `a.b` double, s struct<x:array<int>,y:string>"
    some = [(None, float("nan"), None), ("x", -0.0, ([1, None], "y")), ("x", None, ([], None)), ("x", None, ([], None))]
    own.commit({"t": store.Part(spark.createDataFrame([], schema), "k")}, {})
    assert own.read("t").count() == 0
    own.commit({"t": store.Part(spark.createDataFrame(some, schema), "k")}, {})
    assert own.read("t").count() == 4 and own.read("t").columns == ["k", "a.b", "s"]
    assert own.commit({"t": store.Part(own.read("t"), "k")}, {})["written"] == {"t": []}
    own.commit({"t": store.Part(spark.createDataFrame([], schema), "k")}, {})
    assert own.read("t").count() == 0
