"""The turn pipeline over threads: states, gate, ledger and what is stored."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators import backends, packets
from tessera.plans import turns


def services():
    """Classes of a function travel to workers by value."""

    class Compiler:
        """Answers by the message: a payload, a failure, or an answer that is no object."""

        def compile_turn(self, request):
            said = request["raw_user_input"]
            assert request["instruction"].startswith("Compile") and isinstance(request["recent_messages"], list)
            if "fail" in said:
                raise RuntimeError("down")
            if "malformed" in said:
                return backends.Compiled(None, "[1]", "malformed")
            if "empty" in said:
                return backends.Compiled({"query": said}, "{}", "parsed")
            return backends.Compiled({"query": said, "entities": [{"label": "Tea"}, "Tea"], "retrieval_terms": "leaf", "intent": 3}, "{...}", "parsed")


    class Writer:
        available, mode = True, "live"

        def generate(self, context):
            assert context["approved_retrieval_packet"]["matched_chunk_count"] > 0
            return f"answer to {context['raw_user_input']} in turn {context['turn_id']}"

    return Compiler(), Writer()


@pytest.fixture(scope="module")
def tables(spark):
    rows = [("c1", "n1", 0, 0, "Tea", "notes/tea.md", "Tea", "green leaf", "h1"), ("c2", "n2", 1, 0, "Leaf", "leaf.md", "Leaf", "something else", "h2")]
    chunks = spark.createDataFrame(rows, "chunk_id string, note_id string, note_seq long, chunk_seq int, note_title string, relative_path string, section_label string, paragraph_text string, chunk_hash string")
    nodes = chunks.select(F.concat(F.lit("note::"), "note_id").alias("node_id"), F.lit("note").alias("node_type"), F.col("note_title").alias("label"), F.col("note_id").alias("ref_id"), "note_seq").withColumnRenamed("note_seq", "node_seq")
    edges = spark.createDataFrame([("e", "note::n1", "note::n2", "note_links_note")], "edge_id string, source_node_id string, target_node_id string, edge_type string")
    return {"chunks": chunks, "graph_nodes": nodes, "graph_edges": edges}


def digest(value):
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_turns_of_several_threads(spark, tables, tmp_path):
    threads = turns.Threads(spark, str(tmp_path))
    asked = [("a", "first about tea", 0), ("a", "what about it", 1), ("b", "please fail", 0), ("c", "malformed words", 0), ("d", "empty zzz", 0)]
    first = turns.run_turns(threads, tables, spark.createDataFrame(asked, "thread_id string, message string, input_seq int"), "2025-01-01", Config(), services()[0], None, services()[1])
    got = {(r.thread_id, r.turn_id): r for r in first.collect()}
    assert set(got) == {("a", 1), ("a", 2), ("b", 1), ("c", 1), ("d", 1)}
    assert got["a", 1].response == "answer to first about tea in turn 1" and got["a", 1].runtime_outcome == "completed"
    assert got["a", 1].semantic_compiler_packet.entities == ["Tea"] and got["a", 1].semantic_compiler_packet.intent == "3"
    for thread, why in (("b", "fallback"), ("c", "fallback")):
        assert got[thread, 1].blocking_reasons[0] == f"semantic compiler status is {why}; parsed compiler output is required"
        assert got[thread, 1].response is None and got[thread, 1].semantic_compiler_packet.limitations == [packets.FALLBACK_LIMITATION]
    assert got["b", 1].semantic_compiler_diagnostic.semantic_compiler_response_status == "unavailable"
    assert got["d", 1].blocking_reasons == ["retrieval required but no chunks were selected"]
    assert got["d", 1].semantic_compiler_packet.retrieval_terms == ["empty", "zzz"]
    # The second turn refers back: seeds of the focus found the note again.
    assert any("active_focus graph seed matched note: Tea" in c.reason for c in got["a", 2].retrieval_packet.selected_chunks)

    again = spark.createDataFrame([("a", "and this"), (None, "a new thread")], "thread_id string, message string")
    second = turns.run_turns(threads, tables, again, "2025-01-02", Config(), services()[0], None, None)
    rows = second.collect()
    assert sorted(r.turn_id for r in rows) == [1, 3] and all(r.blocking_reasons == ["LLM backend unavailable: no service for answers is configured"] for r in rows)
    assert all(r.ledger_record.llm_mode == "unavailable" for r in rows) and any(r.thread_id.startswith("thread-") for r in rows)

    states = {r.thread_id: r.asDict(recursive=True) for r in threads.states().collect()}
    ledger = sorted((r.asDict(recursive=True) for r in threads.ledger().collect()), key=lambda r: (r["thread_id"], r["turn_id"]))
    assert len(ledger) == 7 and all(len(r) == 17 for r in ledger)
    for thread, own in states.items():
        chain = [r for r in ledger if r["thread_id"] == thread]
        assert [r["turn_id"] for r in chain] == list(range(1, len(chain) + 1)) and chain[0]["parent_perturbation_hash"] is None
        assert all(y["parent_perturbation_hash"] == x["state_perturbation_hash"] for x, y in zip(chain, chain[1:]))
        state = own["state"]
        assert chain[-1]["thread_state_hash"] == state["latest_thread_state_hash"] == digest({**state, "latest_thread_state_hash": None})
        assert chain[-1]["conversation_thread_hash"] == digest(own["conversation"])
        assert own["conversation"]["latest_perturbation_hash"] == chain[-1]["state_delta_hash"]
        assert state["latest_turn_id"] == len(chain) == own["conversation"]["turn_count"]
    assert [m["role"] for m in states["a"]["state"]["recent_messages"]] == ["user", "assistant", "user", "assistant", "user"]
    assert states["a"]["state"]["active_focus"]["selected_note_titles"][0] == "Tea" and states["a"]["conversation"]["created_at"] == "2025-01-01"
    bodies = {(r.thread_id, r.turn_id, r.name): json.loads(r.body) for r in threads.artifacts().collect()}
    assert len(bodies) == 7 * len(turns.ARTIFACTS)
    for r in ledger:
        for name in turns.ARTIFACTS:
            assert r[f"{name}_hash"] == digest(bodies[r["thread_id"], r["turn_id"], name])
    delta = bodies["a", 2, "state_delta"]
    assert delta["prior_thread_state_hash"] == ledger[0]["thread_state_hash"] and delta["next_thread_state_hash"] == ledger[1]["thread_state_hash"]


def test_turns_without_a_store(spark, tmp_path):
    threads = turns.Threads(spark, str(tmp_path))
    assert threads.states() is None and threads.ledger() is None
    asked = spark.createDataFrame([("x", "leaf please"), ("y", None)], "thread_id string, message string")
    rows = {r.thread_id: r for r in turns.run_turns(threads, {}, asked, "now", compiler=services()[0]).collect()}
    assert rows["x"].traversal_manifest.selection_notes == ["ingestion database unavailable"]
    assert rows["x"].blocking_reasons == ["retrieval required but no chunks were selected"]
    with pytest.raises(ValueError):
        turns.run_turns(threads, {}, asked.limit(0), "now")


def test_lists_of_a_compiler():
    assert turns.strings(None) == [] and turns.strings(" a ") == ["a"] and turns.strings(7) == ["7"]
    assert turns.strings(["a", " a", None, {"label": "b"}, {"value": "c"}, {}, ""]) == ["a", "b", "c"]


def test_states_drop_what_is_not_valid(spark):
    state = spark.range(1).select(turns.default_state(F.lit("t"), "now").alias("state"))
    message = "struct<role:string,content:string,turn_id:bigint,created_at:string>"
    given = F.expr(f"array(named_struct('role',' User ','content',' hi ','turn_id',1L,'created_at','x'), named_struct('role','','content','x','turn_id',1L,'created_at','x'), named_struct('role','user','content',' ','turn_id',2L,'created_at','x'))").cast(f"array<{message}>")
    kept = state.select(turns.valid_state(F.col("state").withField("recent_messages", given)).alias("s")).first()["s"]
    assert [(m.role, m.content) for m in kept.recent_messages] == [("user", "hi")] and kept.latest_turn_id == 0


def test_probes_and_command_line(spark, tmp_path, capsys, monkeypatch):
    from tessera import cli

    for name in cli.PROBES:
        assert cli.run_probe(spark, name, str(tmp_path / name))["status"] == "pass"
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "Tea.md").write_text("# Tea\n\ngreen leaf tea\n\nmore on [[Leaf]]\n")
    (tmp_path / "v" / "Leaf.md").write_text("# Leaf\n\nsomething\n")
    monkeypatch.chdir(tmp_path)
    at = ["--store", str(tmp_path / "store")]
    assert cli.main([*at, "ingest", "--source-root", f"x={tmp_path / 'v'}"]) == 0
    assert cli.main([*at, "ask", "green leaf"]) == 1  # no compiler answered, so the gate does not approve
    assert "parsed compiler output is required" in capsys.readouterr().out
    assert cli.main([*at, "turn", "green leaf", "--thread", "t"]) == 1
    assert cli.main([*at, "ingest", "--source-root", f"x={tmp_path / 'v'}"]) == 0
    runs = cli.store.Store(spark, str(tmp_path / "store" / "ingestion")).read("runs").orderBy("inserted").collect()
    assert [(r.inserted, r.unchanged) for r in runs] == [(0, 3), (3, 0)]


def test_backends_by_settings():
    from dataclasses import replace

    config = Config()
    embed, compiler, writer = backends.backends_of(config)
    assert not writer.available and compiler.compile_turn({}).status == "unavailable"
    _, compiler, writer = backends.backends_of(replace(config, compiler=replace(config.compiler, provider="http", base_url="http://localhost:1"), answers=replace(config.answers, provider="probe")))
    assert compiler.compile_turn({"raw_user_input": "x"}).status == "unavailable" and writer.available
    with pytest.raises(ValueError):
        backends.backends_of(replace(config, answers=replace(config.answers, provider="nothing")))


def test_a_stream_stores_each_turn_once(spark, tmp_path, monkeypatch):
    """A stream that fails between two rounds of a batch, and goes on, leaves the ledger of one that was never disturbed."""
    said = [("a", "first", 1), ("a", "second", 2), (None, "new thread", 1), (None, "new thread", 1)], [("a", "third", 1)]
    for i, rows in enumerate(said):
        lines = [json.dumps({"thread_id": t, "message": m, "input_seq": n}) for t, m, n in rows]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(lines))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # a stream takes the oldest first

    def run(name):
        inputs = spark.readStream.schema("thread_id string, message string, input_seq int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        threads = turns.Threads(spark, str(tmp_path / name))
        query = turns.stream_turns(threads, {}, inputs, str(tmp_path / f"{name}-checkpoint"), lambda n: f"batch {n}").trigger(availableNow=True).start()
        query.awaitTermination()
        return threads

    def rows(threads):
        return sorted(map(str, threads.ledger().collect())), sorted(str(r["state"]) for r in threads.states().collect())

    wanted = rows(run("whole"))
    assert len(wanted[0]) == 5 and len(wanted[1]) == 3
    calls, real = [], turns.Threads.add

    def failing(self, made, applied=None):
        calls.append(applied)
        if len(calls) == 2:
            raise OSError("the driver is lost")
        real(self, made, applied)

    with monkeypatch.context() as patch:
        patch.setattr(turns.Threads, "add", failing)
        with pytest.raises(Exception, match="lost"):
            run("broken")
    assert calls == [(0, 1), (0, 2)]
    threads = run("broken")
    assert rows(threads) == wanted and threads.applied() == (1, 1)
    assert rows(run("broken")) == wanted  # nothing is left to do


def test_turns_meet_only_chunks_that_can_be_selected(spark, monkeypatch):
    """Without an index too, of a thread's candidates no more come than can be selected, and each artifact is hashed once."""
    from tessera.functions import text
    from tessera.operators import retrieval
    from tessera.operators.backends import ProbeCompiler, ProbeWriter
    from tessera.plans import retrieve

    made, lexical = [], retrieve.retrieval.fuse
    monkeypatch.setattr(retrieve.retrieval, "fuse", lambda found: made.append(found.count()) or lexical(found))
    fields = "chunk_id string, note_id string, note_seq long, chunk_seq int, note_title string, section_label string, relative_path string, paragraph_text string, chunk_hash string"
    chunks = spark.createDataFrame([(f"c{i:03d}", f"n{i}", i, 0, "T", "s", "", f"green tea {i}", f"h{i}") for i in range(150)], fields)
    inputs = spark.createDataFrame([(f"t{i}", "tell of tea and green leaves") for i in range(6)] + [("none", "zzzz")], "thread_id string, message string")
    rows = turns.run_batch(None, {"chunks": chunks}, inputs, "at", Config(), ProbeCompiler(), None, ProbeWriter()).withColumn("again", F.struct(*[text.json_hash(F.col(c)).alias(c) for c in turns.ARTIFACTS]))
    assert made == [6 * retrieval.TOP_K]
    for r in rows.collect():
        assert r["manifest"].candidate_counts.lexical == (0 if r["thread_id"] == "none" else 150)
        assert [r["ledger_record"][f"{c}_hash"] for c in turns.ARTIFACTS] == [r["again"][c] for c in turns.ARTIFACTS]
        assert r["coverage_report"].retrieval_packet_hash == r["again"].retrieval_packet
