"""Conversation state in batch and as a stream, and the ledger."""

import hashlib
import json
import time

from pyspark.sql import functions as F

from tessera.streaming import threads

TURNS = [(f"t{i % 3}", i, "user" if i % 2 else "assistant", f"say {i}") for i in range(30)] + [("t0", 99, "", "no role"), ("t1", 98, "user", "")]
SCHEMA = "thread_id string, turn_id long, role string, content string"


def test_stream_equals_batch(spark, tmp_path):
    turns = spark.createDataFrame(TURNS, SCHEMA)
    turns.repartition(3).write.parquet(str(tmp_path / "turns"))
    batch = {r.thread_id: r for r in threads.fold_turns(turns).collect()}
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "turns"))
    latest = {}
    query = (
        threads.stream_turns(stream)
        .writeStream.outputMode("update")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .foreachBatch(lambda df, i: latest.update({r.thread_id: r for r in df.collect()}))
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(240)
    assert latest == batch
    assert [m.turn_id for m in batch["t0"].recent_messages] == [12, 15, 18, 21, 24, 27]


def test_ledger(spark):
    turns = spark.createDataFrame(TURNS[:9], SCHEMA)
    records = threads.ledger(turns)
    assert threads.broken_links(records).count() == 0
    assert records.where("parent_hash IS NULL").count() == 3
    forged = records.withColumn("delta_hash", F.when((F.col("thread_id") == "t0") & (F.col("turn_id") == 0), "x").otherwise(F.col("delta_hash")))
    assert threads.broken_links(forged).count() == 1


def test_states_equal_a_fold_over_turns(spark):
    rows = []
    for i in range(1, 10):
        answer = f"answer {i} é" if i % 3 else None
        rows.append(("t", i, f"message {i}", answer, f"2025-01-0{i}", "completed" if answer else "blocked", [] if answer else ["why"], "parsed", "approved", f"q{i}", [], [], ["x"], f"v{i}", ["s"], [f"c{i}"], ["T"], ["S"]))
    schema = "thread_id string, turn_id long, message string, response string, created_at string, outcome string, blocking_reasons array<string>, compiler_status string, decision string, query string, entities array<string>, relations array<string>, retrieval_terms array<string>, vector_query string, graph_seeds array<string>, selected_chunk_ids array<string>, selected_note_titles array<string>, selected_section_labels array<string>"
    got = threads.fold_states(spark.createDataFrame(rows, schema)).orderBy("turn_id").collect()

    def digest(value):
        return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    records = threads.ledger_records(threads.fold_states(spark.createDataFrame(rows, schema)), ["retrieval_terms"]).orderBy("turn_id").collect()
    assert [r.state_perturbation_hash for r in records] == [r.delta_hash for r in got] and records[0].retrieval_terms_hash == digest(["x"])
    whole = threads.conversations(spark.createDataFrame(rows, schema)).first()
    assert [m.turn_id for m in whole.messages] == list(range(1, 10))
    messages, summaries, prior, parent = [], [], None, None
    for row, r in zip(rows, got):
        focus = dict(zip(threads.FOCUS, row[9:]))
        messages += [{"role": "user", "content": row[2], "turn_id": row[1]}] + ([{"role": "assistant", "content": row[3], "turn_id": row[1]}] if row[3] else [])
        summaries.append({"turn_id": row[1], "raw_user_input": row[2], "assistant_response_snippet": row[3] or "", **focus})
        state = {
            "active_focus": focus, "conversation_summary": "", "latest_assistant_response": row[3], "latest_thread_state_hash": None, "latest_turn_id": row[1],
            "latest_user_input": row[2], "recent_messages": messages[-6:], "recent_semantic_turns": summaries[-6:], "thread_id": "t", "updated_at": row[4],
        }
        delta = {
            "assistant_response": row[3], "blocking_reasons": row[6], "coverage_decision": row[8], "next_thread_state_hash": digest(state), "prior_thread_state_hash": prior,
            "raw_user_input": row[2], "runtime_outcome": row[5], "semantic_compiler_status": row[7], "thread_id": "t", "turn_id": row[1],
        }
        assert (r.state_hash, r.prior_state_hash, r.delta_hash, r.parent_hash) == (digest(state), prior, digest(delta), parent)
        prior, parent = digest(state), digest(delta)


def test_streamed_states_equal_batch(spark, tmp_path):
    rows = []
    for i in range(1, 25):
        answer = f"answer {i} é " * 20 if i % 4 else None
        rows.append((f"t{i % 3}", i, f"message {i}", answer, f"2025-01-{i:02d}", "completed" if answer else "blocked", [] if answer else ["why"], "parsed", "approved", None if i % 5 == 0 else f"q{i}", [], ["r"], ["x", "y"], f"v{i}", ["s"], [f"c{i}"], None, ["S"]))
    turns = spark.createDataFrame(rows, threads.TURN_SCHEMA)
    for part in range(3):  # three files, one batch each
        turns.where((F.col("turn_id") > 8 * part) & (F.col("turn_id") <= 8 * part + 8)).coalesce(1).write.mode("append").parquet(str(tmp_path / "turns"))
        time.sleep(1.1)
    stream = spark.readStream.schema(threads.TURN_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "turns"))
    got = []
    query = (
        threads.stream_states(stream)
        .writeStream.outputMode("append")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .foreachBatch(lambda df, i: got.extend(df.collect()))
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(240)
    names = ["thread_id", "turn_id", "state_hash", "prior_state_hash", "delta_hash", "parent_hash"]
    want = {(r.thread_id, r.turn_id): tuple(r[n] for n in names) for r in threads.fold_states(turns).collect()}
    assert {(r.thread_id, r.turn_id): tuple(r[n] for n in names) for r in got} == want
