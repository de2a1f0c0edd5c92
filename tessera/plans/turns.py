"""Turns of conversations, many threads at a time: state in, retrieval, gate, answer, next state and ledger out.

A batch takes at most one turn of each thread; further ones of a thread follow in rounds. What a turn leaves is stored
as Parquet behind one pointer: the states and conversations of all threads as a snapshot, and for each run the ledger
records and artifacts that it added. A run that fails leaves nothing that a reader sees.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.config import Config
from tessera.functions.text import json_hash, snippet, strip, text_hash, value_hash
from tessera.operators import packets, retrieval
from tessera.operators.backends import Compiler, Embedder, NoCompiler, NoWriter, Writer
from tessera.operators.store import Part, Store
from tessera.plans.retrieve import INFO, retrieve
from tessera.staging import stage
from tessera.streaming.threads import FOCUS, MESSAGES, tail

_LISTS = "entities:array<string>,relations:array<string>,retrieval_terms:array<string>"
_CHOSEN = "selected_chunk_ids:array<string>,selected_note_titles:array<string>,selected_section_labels:array<string>"
FOCUS_TYPE = f"struct<query:string,{_LISTS},vector_query:string,graph_seeds:array<string>,{_CHOSEN}>"
MESSAGE = "struct<role:string,content:string,turn_id:bigint,created_at:string>"
TURN = f"struct<turn_id:bigint,raw_user_input:string,assistant_response_snippet:string,query:string,{_LISTS},vector_query:string,graph_seeds:array<string>,{_CHOSEN}>"
STATE = (
    f"struct<thread_id:string,latest_turn_id:bigint,conversation_summary:string,recent_messages:array<{MESSAGE}>,recent_semantic_turns:array<{TURN}>,"
    f"active_focus:{FOCUS_TYPE},latest_user_input:string,latest_assistant_response:string,updated_at:string,latest_thread_state_hash:string>"
)
CONVERSATION = (
    "struct<thread_id:string,created_at:string,updated_at:string,turn_count:bigint,latest_turn_id:bigint,latest_thread_state_hash:string,"
    f"latest_perturbation_hash:string,messages:array<{MESSAGE}>>"
)
PAYLOAD = "struct<intent:string,query:string,vector_query:string,entities:array<string>,relations:array<string>,resolved_referents:array<string>,retrieval_terms:array<string>,graph_seeds:array<string>,limitations:array<string>>"
ANSWER = "payload string, response_status string, raw_response string, metadata string, diagnostics string"
PACKET = ("raw_user_input", *packets.TEXTS, *packets.LISTS)
#: What of a turn is stored as an artifact, by the name of its column.
ARTIFACTS = ("semantic_compiler_packet", "semantic_compiler_diagnostic", "traversal_manifest", "retrieval_packet", "coverage_report", "synthesis_context_packet", "state_delta")
REQUIREMENTS = (
    "Answer directly. Use only the coverage-approved retrieval packet when coverage is approved.",
    "Do not describe retrieved notes as independently approved, verified, or authoritative.",
)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def default_state(thread: Column, at: str) -> Column:
    """The state of a thread before its first turn."""
    focus = F.struct(*[(F.lit(None).cast("string") if c in ("query", "vector_query") else _empty("string")).alias(c) for c in _names(FOCUS_TYPE)])
    values = (thread, F.lit(0), F.lit(""), _empty(MESSAGE), _empty(TURN), focus, F.lit(None), F.lit(None), F.lit(at), F.lit(None))
    return F.struct(*values).cast(STATE)


def default_conversation(thread: Column, at: str) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(thread, F.lit(at), F.lit(at), F.lit(0), F.lit(0), none, none, _empty(MESSAGE)).cast(CONVERSATION)


def _names(kind: str) -> list[str]:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(kind).fieldNames()


def valid_state(state: Column) -> Column:
    """The state without messages that lack a role or content, and without turns that lack a number or input; the last six."""
    lowered = F.transform(state["recent_messages"], lambda m: m.withField("role", F.lower(strip(m["role"]))).withField("content", strip(m["content"])))
    messages = F.filter(lowered, lambda m: (F.coalesce(m["role"], F.lit("")) != "") & (F.coalesce(m["content"], F.lit("")) != ""))
    turns = F.filter(state["recent_semantic_turns"], lambda t: t["turn_id"].isNotNull() & (F.coalesce(strip(t["raw_user_input"]), F.lit("")) != ""))
    return state.withField("recent_messages", messages).withField("recent_semantic_turns", tail(turns, MESSAGES))


def strings(value: Any) -> list[str]:
    """What a compiler gave for a list: of a text a list of one; of objects their label; nothing empty, each once."""
    if value is None:
        return []
    found = []
    for entry in value if isinstance(value, list) else [value]:
        if isinstance(entry, dict):
            entry = entry.get("label") or entry.get("resolved_to") or entry.get("surface_form") or entry.get("value")
        clean = "" if entry is None else str(entry).strip()
        if clean:
            found.append(clean)
    return list(dict.fromkeys(found))


def compiled(asked: DataFrame, compiler: Compiler) -> DataFrame:
    """asked (with `request`, JSON) with payload, response_status, raw_response, metadata and diagnostics.

    The compiler is called in Python workers, once for each row; an error of its own is an unavailable answer.
    """

    @F.pandas_udf(ANSWER)
    def answered(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for requests in batches:
            rows = []
            for request in requests:
                try:
                    got = compiler.compile_turn(json.loads(request))
                except Exception as problem:  # a service's failure is not the turn's
                    rows.append((None, "unavailable", None, json.dumps({"error": str(problem)}), "{}"))
                    continue
                payload = None
                if isinstance(got.payload, dict):
                    texts = {c: str(got.payload[c]) for c in packets.TEXTS if got.payload.get(c)}
                    payload = json.dumps({**texts, **{c: strings(got.payload.get(c)) for c in packets.LISTS}})
                rows.append((payload, got.status, got.raw, json.dumps(got.metadata), "{}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])

    out = asked.withColumn("_a", answered.asNondeterministic()(F.col("request")))
    return out.select("*", "_a.*").drop("_a").withColumn("payload", F.from_json("payload", PAYLOAD[7:-1].replace(":", " ")))


def answers(rows: DataFrame, writer: Writer) -> DataFrame:
    """rows with response and answer_metadata: the writer's answer to synthesis_context_packet where the outcome is completed.

    Where the writer fails there is none, the outcome becomes blocked, and the reasons say why; other turns go on. The
    context's hash comes too, as synthesis_context_packet_hash, since its JSON is read here in any case.
    """

    @F.pandas_udf("response string, answer_metadata string, problem string, hash string")
    def written(contexts: pd.Series, outcomes: pd.Series) -> pd.DataFrame:
        out: list[tuple] = []
        for context, outcome in zip(contexts, outcomes):
            given = json.loads(context)
            hashed = value_hash(given)
            if outcome != "completed":
                out.append((None, None, None, hashed))
                continue
            try:
                answer = writer.generate(given)
            except Exception as problem:  # a service's failure is that of one turn
                out.append((None, None, f"{type(problem).__name__}: {problem}", hashed))
                continue
            text, told = answer if isinstance(answer, tuple) else (answer, {})
            out.append((text, json.dumps(told, sort_keys=True), None, hashed))
        return pd.DataFrame(out, columns=["response", "answer_metadata", "problem", "hash"], dtype=object)

    context = F.to_json("synthesis_context_packet", {"ignoreNullFields": "false"})
    made = stage(rows.withColumn("_w", written.asNondeterministic()(context, "outcome")))
    failed = F.col("_w.problem").isNotNull()
    reason = F.concat(F.lit("LLM backend failed: "), "_w.problem")
    out = made.withColumn("outcome", F.when(failed, "blocked").otherwise(F.col("outcome")))
    out = out.withColumn("reasons", F.when(failed, F.concat("reasons", F.array(reason))).otherwise(F.col("reasons")))
    told = {"response": F.col("_w.response"), "answer_metadata": F.col("_w.answer_metadata"), "synthesis_context_packet_hash": F.col("_w.hash")}
    return out.withColumns(told).drop("_w")


def _chosen(name: str) -> Column:
    values = F.transform("retrieval_packet.selected_chunks", lambda c: strip(c[name]))
    return F.array_distinct(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != ""))


def run_batch(states: DataFrame | None, tables: dict[str, DataFrame], inputs: DataFrame, at: str, config: Config, compiler: Compiler, embed: Embedder | None, writer: Writer) -> DataFrame:
    """One turn of each thread of `inputs` (thread_id, message): a row with all that the turn made, staged.

    states: thread_id, state, conversation of known threads. `at` is the time that is written, a text.
    """
    thread = F.col("thread_id")
    known = inputs.withColumn("state", F.lit(None).cast(STATE)).withColumn("conversation", F.lit(None).cast(CONVERSATION))
    if states is not None:
        known = inputs.join(states.select("thread_id", "state", "conversation"), "thread_id", "left")
    begun = known.withColumn("state", valid_state(F.coalesce("state", default_state(thread, at))))
    begun = begun.withColumn("conversation", F.coalesce("conversation", default_conversation(thread, at)))
    begun = begun.withColumn("turn_id", F.col("state.latest_turn_id") + 1).withColumn("query_id", thread)
    begun = begun.withColumn("previous_message", F.coalesce("state.latest_user_input", F.lit("")))
    begun = begun.withColumn("focus_terms", packets.focus_of_state(F.col("state.active_focus"), F.col("state.recent_semantic_turns")))
    begun = begun.withColumn("active_focus", packets.seeds_of_focus(F.col("state.active_focus"))).withColumn("request", packets.request(begun))
    told = stage(compiled(begun, compiler))
    completed = packets.complete_by_backend if getattr(compiler, "merges_focus", False) else packets.complete
    made = completed(packets.compile_packets(told), "payload", "response_status")
    if tables.get("chunks") is None:
        counts = F.struct(*[F.lit(0).cast("long").alias(k) for k in retrieval.PRIORITY])
        parts = F.struct(F.col("retrieval_terms").alias("query_terms"), "vector_query", "graph_seeds", counts.alias("candidate_counts"), _empty("string").alias("selected_chunk_ids"), F.lit(None).cast(INFO).alias("graph_traversal"), F.array(F.lit("ingestion database unavailable")).alias("selection_notes"))
        decided = packets.gate(made.withColumn("manifest", parts).withColumn("selected_count", F.lit(0)))
        chosen = decided.select("query_id", "turn_id").limit(0).select("query_id", F.lit(0).alias("rank"), *[F.lit("").alias(c) for c in ("chunk_id", "note_id", "relative_path", "note_title", "section_label", "paragraph_text", "chunk_hash", "reason")])
    else:
        chosen, decided = retrieve(made, tables, embed, config)
    found = retrieval.packet(chosen, decided.select("query_id"))
    parts = F.struct(F.coalesce("selected_chunks", F.expr("array()").cast(found.schema["selected_chunks"].dataType)).alias("selected_chunks"), "matched_chunk_count", "retrieval_observation", F.lit(True).alias("assembled_from_traversal_manifest"))
    rows = decided.join(found.select("query_id", parts.alias("retrieval_packet")), "query_id")
    rows = rows.withColumn("raw_user_input", F.col("message")).withColumn("semantic_compiler_packet", F.struct(*PACKET))
    said = F.nullif("raw_response", F.lit(""))
    diagnostic = F.struct(
        F.col("response_status").alias("semantic_compiler_response_status"),
        F.col("compiler_status").alias("canonical_semantic_compiler_status"),
        "metadata",
        "diagnostics",
        F.col("payload").isNotNull().alias("parsed_payload_available"),
        said.isNotNull().alias("raw_response_available"),
        text_hash(said).alias("raw_response_hash"),
        snippet(said, 1200).alias("raw_response_preview"),
    )
    rows = rows.withColumn("semantic_compiler_diagnostic", diagnostic).withColumn("traversal_manifest", F.col("manifest"))
    hashed = ("semantic_compiler_diagnostic", "semantic_compiler_packet", "traversal_manifest", "retrieval_packet")
    rows = rows.withColumns({f"{c}_hash": json_hash(F.col(c)) for c in hashed})
    report = F.struct(
        "decision",
        "blocking_reasons",
        F.col("compiler_status").alias("semantic_compiler_status"),
        F.col("response_status").alias("semantic_compiler_response_status"),
        "semantic_compiler_diagnostic_hash",
        F.when(packets.is_valid(), F.col("semantic_compiler_packet_hash")).alias("semantic_compiler_packet_hash"),
        "traversal_manifest_hash",
        "retrieval_packet_hash",
        F.col("selected_count").alias("selected_chunk_count"),
    )
    rows = stage(rows.withColumn("coverage_report", report))
    missing = None if writer.available else getattr(writer, "reason", "no service for answers is configured")
    unavailable = F.when(F.col("decision") == "approved", F.lit(f"LLM backend unavailable: {missing}" if missing else None).cast("string"))
    rows = rows.withColumn("reasons", F.array_compact(F.concat("blocking_reasons", F.array(unavailable))))
    rows = rows.withColumn("outcome", F.when((F.col("decision") == "approved") & (F.size("reasons") == 0), "completed").otherwise("blocked"))
    context = F.struct(
        "thread_id",
        "turn_id",
        "raw_user_input",
        F.col("state").alias("prior_thread_state"),
        tail(F.col("conversation.messages"), MESSAGES).alias("visible_transcript_tail"),
        "semantic_compiler_packet",
        "traversal_manifest",
        F.when(F.col("outcome") == "completed", F.col("retrieval_packet")).alias("approved_retrieval_packet"),
        "coverage_report",
        F.col("outcome").alias("runtime_outcome"),
        F.col("reasons").alias("blocking_reasons"),
        F.array(*[F.lit(r) for r in REQUIREMENTS]).alias("output_requirements"),
    )
    rows = answers(rows.withColumn("synthesis_context_packet", context), writer)
    return stage(_next(rows, at, getattr(writer, "mode", "unavailable" if missing else "live")))


def _next(rows: DataFrame, at: str, mode: str) -> DataFrame:
    """The state, the conversation and the ledger record after each turn."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"), F.col("turn_id").cast("long").alias("turn_id"), F.lit(at).alias("created_at"))

    said = F.filter(F.array(message("user", F.col("message")), message("assistant", F.col("response"))), lambda m: m["content"].isNotNull())
    chosen = {"selected_chunk_ids": _chosen("chunk_id"), "selected_note_titles": _chosen("note_title"), "selected_section_labels": _chosen("section_label")}
    kept = {c: chosen.get(c, F.col(c)) for c in FOCUS}
    texts = ("query", "vector_query")
    focus = F.struct(*[(F.nullif(strip(kept[c]), F.lit("")) if c in texts else kept[c]).alias(c) for c in _names(FOCUS_TYPE)])
    lead = {"turn_id": F.col("turn_id").cast("long"), "raw_user_input": F.col("message"), "assistant_response_snippet": snippet(F.coalesce("response", F.lit("")))}
    turn = F.struct(*[lead.get(c, strip(kept[c]) if c in texts else kept.get(c)).alias(c) for c in _names(TURN)])
    state = F.struct(
        "thread_id",
        F.col("turn_id").cast("long").alias("latest_turn_id"),
        F.col("state.conversation_summary").alias("conversation_summary"),
        tail(F.concat("state.recent_messages", said), MESSAGES).alias("recent_messages"),
        tail(F.concat("state.recent_semantic_turns", F.array(turn)), MESSAGES).alias("recent_semantic_turns"),
        focus.alias("active_focus"),
        F.col("message").alias("latest_user_input"),
        F.col("response").alias("latest_assistant_response"),
        F.lit(at).alias("updated_at"),
        F.lit(None).cast("string").alias("latest_thread_state_hash"),
    )
    # Hashes of a turn are made in Python: few rows, whose nested types would make expressions of many thousand nodes.
    out = rows.withColumn("_state", state).withColumn("thread_state_hash", json_hash(F.col("_state")))
    out = out.withColumn("next_state", F.col("_state").withField("latest_thread_state_hash", F.col("thread_state_hash")).cast(STATE))
    delta = F.struct(
        "thread_id",
        "turn_id",
        "raw_user_input",
        F.col("response").alias("assistant_response"),
        F.col("outcome").alias("runtime_outcome"),
        F.col("reasons").alias("blocking_reasons"),
        F.col("compiler_status").alias("semantic_compiler_status"),
        F.col("decision").alias("coverage_decision"),
        F.col("state.latest_thread_state_hash").alias("prior_thread_state_hash"),
        F.col("thread_state_hash").alias("next_thread_state_hash"),
    )
    out = out.withColumn("state_delta", delta)
    out = out.withColumn("state_delta_hash", json_hash(F.col("state_delta")))
    conversation = F.struct(
        "thread_id",
        F.col("conversation.created_at").alias("created_at"),
        F.lit(at).alias("updated_at"),
        F.col("turn_id").cast("long").alias("turn_count"),
        F.col("turn_id").cast("long").alias("latest_turn_id"),
        F.col("thread_state_hash").alias("latest_thread_state_hash"),
        F.col("state_delta_hash").alias("latest_perturbation_hash"),
        F.concat("conversation.messages", said).alias("messages"),
    )
    out = out.withColumn("next_conversation", conversation.cast(CONVERSATION))
    # What was hashed before is not hashed again.
    hashes = [(F.col(f"{c}_hash") if f"{c}_hash" in rows.columns else json_hash(F.col(c))).alias(f"{c}_hash") for c in ARTIFACTS if c != "state_delta"]
    record = F.struct(
        "thread_id",
        "turn_id",
        F.col("outcome").alias("runtime_outcome"),
        F.col("reasons").alias("blocking_reasons"),
        F.lit(mode).alias("llm_mode"),
        F.col("compiler_status").alias("semantic_compiler_status"),
        F.col("conversation.latest_perturbation_hash").alias("parent_perturbation_hash"),
        F.col("state_delta_hash").alias("state_perturbation_hash"),
        *hashes,
        "state_delta_hash",
        json_hash(F.col("next_conversation")).alias("conversation_thread_hash"),
        "thread_state_hash",
    )
    return out.withColumn("ledger_record", record).drop("_state", *[f"{c}_hash" for c in ARTIFACTS if f"{c}_hash" in rows.columns])


def artifacts(turns: DataFrame) -> DataFrame:
    """(thread_id, turn_id, name, body): each artifact of each turn as JSON."""
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.to_json(c, {"ignoreNullFields": "false"}).alias("body")) for c in ARTIFACTS])
    return turns.select("thread_id", "turn_id", F.explode(each).alias("a")).select("thread_id", "turn_id", "a.*")


class Threads:
    """Stored threads: the newest states and conversations, the ledger, and the artifacts of all turns."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.store = Store(spark, path)

    def states(self) -> DataFrame | None:
        """thread_id, state, conversation; None before the first turn."""
        return self.store.read("threads")

    def ledger(self) -> DataFrame | None:
        return self.store.read("ledger")

    def artifacts(self) -> DataFrame | None:
        return self.store.read("artifacts")

    def applied(self) -> tuple[int, int]:
        """The last batch of a stream, and the last of its rounds, that is stored; (-1, 0) before the first."""
        current = self.store.current() or {}
        return tuple(current.get("applied", (-1, 0)))

    def add(self, turns: DataFrame, applied: tuple[int, int] | None = None) -> None:
        """Store what a batch made: its threads' new states, and what its turns add to ledger and artifacts.

        `applied` is stored in the same step, so it is known whether a round of a stream's batch is in or not.

        Only buckets with a thread of the batch are read and written; ledger and artifacts are logs in buckets of threads.
        """
        fresh = turns.select("thread_id", F.col("next_state").alias("state"), F.col("next_conversation").alias("conversation"))
        touched = sorted(r["b"] for r in fresh.select(self.store.bucket_of("thread_id").alias("b")).distinct().collect())
        old = self.store.read("threads", touched)
        every = fresh if old is None else fresh.unionByName(old.join(fresh.select("thread_id"), "thread_id", "left_anti"))
        self.store.commit(
            {
                "threads": Part(every, "thread_id", only=touched),
                "ledger": Part(turns.select("ledger_record.*"), "thread_id", log=True),
                "artifacts": Part(artifacts(turns), "thread_id", log=True),
            },
            {"applied": list(applied or self.applied())},
        )


def run_turns(threads: Threads, tables: dict[str, DataFrame], inputs: DataFrame, at: str, config: Config | None = None, compiler: Compiler | None = None, embed: Embedder | None = None, writer: Writer | None = None, batch: int | None = None) -> DataFrame | None:
    """Run turns (thread_id, message, and input_seq where a thread has several) and store them; returns their rows.

    A null thread_id begins a thread of its own. Rows: thread_id, turn_id, message, response, runtime_outcome,
    blocking_reasons, the artifacts and the ledger record. With `batch`, the number of a stream's batch, rounds that are stored
    already are not run again, new threads are named by batch and input, and None is returned where nothing is left to do.
    """
    seq = F.col("input_seq") if "input_seq" in inputs.columns else F.lit(0)
    given = inputs.select("thread_id", F.coalesce("message", F.lit("")).alias("message"), seq.alias("input_seq"))
    if batch is None:
        fresh = F.substring(F.translate(F.uuid(), "-", ""), 1, 12)
    else:  # equal inputs are told apart by a number, which of them has which doesn't matter
        alike = F.row_number().over(Window.partitionBy("thread_id", "message", "input_seq").orderBy(F.lit(0)))
        fresh = F.substring(F.sha2(F.concat_ws("\n", F.lit(str(batch)), alike, "input_seq", "message"), 256), 1, 12)
    named = stage(given.withColumn("thread_id", F.coalesce("thread_id", F.concat(F.lit("thread-"), fresh))))
    numbered = stage(named.selectExpr("thread_id", "message", "row_number() OVER (PARTITION BY thread_id ORDER BY input_seq, message) AS round"))
    last, done = numbered.agg(F.max("round").alias("n")).first()["n"] or 0, None
    before = threads.applied() if batch is not None else (-1, 0)
    first = 1 if batch is None or before[0] < batch else before[1] + 1 if before[0] == batch else last + 1
    for number in range(first, last + 1):
        turns = numbered.where(F.col("round") == number).select("thread_id", "message")
        made = run_batch(threads.states(), tables, turns, at, config or Config(), compiler or NoCompiler(), embed, writer or NoWriter())
        threads.add(made, None if batch is None else (batch, number))
        rows = made.select("thread_id", "turn_id", "message", "response", F.col("outcome").alias("runtime_outcome"), F.col("reasons").alias("blocking_reasons"), "answer_metadata", *ARTIFACTS, "ledger_record")
        done = rows if done is None else done.unionByName(rows)
    if done is None and batch is None:
        raise ValueError("no turns were given")
    return done


def stream_turns(threads: Threads, tables: dict[str, DataFrame], inputs: DataFrame, checkpoint: str, at: Callable[[int], str], **services: Any) -> DataStreamWriter:
    """A stream of turns, each run and stored once: start() it, and start it again with the same checkpoint after a failure.

    Each batch goes through run_turns, as a batch without a stream does. A batch that is tried again goes on after the last
    round that was stored, since the store's pointer says which that was. `at` gives a batch's time from its number, so that
    a batch tried again writes the same. Services are those of run_turns; with a log of calls they are not asked twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        run_turns(threads, tables, batch, at(number), batch=number, **services)

    return inputs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
