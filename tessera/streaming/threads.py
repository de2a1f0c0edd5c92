"""Conversation state as a fold over turns: in batch with windows, live with a stateful stream; and the ledger.

Batch and stream give the same rows for the same turns: fold_turns and stream_turns keep the last messages of a thread,
fold_states and stream_states its whole state with focus, turns and hashes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.text import json_hash, snippet

MESSAGES = 6
STATE = "thread_id string, latest_turn_id long, recent_messages array<struct<turn_id:long,role:string,content:string>>"


def tail(values: Column, n: int = MESSAGES) -> Column:
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - n + 1), n)


def fold_turns(turns: DataFrame, n: int = MESSAGES) -> DataFrame:
    """(thread_id, latest_turn_id, recent_messages) from turns (thread_id, turn_id, role, content).

    Messages without role or content do not count. Ranking before collecting keeps what a thread collects to n.
    """
    valid = turns.where("role <> '' AND content <> ''")
    newest = Window.partitionBy("thread_id").orderBy(F.desc("turn_id"), F.desc("role"), F.desc("content"))
    kept = valid.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n)
    each = F.array_sort(F.collect_list(F.struct("turn_id", "role", "content")))
    return kept.groupBy("thread_id").agg(F.max("turn_id").alias("latest_turn_id"), each.alias("recent_messages"))


class _Tail(StatefulProcessor):
    """The last messages of each thread, out of order or not: the highest turns stay."""

    def __init__(self, n: int) -> None:
        self._n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._kept = handle.getValueState("kept", "messages array<struct<turn_id:long,role:string,content:string>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self._kept.get()
        kept = [tuple(m) for m in old[0]] if old is not None else []
        for batch in rows:
            kept += [(int(t), r, c) for t, r, c in zip(batch["turn_id"], batch["role"], batch["content"]) if r and c]
        kept = sorted(kept)[-self._n :]
        if not kept:
            return
        self._kept.update((kept,))
        names = ("turn_id", "role", "content")
        yield pd.DataFrame({"thread_id": [key[0]], "latest_turn_id": [kept[-1][0]], "recent_messages": [[dict(zip(names, m)) for m in kept]]})

    def close(self) -> None:
        pass


def stream_turns(turns: DataFrame, n: int = MESSAGES) -> DataFrame:
    """The fold over a stream of turns; each batch gives the new state of the threads in it."""
    return turns.groupBy("thread_id").transformWithStateInPandas(_Tail(n), STATE, "Update", "None")


#: Columns of a turn that its summary and the thread's focus keep.
FOCUS = ("query", "entities", "relations", "retrieval_terms", "vector_query", "graph_seeds", "selected_chunk_ids", "selected_note_titles", "selected_section_labels")


def fold_states(turns: DataFrame, n: int = MESSAGES) -> DataFrame:
    """The state of a thread after each of its turns, with the ledger's hashes.

    turns: thread_id, turn_id, message, response (null if none), created_at (a text, given and not the clock), outcome,
    blocking_reasons, compiler_status, decision, and the columns of FOCUS. Windows reach back n turns and no further.
    The focus is that of the turn, blocked or not.
    """
    order = Window.partitionBy("thread_id").orderBy("turn_id")
    back = order.rowsBetween(1 - n, 0)
    user = F.struct(F.lit("user").alias("role"), F.col("message").alias("content"), "turn_id")
    answer = F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content"), "turn_id")
    said = F.filter(F.array(user, answer), lambda m: F.coalesce(m["content"], F.lit("")) != "")
    summary = F.struct("turn_id", F.col("message").alias("raw_user_input"), snippet(F.coalesce("response", F.lit(""))).alias("assistant_response_snippet"), *FOCUS)
    out = turns.withColumn("_said", said).withColumn("_summary", summary)
    state = F.struct(
        F.struct(*FOCUS).alias("active_focus"),
        F.lit("").alias("conversation_summary"),
        F.col("response").alias("latest_assistant_response"),
        F.lit(None).cast("string").alias("latest_thread_state_hash"),
        F.col("turn_id").alias("latest_turn_id"),
        F.col("message").alias("latest_user_input"),
        tail(F.flatten(F.collect_list("_said").over(back)), n).alias("recent_messages"),
        F.collect_list("_summary").over(back).alias("recent_semantic_turns"),
        "thread_id",
        F.col("created_at").alias("updated_at"),
    )
    out = out.withColumn("state", state).drop("_said", "_summary").withColumn("state_hash", json_hash(F.col("state")))
    out = out.withColumn("prior_state_hash", F.lag("state_hash").over(order))
    delta = F.struct(
        F.col("response").alias("assistant_response"),
        "blocking_reasons",
        F.col("decision").alias("coverage_decision"),
        F.col("state_hash").alias("next_thread_state_hash"),
        F.col("prior_state_hash").alias("prior_thread_state_hash"),
        F.col("message").alias("raw_user_input"),
        F.col("outcome").alias("runtime_outcome"),
        F.col("compiler_status").alias("semantic_compiler_status"),
        "thread_id",
        "turn_id",
    )
    return ledger(out, json_hash(delta))


#: Columns that a stream of turns brings, and what it gives for each of them.
TURN_SCHEMA = (
    "thread_id string, turn_id long, message string, response string, created_at string, outcome string, blocking_reasons array<string>, compiler_status string, decision string, "
    "query string, entities array<string>, relations array<string>, retrieval_terms array<string>, vector_query string, graph_seeds array<string>, "
    "selected_chunk_ids array<string>, selected_note_titles array<string>, selected_section_labels array<string>"
)
STREAMED = "thread_id string, turn_id long, state string, state_hash string, prior_state_hash string, delta_hash string, parent_hash string"


def _digest(value: dict) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _listed(value):
    return None if value is None else [None if x is None else str(x) for x in value]


def next_state(prior: dict | None, turn: dict, n: int = MESSAGES) -> tuple[dict, dict]:
    """What is kept of a thread after a turn, and the row of STREAMED that the turn gives. See fold_states."""
    prior = prior or {"messages": [], "turns": [], "state_hash": None, "delta_hash": None}
    turn_id, focus = int(turn["turn_id"]), {c: turn[c] for c in FOCUS}
    said = [("user", turn["message"]), ("assistant", turn["response"])]
    messages = [*prior["messages"], *({"role": r, "content": c, "turn_id": turn_id} for r, c in said if c)][-n:]
    clean = " ".join((turn["response"] or "").split())
    short = clean if len(clean) <= 120 else clean[:119].rstrip() + "…"
    turns = [*prior["turns"], {"turn_id": turn_id, "raw_user_input": turn["message"], "assistant_response_snippet": short, **focus}][-n:]
    state = {
        "active_focus": focus, "conversation_summary": "", "latest_assistant_response": turn["response"], "latest_thread_state_hash": None, "latest_turn_id": turn_id,
        "latest_user_input": turn["message"], "recent_messages": messages, "recent_semantic_turns": turns, "thread_id": turn["thread_id"], "updated_at": turn["created_at"],
    }
    state_hash = _digest(state)
    delta_hash = _digest({
        "assistant_response": turn["response"], "blocking_reasons": turn["blocking_reasons"], "coverage_decision": turn["decision"], "next_thread_state_hash": state_hash,
        "prior_thread_state_hash": prior["state_hash"], "raw_user_input": turn["message"], "runtime_outcome": turn["outcome"], "semantic_compiler_status": turn["compiler_status"],
        "thread_id": turn["thread_id"], "turn_id": turn_id,
    })
    row = {"thread_id": turn["thread_id"], "turn_id": turn_id, "state": json.dumps(state), "state_hash": state_hash, "prior_state_hash": prior["state_hash"], "delta_hash": delta_hash, "parent_hash": prior["delta_hash"]}
    return {"messages": messages, "turns": turns, "state_hash": state_hash, "delta_hash": delta_hash}, row


class _States(StatefulProcessor):
    """The whole state of each thread, turn by turn."""

    def __init__(self, n: int) -> None:
        self._n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._kept = handle.getValueState("kept", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self._kept.get()
        kept, found = json.loads(old[0]) if old is not None else None, []
        given = [t for batch in rows for t in batch.to_dict("records")]
        for turn in sorted(given, key=lambda t: t["turn_id"]):
            own = {c: _listed(v) if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not isinstance(v, str) and getattr(v, "ndim", 0) else v for c, v in turn.items()}
            kept, row = next_state(kept, own, self._n)
            found.append(row)
        self._kept.update((json.dumps(kept),))
        yield pd.DataFrame(found)

    def close(self) -> None:
        pass


def stream_states(turns: DataFrame, n: int = MESSAGES) -> DataFrame:
    """fold_states over a stream of turns (TURN_SCHEMA): each batch gives a row for each of its turns.

    Turns of a thread have to come in order from batch to batch; within one they are put in order.
    """
    return turns.groupBy("thread_id").transformWithStateInPandas(_States(n), STREAMED, "Append", "None")


def ledger_records(states: DataFrame, artifacts: list[str]) -> DataFrame:
    """The ledger's rows from fold_states: outcome, chain, and the hash of each artifact column as canonical JSON."""
    hashes = [json_hash(F.col(c)).alias(f"{c}_hash") for c in artifacts]
    return states.select(
        "thread_id",
        "turn_id",
        F.col("outcome").alias("runtime_outcome"),
        "blocking_reasons",
        F.col("compiler_status").alias("semantic_compiler_status"),
        F.col("parent_hash").alias("parent_perturbation_hash"),
        F.col("delta_hash").alias("state_perturbation_hash"),
        F.col("delta_hash").alias("state_delta_hash"),
        F.col("state_hash").alias("thread_state_hash"),
        *hashes,
    )


def conversations(states: DataFrame) -> DataFrame:
    """(thread_id, messages): all messages of a thread in order, without a cap."""
    latest = F.struct("turn_id", F.col("message").alias("user"), F.col("response").alias("assistant"))
    return states.groupBy("thread_id").agg(F.array_sort(F.collect_list(latest)).alias("messages"))


def active_focus(selected: DataFrame, lists: dict[str, str]) -> DataFrame:
    """For each query distinct values in rank order; lists: name of the result -> column of `selected`.

    Values are made distinct, each with its first rank, before a query's are collected.
    """
    values = F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).cast("string").alias("value")) for name, c in lists.items()])
    each = selected.select("query_id", "rank", F.explode(values).alias("v"))
    first = each.groupBy("query_id", "v.name", "v.value").agg(F.min("rank").alias("rank"))

    def own(name: str) -> Column:
        kept = F.collect_list(F.when((F.col("name") == name) & F.col("value").isNotNull(), F.struct("rank", "value")))
        return F.transform(F.array_sort(kept), lambda x: x["value"]).alias(name)

    return first.groupBy("query_id").agg(*[own(name) for name in lists])


def ledger(turns: DataFrame, delta: Column | None = None) -> DataFrame:
    """turns with delta_hash, and parent_hash: the delta hash of the thread's turn before.

    The delta is by default all columns of the turn as canonical JSON.
    """
    content = delta if delta is not None else json_hash(F.struct(*turns.columns))
    order = Window.partitionBy("thread_id").orderBy("turn_id")
    return turns.withColumn("delta_hash", content).withColumn("parent_hash", F.lag("delta_hash").over(order))


def broken_links(records: DataFrame) -> DataFrame:
    """Ledger records whose parent_hash is not the delta hash of the turn before; none in a sound ledger."""
    order = Window.partitionBy("thread_id").orderBy("turn_id")
    return records.withColumn("_expected", F.lag("delta_hash").over(order)).where("NOT (parent_hash <=> _expected)").drop("_expected")
