"""Query packets from messages, their completion by a compiler's payload, and the gate before an answer.

A packet is the query form that the surfaces read: retrieval_terms for the lexical one, vector_query for the vector
one, graph_seeds for the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import distinct_in_order, is_referential, snippet, strip, terms, text_hash

#: A referring message with fewer terms takes terms from what came before; so many of them go into the query.
FEW_TERMS, FOCUS_IN_QUERY = 4, 8
LISTS = ("entities", "relations", "resolved_referents", "retrieval_terms", "graph_seeds", "limitations")
#: What a packet that no compiler made says of itself.
FALLBACK_INTENT = "deterministic lexical fallback"
FALLBACK_LIMITATION = "semantic compiler backend unavailable; deterministic lexical fallback used"
#: What the terms of a focus, and of an earlier turn, are taken from, in this order.
FOCUS_PARTS = ("retrieval_terms", "graph_seeds", "selected_note_titles", "selected_section_labels", "query", "vector_query")
TURN_PARTS = ("query", "retrieval_terms", "vector_query", "graph_seeds", "selected_note_titles", "selected_section_labels", "entities", "relations")
TEXTS = ("intent", "query", "vector_query")


def _strings(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def compile_packets(messages: DataFrame) -> DataFrame:
    """messages (query_id, message, previous_message, focus_terms: array) with the packet's columns added."""
    own = terms(F.col("message"))
    focus = distinct_in_order(F.filter(_strings("focus_terms"), lambda t: t != ""))
    refers = is_referential(F.col("message")) & (F.size(own) < FEW_TERMS)
    used = F.when(refers, focus).otherwise(F.array().cast("array<string>"))
    query = F.trim(F.concat_ws(" ", F.trim(F.col("message")), F.nullif(F.array_join(F.slice(used, 1, FOCUS_IN_QUERY), " "), F.lit(""))))
    out = messages.withColumn("retrieval_terms", distinct_in_order(F.concat(own, used))).withColumn("query", query)
    seeds = F.array("query", F.trim(F.coalesce(F.col("previous_message"), F.lit(""))))
    none = F.array().cast("array<string>")
    return (
        out.withColumn("intent", F.lit(FALLBACK_INTENT))
        .withColumn("vector_query", F.col("query"))
        .withColumn("graph_seeds", F.when(F.size("retrieval_terms") > 0, distinct_in_order(F.filter(seeds, lambda s: s != ""))).otherwise(none))
        .withColumns({c: none for c in ("entities", "relations", "resolved_referents")})
        .withColumn("limitations", F.array(F.lit(FALLBACK_LIMITATION)))
    )


def focus_terms(*values: Column) -> Column:
    """Distinct terms of what a focus holds (texts or arrays of them): of each item its terms, then the item itself."""
    items = F.concat(*[F.coalesce(v, F.array().cast("array<string>")) for v in values])
    clean = F.filter(F.transform(items, lambda i: F.trim(i)), lambda i: i != "")
    return distinct_in_order(F.flatten(F.transform(clean, lambda i: F.concat(terms(i), F.array(i)))))


def _parts(of: Column, names: tuple[str, ...]) -> Column:
    lists = {"entities", "relations", "retrieval_terms", "graph_seeds", "selected_note_titles", "selected_section_labels"}
    return focus_terms(*[of[n] if n in lists else F.array(F.coalesce(of[n], F.lit(""))) for n in names])


def focus_of_state(focus: Column, recent: Column) -> Column:
    """What a referring message may take up: the terms of the active focus, then those of the last two turns."""
    last = F.slice(recent, F.greatest(F.lit(1), F.size(recent) - 1), 2)
    turns = F.flatten(F.transform(last, lambda t: _parts(t, TURN_PARTS)))
    none = F.array().cast("array<string>")
    return distinct_in_order(F.concat(F.coalesce(_parts(focus, FOCUS_PARTS), none), F.coalesce(turns, none)))


def seeds_of_focus(focus: Column) -> Column:
    """The seeds that an active focus gives the graph surface, in order."""
    texts = [F.array(F.coalesce(focus[n], F.lit(""))) for n in ("query", "vector_query")]
    lists = [F.coalesce(focus[n], F.array().cast("array<string>")) for n in ("retrieval_terms", "graph_seeds", "selected_note_titles", "selected_section_labels")]
    return F.filter(F.transform(F.concat(*texts, *lists), lambda x: F.trim(x)), lambda x: x != "")


def request(states: DataFrame) -> Column:
    """The request to a compiler as JSON: the message, the state before it, and what to do."""
    told = F.lit("Compile a minimal semantic target for traversal. Do not answer the user.")
    parts = F.struct(
        F.col("message").alias("raw_user_input"),
        F.col("state").alias("prior_thread_state"),
        F.col("state.recent_messages").alias("recent_messages"),
        F.col("state.recent_semantic_turns").alias("recent_semantic_turns"),
        F.col("state.active_focus").alias("active_focus"),
        told.alias("instruction"),
    )
    return F.to_json(parts, {"ignoreNullFields": "false"})


def complete_by_backend(packets: DataFrame, payload: str = "payload", status: str | None = None) -> DataFrame:
    """What a compiler backend does with its own payload before it answers.

    As complete(); then missing terms come from the query, a referring message gets all focus_terms, six of them also
    in vector_query, and missing seeds are the query. A packet without a parsed payload stays as complete() leaves it.
    """
    out = complete(packets, payload, status)
    parsed = F.col("compiler_status") != "fallback"
    own = F.when(F.size("retrieval_terms") > 0, F.col("retrieval_terms")).otherwise(terms(F.col("query")))
    focus = F.filter(_strings("focus_terms"), lambda t: t != "")
    refers = parsed & is_referential(F.col("message")) & (F.size(focus) > 0)
    more = F.concat_ws(" ", F.trim("vector_query"), F.array_join(F.slice(focus, 1, 6), " "))
    out = out.withColumn("vector_query", F.when(refers & (F.trim("vector_query") != ""), more).otherwise(F.col("vector_query")))
    out = out.withColumn("retrieval_terms", F.when(refers, distinct_in_order(F.concat(own, focus))).otherwise(own))
    seeded = (F.size("graph_seeds") == 0) & (F.size("retrieval_terms") > 0)
    return out.withColumn("graph_seeds", F.when(seeded, F.array("query")).otherwise(F.col("graph_seeds")))


def diagnostic(packets: DataFrame, raw: str = "raw_response") -> DataFrame:
    """packets with what is known of the compiler's raw answer: whether there is one, its hash, a preview."""
    said = F.nullif(F.col(raw), F.lit(""))
    return (
        packets.withColumn("raw_response_available", said.isNotNull())
        .withColumn("raw_response_hash", text_hash(said))
        .withColumn("raw_response_preview", snippet(said, 1200))
    )


def complete(packets: DataFrame, payload: str = "payload", status: str | None = None) -> DataFrame:
    """Packets whose fields give way to the non-empty ones of the struct column `payload`; compiler_status says so.

    vector_query without a value is the query, the new one where there is one. Where no terms are left they are those
    of the query, and where there are terms but no seeds the query is the seed. A null payload, or one whose answer has
    another `status` (a column) than parsed, leaves the packet as it is, with status `fallback`.
    """
    given = packets.schema[payload].dataType.fieldNames()
    parsed = F.col(payload).isNotNull() if status is None else F.col(payload).isNotNull() & (F.col(status) == "parsed")

    def said(name: str) -> Column:
        return F.nullif(strip(F.col(f"{payload}.{name}")), F.lit("")) if name in given else F.lit(None).cast("string")

    changes = {c: F.when(parsed, F.coalesce(said(c), F.col(c))).otherwise(F.col(c)) for c in ("intent", "query")}
    changes["vector_query"] = F.when(parsed, F.coalesce(said("vector_query"), changes["query"])).otherwise(F.col("vector_query"))
    for c in LISTS:
        if c in given:
            clean = F.filter(F.transform(f"{payload}.{c}", strip), lambda x: x != "")
            changes[c] = F.when(parsed & (F.size(clean) > 0), distinct_in_order(clean)).otherwise(F.col(c))
    out = packets.withColumns({**changes, "compiler_status": F.when(parsed, "parsed").otherwise("fallback")})
    missing = (F.col("compiler_status") == "parsed") & (F.size("retrieval_terms") == 0)
    out = out.withColumn("retrieval_terms", F.when(missing, terms(F.col("query"))).otherwise(F.col("retrieval_terms")))
    seedless = (F.col("compiler_status") == "parsed") & (F.size("graph_seeds") == 0) & (F.size("retrieval_terms") > 0)
    return out.withColumn("graph_seeds", F.when(seedless, F.array("query")).otherwise(F.col("graph_seeds")))


def is_valid() -> Column:
    """Texts and lists of the packet are all there."""
    out = F.lit(True)
    for c in (*TEXTS, *LISTS):
        out = out & F.col(c).isNotNull()
    return out


def gate(packets: DataFrame) -> DataFrame:
    """packets with selected_count: adds blocking_reasons, decision and, with llm_available, outcome.

    Blocked if the packet was not parsed or is malformed, or if something was asked for and nothing selected.
    """
    asked = (F.size("retrieval_terms") > 0) | (F.size("graph_seeds") > 0)
    status = F.col("compiler_status")
    reasons = F.array_compact(
        F.array(
            F.when(status != "parsed", F.concat(F.lit("semantic compiler status is "), status, F.lit("; parsed compiler output is required"))),
            F.when(~is_valid(), F.lit("semantic compiler packet is missing or malformed")),
            F.when((F.col("selected_count") == 0) & asked, F.lit("retrieval required but no chunks were selected")),
        )
    )
    out = packets.withColumn("blocking_reasons", reasons)
    out = out.withColumn("decision", F.when(F.size("blocking_reasons") == 0, "approved").otherwise("blocked"))
    if "llm_available" in packets.columns:
        done = (F.col("decision") == "approved") & F.col("llm_available")
        out = out.withColumn("outcome", F.when(done, "completed").otherwise("blocked"))
    return out


def synthesis_context(decided: DataFrame, retrieved: DataFrame) -> DataFrame:
    """decided (of gate, with outcome) with `context`: the packet, and what was retrieved only where it is completed.

    retrieved: query_id and a struct column `retrieval`.
    """
    joined = decided.join(retrieved.select("query_id", "retrieval"), "query_id", "left")
    given = F.when(F.col("outcome") == "completed", F.col("retrieval")).alias("retrieval")
    return joined.withColumn("context", F.struct("message", *TEXTS, *LISTS, "decision", "blocking_reasons", given)).drop("retrieval")
