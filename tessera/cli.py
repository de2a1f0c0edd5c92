"""`python -m tessera.cli ingest ...`, `... ask ...`, `... turn ...` and `... probe ...`: a command line over the library."""

from __future__ import annotations

import argparse
import sys
import tempfile
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config, load
from tessera.operators import packets, store
from tessera.operators.backends import CallLog, LoggedCompiler, LoggedWriter, NoWriter, ProbeCompiler, ProbeWriter, backends_of
from tessera.plans.retrieve import retrieve
from tessera.plans.turns import Threads, run_turns
from tessera.sources import vault

PROBES = ("new-thread", "continue-thread", "lexical-hit")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera")
    out.add_argument("--config")
    out.add_argument("--store")
    commands = out.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="bring the store up to date with note files")
    ingest.add_argument("--source-root", action="append", default=[], help="label=path, any number")
    ask = commands.add_parser("ask", help="rank chunks for a message; exit code 0 if the gate approves")
    ask.add_argument("message")
    turn = commands.add_parser("turn", help="run a turn of a thread; exit code 0 if it is completed")
    turn.add_argument("message")
    turn.add_argument("--thread", help="the thread to go on with; a new one without")
    turn.add_argument("--llm-mode", choices=("auto", "live", "none"), default="auto", help="live: an error without a service for answers")
    turn.add_argument("--model", help="the model for answers, before that of the settings")
    probe = commands.add_parser("probe", help="a smoke test in a folder of its own")
    probe.add_argument("probe", choices=PROBES)
    return out


def stored(own: store.Store, config: Config) -> dict[str, DataFrame | None]:
    """The tables that retrieval reads, by the names it gives them; None for those that are not there."""
    names = {"chunks": "chunks", "chunk_vectors": config.vector_table, "graph_nodes": config.graph_nodes_table, "graph_edges": config.graph_edges_table}
    names |= {name: name for name in ("postings", "members", "lexicon")}
    return {key: own.read(name) for key, name in names.items()}


def run_probe(spark: SparkSession, name: str, folder: str) -> dict:
    """One of PROBES; raises where the turn pipeline does not do what it should."""
    threads = Threads(spark, f"{folder}/threads")

    def turn(message: str, thread: str | None, tables: dict):
        given = spark.createDataFrame([(thread, message)], "thread_id string, message string")
        return run_turns(threads, tables, given, "probe", Config(), ProbeCompiler(), None, ProbeWriter()).first()

    tables: dict = {}
    if name == "lexical-hit":
        chunks = spark.createDataFrame([("c1", "n1", 0, 0, "Snack", "snack.md", "Snack", "candy before bed", "h1")], "chunk_id string, note_id string, note_seq long, chunk_seq int, note_title string, relative_path string, section_label string, paragraph_text string, chunk_hash string")
        tables = {"chunks": chunks}
    first = turn("Start a thread about candy before bed.", None, tables)
    if name == "continue-thread":
        second = turn("Go on.", first.thread_id, tables)
        if second.turn_id != 2 or second.ledger_record.parent_perturbation_hash != first.ledger_record.state_perturbation_hash:
            raise AssertionError("the second turn does not follow the first")
    if name == "lexical-hit" and (first.runtime_outcome != "completed" or not first.retrieval_packet.selected_chunks):
        raise AssertionError("the note was not found")
    records = threads.ledger().count()
    if records != (2 if name == "continue-thread" else 1):
        raise AssertionError("a turn adds one ledger record")
    return {"probe": name, "status": "pass", "thread_id": first.thread_id, "runtime_outcome": first.runtime_outcome, "ledger_count": records}


def main(arguments: list[str] | None = None) -> int:
    given = parser().parse_args(arguments)
    config = load(given.config)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    root = given.store or config.store
    own = store.Store(spark, config.place(config.storage.ingestion, root))
    if given.command == "probe":
        print(run_probe(spark, given.probe, tempfile.mkdtemp(prefix="tessera-probe-")))
        return 0
    embed, compiler, writer = backends_of(config, model=getattr(given, "model", None))
    now = datetime.now(UTC).isoformat(timespec="seconds")
    if given.command == "ingest":
        roots = [vault.parse_root(r) for r in given.source_root or config.roots]
        print(store.ingest(own, vault.read_vault(spark, roots), [label for label, _ in roots], config.embeddings.model, embed, now))
        return 0
    tables = stored(own, config)
    if given.command == "turn":
        if given.llm_mode == "none":
            writer = NoWriter()
        elif given.llm_mode == "live" and not writer.available:
            raise SystemExit(getattr(writer, "reason", "no service for answers is configured"))
        calls = config.place("calls", root)
        compiler, writer = LoggedCompiler(compiler, CallLog(calls, config.compiler.model or "")), LoggedWriter(writer, CallLog(calls, given.model or config.answers.model))
        asked = spark.createDataFrame([(given.thread, given.message)], "thread_id string, message string")
        done = run_turns(Threads(spark, config.place(config.storage.threads, root)), tables, asked, now, config, compiler, embed, writer).first()
        print({"thread_id": done.thread_id, "turn_id": done.turn_id, "outcome": done.runtime_outcome, "blocking_reasons": done.blocking_reasons})
        print(done.response or "")
        return 0 if done.runtime_outcome == "completed" else 1
    if tables["chunks"] is None:
        print("the store is empty")
        return 1
    message = spark.createDataFrame([("q", given.message, "", [])], "query_id string, message string, previous_message string, focus_terms array<string>")
    asked = packets.compile_packets(message).withColumn("compiler_status", F.lit("fallback"))
    selected, decided = retrieve(asked, tables, embed, config)
    selected.orderBy("rank").select("rank", "score", "source", "chunk_id", "reason").show(config.max_retrieval_chunks, False)
    row = decided.select("decision", "blocking_reasons").first()
    print(row.decision, *row.blocking_reasons, sep="\n")
    return 0 if row.decision == "approved" else 1


if __name__ == "__main__":
    sys.exit(main())
