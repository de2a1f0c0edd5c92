"""End to end: a batch of packets against the stored tables gives ranked chunks, a manifest and a decision for each query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions.text import plain
from tessera.operators.backends import for_queries
from tessera.operators import graph, packets, retrieval, scan, term_index, vector_index
from tessera.staging import stage

INFO = "struct<enabled:boolean,hop_limit:int,seed_sources:array<string>,matched_seed_count:bigint,expanded_note_count:bigint,edge_types_used:array<string>>"
TEXT = ("chunk_id", "note_id", "root_label", "relative_path", "note_title", "section_label", "paragraph_text", "chunk_hash")


def seeds(asked: DataFrame, sources: list[str]) -> DataFrame:
    """(query_id, seed_pos, seed_source, seed) in a fixed order of sources: graph_seeds, retrieval_terms, active_focus."""
    present = [c for c in ("graph_seeds", "retrieval_terms", "active_focus") if c in sources and c in asked.columns]
    if not present:
        return asked.select("query_id", F.lit(0).alias("seed_pos"), F.lit("").alias("seed_source"), F.lit("").alias("seed")).limit(0)
    every = F.concat(*[_named(c) for c in present])
    each = asked.select("query_id", F.posexplode_outer(every).alias("seed_pos", "s"))
    return each.where("s IS NOT NULL").select("query_id", "seed_pos", "s.seed_source", "s.seed")


def _named(source: str):
    clean = F.filter(F.transform(F.coalesce(F.col(source), F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(clean, lambda s: F.struct(F.lit(source).alias("seed_source"), s.alias("seed")))


def _strings(values: list[str]):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _info(own, enabled: bool, seeds_found, notes_found, types) -> F.Column:
    parts = F.struct(F.lit(enabled), F.lit(own.hop_limit), _strings(own.seed_sources), seeds_found.cast("long"), notes_found.cast("long"), types)
    return parts.cast(INFO)


def graph_candidates(asked: DataFrame, chunks: DataFrame, nodes: DataFrame | None, edges: DataFrame | None, config: Config) -> tuple[DataFrame, DataFrame]:
    """(candidates, (query_id, info, note)) of the graph surface; info has six fields, see INFO.

    Without the graph's tables, and for a query without seeds, there are no candidates and the note says so.
    """
    own = config.graph
    none = chunks.select(F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), "chunk_id", F.lit("graph").alias("source"), F.lit(0.0).alias("score"), F.lit("").alias("reason")).limit(0)
    empty = _strings([])
    if not own.enabled or nodes is None or edges is None:
        said = "graph traversal disabled" if not own.enabled else "graph search unavailable"
        info = asked.select("query_id", _info(own, own.enabled, F.lit(0), F.lit(0), empty).alias("info"), F.array(F.lit(said)).alias("notes"))
        return none, info
    given = stage(seeds(asked, own.seed_sources))
    allowed = nodes.where(F.col("node_type").isin(own.node_type_allowlist) & (F.col("ref_id") != ""))
    found = graph.match_seeds(allowed, given, own.token_overlap, own.min_token_overlap)
    matched = stage(found.join(given.select("query_id", "seed_pos", "seed_source"), ["query_id", "seed_pos"]))
    typed = edges.where(F.col("edge_type").isin(own.edge_type_allowlist))
    links = typed.join(allowed.select(F.col("node_id").alias("target_node_id")), "target_node_id", "left_semi")
    reached = stage(graph.visits(matched, links, allowed, own.hop_limit))
    why = graph.reasons(reached, matched, links, allowed, own.hop_limit)
    place = allowed.select("node_id", F.col("ref_id").alias("note_id"))
    named = graph.capped_chunks(reached.join(place, "node_id"), chunks, own.max_candidates)
    candidates = stage(named.join(why.join(place, "node_id").select("query_id", "note_id", "reason"), ["query_id", "note_id"]).select("query_id", "chunk_id", "source", "score", "reason"))
    walked = graph.traversal_info(asked, matched, reached, typed, own.hop_limit)
    asked_for = given.select("query_id").distinct().withColumn("_seeded", F.lit(True))
    counts = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    told = walked.join(asked_for, "query_id", "left").join(counts, "query_id", "left")
    result = F.when(F.col("_n") > 0, F.format_string("graph search matched %d chunk(s)", "_n")).otherwise("graph search produced no matches")
    how = F.format_string("graph traversal enabled=True, hop_limit=%d, matched_seed_count=%d, expanded_note_count=%d", F.lit(own.hop_limit), "matched_seed_count", "expanded_note_count")
    notes = F.when(F.col("_seeded"), F.array(result, how)).otherwise(F.array(F.lit("graph search skipped: no graph seeds")))
    info = told.select("query_id", _info(own, True, F.col("matched_seed_count"), F.col("expanded_note_count"), F.col("edge_types_used")).alias("info"), notes.alias("notes"))
    return candidates, info


def _surface_note(name: str, count: str, asked, skipped: str) -> F.Column:
    """What the manifest says of the lexical or the vector surface; none where nothing was asked of the lexical one."""
    found = F.when(F.col(count) > 0, F.format_string(f"{name} search matched %d chunk(s)", count)).otherwise(f"{name} search produced no matches")
    return F.when(asked, found).otherwise(F.lit(skipped or None).cast("string"))


def nearest(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, hygiene: DataFrame, others: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(candidates, (query_id, vector)) of the vector surface: chunks that can be selected, and the number of positive cosines.

    What cannot be selected by its vector alone still counts where another surface found the chunk.
    """
    flag = retrieval.is_boilerplate(F.col("note_title"), F.col("relative_path"), F.col("section_label"), F.col("paragraph_text"))
    known = vectors.select("chunk_id", "vector").join(chunks.select("chunk_id", F.col("chunk_hash").alias("content"), flag.alias("boilerplate")), "chunk_id")
    index = vector_index.build(known)
    asked = queries.join(hygiene.withColumnRenamed("_templates", "templates"), "query_id")
    best, counts = vector_index.search(index, asked, k, counts=True)
    index.release()
    pairs = others.select("query_id", "chunk_id").distinct().join(queries.withColumnRenamed("vector", "_asked"), "query_id").join(vectors.select("chunk_id", "vector"), "chunk_id")
    cosine = retrieval.cosine(F.col("vector").cast("array<double>"), F.col("_asked").cast("array<double>")).alias("similarity")
    also = pairs.join(best, ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", cosine).where("similarity > 0")
    return stage(retrieval.vector_candidates(best.select("query_id", "chunk_id", "similarity").unionByName(also))), counts


def retrieve(asked: DataFrame, tables: dict[str, DataFrame], embed: Callable[[DataFrame], DataFrame] | None, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """(selected chunks by query and rank, packets with manifest, selected_count and decision) for packets.

    Of the vector surface come the chunks that can be selected by it and those that another surface found too.
    tables: chunks, and where there are any chunk_vectors, graph_nodes, graph_edges, and the parts of the term index. The
    lexical surface gives only the chunks that can be selected, and the number of all, from the index or by one pass over the
    texts. Each surface is staged, so no plan holds more than one of them.
    """
    config = config or Config()
    chunks = tables["chunks"]
    asked = stage(asked)
    said = plain(F.concat_ws(" ", "message", "intent", "query", "vector_query", *packets.LISTS[:-1]))
    hygiene = stage(asked.select("query_id", retrieval.is_template_query(said).alias("_templates")))
    terms = asked.select("query_id", F.col("retrieval_terms").alias("terms"))
    flagged, k = terms.join(hygiene.withColumnRenamed("_templates", "templates"), "query_id"), max(1, config.max_retrieval_chunks)
    if all(tables.get(n) is not None for n in ("postings", "members", "lexicon")):
        index = term_index.TermIndex(tables["postings"], tables["members"], tables["lexicon"])
        top, lexical_counts = term_index.search(index, flagged, k, chunks)
    else:
        top, lexical_counts = scan.search(chunks, flagged, k)
    found = top.select("query_id", "chunk_id", "source", "score", "reason")
    graphed, walked = graph_candidates(asked, chunks, tables.get("graph_nodes"), tables.get("graph_edges"), config)
    vectors, vector_counts = tables.get("chunk_vectors"), None
    searched = embed is not None and vectors is not None
    if searched:
        queries = stage(for_queries(embed)(asked.where("trim(vector_query) <> ''").select("query_id", F.col("vector_query").alias("text"))).select("query_id", "vector"))
        near, vector_counts = nearest(chunks, vectors, queries, hygiene, found.unionByName(graphed), k)
        found = found.unionByName(near)
    found = found.unionByName(graphed)
    text = chunks.select(*[c for c in TEXT if c in chunks.columns])
    judged = found.join(text, "chunk_id").join(hygiene, "query_id")
    boilerplate = retrieval.is_boilerplate(F.col("note_title"), F.col("relative_path"), F.col("section_label"), F.col("paragraph_text"))
    demoted = retrieval.demote(judged, boilerplate & ~F.col("_templates"))
    fused = retrieval.fuse(demoted.select("query_id", "chunk_id", "source", "score", "reason", "demoted")).join(text, "chunk_id")
    selected = stage(retrieval.select_top(fused, config.max_retrieval_chunks))
    ids = selected.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("_ids"))
    counts = retrieval.candidate_counts(found, asked)
    for name, exact in (("lexical", lexical_counts), ("vector", vector_counts)):
        if exact is not None:
            counts = counts.drop(name).join(exact, "query_id", "left").fillna(0, [name])
    told = asked.join(ids, "query_id", "left").join(counts, "query_id").join(walked, "query_id")
    chosen = F.coalesce(F.transform("_ids", lambda x: x["chunk_id"].cast("string")), F.array().cast("array<string>"))
    lexical_note = _surface_note("lexical", "lexical", F.size("retrieval_terms") > 0, "")
    vector_note = _surface_note("vector", "vector", F.trim("vector_query") != "", "vector search skipped: empty query") if searched else F.lit("vector search unavailable")
    manifest = F.struct(
        F.col("retrieval_terms").alias("query_terms"),
        "vector_query",
        "graph_seeds",
        F.struct("lexical", "vector", "graph").alias("candidate_counts"),
        chosen.alias("selected_chunk_ids"),
        F.col("info").alias("graph_traversal"),
        F.concat(F.array_compact(F.array(lexical_note, vector_note)), "notes").alias("selection_notes"),
    )
    with_manifest = told.withColumn("manifest", manifest).withColumn("selected_count", F.size(chosen)).drop("_ids", "lexical", "vector", "graph", "info", "notes")
    return selected, packets.gate(stage(with_manifest))
