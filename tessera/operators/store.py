"""Incremental maintenance of the stored tables: classification of changes, deletes, vectors, buckets, manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.text import text_hash
from tessera.operators import graph, term_index
from tessera.operators.notes import chunks as chunks_of
from tessera.operators.notes import embedding_text
from tessera.operators.notes import notes as notes_of
from tessera.staging import release, stage


def classify(incoming: DataFrame, existing: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """incoming, plus change_type: inserted, unchanged (all of `compare` equal) or updated."""
    old = existing.select(key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_old_{c}") for c in compare])
    equal = F.lit(True)
    for c in compare:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    joined = incoming.join(old, key, "left")
    kind = F.when(F.col("_there").isNull(), "inserted").when(equal, "unchanged").otherwise("updated")
    return joined.withColumn("change_type", kind).drop("_there", *[f"_old_{c}" for c in compare])


def absent(existing: DataFrame, incoming: DataFrame, key: str, scope: Column) -> DataFrame:
    """Existing rows within `scope` that the run no longer has."""
    return existing.where(scope).join(incoming.select(key), key, "left_anti")


def upsert(incoming: DataFrame, existing: DataFrame, key: str, scope: Column) -> DataFrame:
    """The next snapshot: incoming rows, and existing ones out of scope."""
    kept = existing.where(~scope).join(incoming.select(key), key, "left_anti")
    return incoming.select(*existing.columns).unionByName(kept)


def change_counts(classified: DataFrame, deleted: DataFrame) -> DataFrame:
    """One row: inserted, updated, unchanged, deleted."""
    kinds = [F.count_if(F.col("change_type") == k).alias(k) for k in ("inserted", "updated", "unchanged")]
    return classified.agg(*kinds).crossJoin(F.broadcast(deleted.agg(F.count(F.lit(1)).alias("deleted"))))


def stale(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Chunks whose text as embedded, or model, is not that of a stored vector."""
    wanted = chunks.withColumn("content_hash", text_hash(embedding_text())).withColumn("model", F.lit(model))
    return wanted.join(vectors.select("chunk_id", "content_hash", "model"), ["chunk_id", "content_hash", "model"], "left_anti")


def refresh_vectors(chunks: DataFrame, vectors: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Vectors of this run's chunks: kept where text and model are the same, else from `embed`.

    embed gets (chunk_id, content_hash, model, text) and adds vector. No chunk leaves no vector.
    """
    fresh = embed(stale(chunks, vectors, model).select("chunk_id", "content_hash", "model", embedding_text().alias("text")))
    wanted = chunks.select("chunk_id", text_hash(embedding_text()).alias("content_hash"), F.lit(model).alias("model"))
    kept = vectors.join(wanted, ["chunk_id", "content_hash", "model"], "left_semi")
    columns = ["chunk_id", "content_hash", "model", "vector"]
    return kept.select(*columns).unionByName(fresh.select(*columns))


def probe_embedding(rows: DataFrame, words: tuple[str, ...] = ("note", "link")) -> DataFrame:
    """A deterministic stand-in for a model: length of the text, and how often each of `words` occurs in it."""
    text = F.lower("text")
    counts = [((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)).cast("double") for w in words]
    return rows.withColumn("vector", F.array(F.length(text).cast("double"), *counts))


#: The columns of the stored tables; notes and chunks have those of operators.notes.
SCHEMAS = {
    "chunk_vectors": "chunk_id string, content_hash string, model string, vector array<double>",
    "graph_nodes": "node_id string, node_type string, label string, ref_id string, node_seq long",
    "graph_edges": "edge_id string, source_node_id string, target_node_id string, edge_type string, edge_order struct<note_seq:long,kind:int,pos:int>",
    "manifest": "note_id string, note_title string, note_hash string, chunk_ids array<string>",
    "runs": "run string, generated_at string, model string, labels array<string>, notes long, chunks long, inserted long, updated long, unchanged long, deleted long, deleted_notes long",
}


#: What a segment is: the rows of one bucket of a table, as one run wrote them.
SEGMENT = "name string, bucket int, run string, digest string, rows long"
#: Buckets of a new store; a bucket should hold a few thousand rows, and is what a change rewrites.
BUCKETS = 16
#: Segments of a bucket of a log, beyond which a run writes them anew as one.
LOG_SEGMENTS = 8


def _nullable(schema: dict) -> dict:
    """The schema as Parquet gives it back: everything may be null."""
    out = {k: _nullable(v) if isinstance(v, dict) else v for k, v in schema.items()}
    out |= {k: True for k in ("nullable", "containsNull", "valueContainsNull") if k in out}
    return out | ({"fields": [_nullable(f) for f in out["fields"]]} if "fields" in out else {})


@dataclass
class Part:
    """Rows for a table: dealt to buckets by the hash of `key`, by `bucket`, or all to bucket 0.

    With `only` they are all rows of those buckets, and the table's other buckets stay. A log's rows are added to it.
    """

    rows: DataFrame
    key: str | None = None
    bucket: Column | None = None
    only: list[int] | None = None
    log: bool = False


class Store:
    """Tables in buckets under one folder, by any file system that Spark writes to.

    A run writes the buckets that differ from what is stored, then the list of all segments, and moves a pointer last: a
    reader sees the old run or the new, and a run that failed leaves nothing that is read. A bucket of a table is one
    segment; one of a log has LOG_SEGMENTS at most. So a read names a bounded number of folders, however many runs there were.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        current = self.current()
        self.buckets = current["buckets"] if current else buckets

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at, jvm

    def current(self) -> dict | None:
        return self.read_json("current.json")

    def bucket_of(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def segments(self, current: dict | None) -> list[tuple]:
        """(name, bucket, run, digest, rows): a few for each bucket of each table."""
        if current is None:
            return []
        return [tuple(r) for r in self.spark.read.schema(SEGMENT).parquet(f"{self.path}/segments/{current['run']}").collect()]

    def read(self, name: str, only: list[int] | None = None) -> DataFrame | None:
        """A table or log as of the current run, or some of its buckets; None where no run has written it."""
        current = self.current()
        if current is None or name not in current["schemas"]:
            return None
        return self._read(name, current, self.segments(current), only)

    def _read(self, name: str, current: dict, segments: list[tuple], only: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(current["schemas"][name])
        paths = [f"{self.path}/{name}/{run}/bucket={b}" for n, b, run, _, _ in segments if n == name and (only is None or b in only)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def new_run() -> str:
        return f"run-{uuid.uuid4().hex[:12]}"

    def _dealt(self, part: Part) -> DataFrame:
        bucket = part.bucket if part.bucket is not None else self.bucket_of(part.key) if part.key else F.lit(0)
        return part.rows.withColumn("bucket", F.coalesce(bucket, F.lit(0)).cast("int"))

    def digests(self, part: Part) -> dict[int, tuple[str, int]]:
        """For each bucket a digest of its rows, in any order, and their number."""
        # Maps cannot be hashed as they are.
        hashable = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in part.rows.schema]
        row = F.xxhash64(*hashable)
        sums = F.concat_ws(":", F.bit_xor("_h"), F.sum(F.pmod("_h", F.lit(1 << 40))))
        found = self._dealt(part).withColumn("_h", row).groupBy("bucket").agg(sums.alias("digest"), F.count(F.lit(1)).alias("n"))
        return {r["bucket"]: (r["digest"], r["n"]) for r in found.collect()}  # a row for each bucket

    def changed(self, name: str, part: Part) -> list[int]:
        """Buckets of a table that differ from what is stored, those that lose all rows included."""
        old = {b: digest for n, b, _, digest, _ in self.segments(self.current()) if n == name}
        new = {b: digest for b, (digest, _) in self.digests(part).items()}
        return sorted(b for b in {*old, *new} if old.get(b) != new.get(b))

    def _write(self, name: str, run: str, rows: DataFrame) -> None:
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/{run}")

    def commit(self, tables: dict[str, DataFrame | Part], summary: dict) -> dict:
        """Write what changed, then the list of segments and the manifest, and move the pointer last."""
        current = self.current()
        run = summary.setdefault("run", self.new_run())
        segments, schemas, written = self.segments(current), dict(current["schemas"]) if current else {}, {}
        for name, given in tables.items():
            part = given if isinstance(given, Part) else Part(given)
            schema = _nullable(part.rows.schema.jsonValue())
            own = [s for s in segments if s[0] == name]
            if schemas.get(name, schema) != schema:
                own = [(n, b, r, "", k) for n, b, r, _, k in own]  # stored in another form: nothing is as it was
            schemas[name] = schema
            digests, kept, rows = self.digests(part), own, self._dealt(part)
            if part.log:
                full = [b for b in digests if sum(s[1] == b for s in own) >= LOG_SEGMENTS]
                if full:
                    before = self._read(name, current, own, full).select(*part.rows.columns)
                    merged = Part(before, part.key, part.bucket)
                    rows = rows.unionByName(self._dealt(merged))
                    for b, (digest, n) in self.digests(merged).items():
                        digests[b] = (digest, n + digests[b][1])
                    kept = [s for s in own if s[1] not in full]
                changes = sorted(digests)
            else:
                old = {s[1]: s[3] for s in own}
                within = {*old, *digests} if part.only is None else set(part.only)
                changes = sorted(b for b in within if b in digests and digests[b][0] != old.get(b))
                kept = [s for s in own if s[1] not in within or s[1] in digests and s[1] not in changes]
            if changes:
                self._write(name, run, rows.where(F.col("bucket").isin(changes)))
            written[name] = changes
            segments = [s for s in segments if s[0] != name] + kept + [(name, b, run, *digests[b]) for b in changes]
        self.spark.createDataFrame(segments, SEGMENT).coalesce(1).write.parquet(f"{self.path}/segments/{run}")
        summary |= {"buckets": self.buckets, "schemas": schemas, "written": written}
        self.write_json(f"manifests/{run}.json", summary)
        self.write_json("current.json", summary)
        return summary

    def vacuum(self) -> int:
        """Delete what runs wrote that the current one does not name; returns the number of folders deleted.

        Readers of an older run must be done. What a failed run left goes too.
        """
        current, gone = self.current(), 0
        if current is None:
            return 0
        used = {(n, run, f"bucket={b}") for n, b, run, _, _ in self.segments(current)}
        used_runs = {(n, run) for n, run, _ in used} | {("segments", current["run"])}
        for name in [*current["schemas"], "segments"]:
            fs, at, jvm = self._fs(f"{self.path}/{name}")
            for run in fs.listStatus(at) if fs.exists(at) else []:
                if (name, run.getPath().getName()) not in used_runs:
                    gone += fs.delete(run.getPath(), True)
                    continue
                for bucket in fs.listStatus(run.getPath()) if name != "segments" else []:
                    if bucket.isDirectory() and (name, run.getPath().getName(), bucket.getPath().getName()) not in used:
                        gone += fs.delete(bucket.getPath(), True)
        return gone

    def write_json(self, name: str, value: dict) -> None:
        """Write a JSON document; one of that name is replaced in one step, so a reader finds the old or the new."""
        fs, at, jvm = self._fs(f"{self.path}/{name}")
        temporary = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}.{uuid.uuid4().hex}.new")
        out = fs.create(temporary, True)
        out.write(bytearray((json.dumps(value, indent=2) + "\n").encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(temporary), fs.makeQualified(at), how)

    def read_json(self, name: str) -> dict | None:
        """A JSON document of the store; None where there is none."""
        fs, at, _ = self._fs(f"{self.path}/{name}")
        if not fs.exists(at):
            return None
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect()))


def ingest(store: Store, files: DataFrame, labels: list[str], model: str = "probe", embed: Callable[[DataFrame], DataFrame] = probe_embedding, at: str = "") -> dict:
    """Bring the store up to date with the note files of the roots `labels`; returns the manifest.

    Notes and chunks of other roots stay; the graph and the vectors are those of this run. Files are parsed once: notes
    and chunks are staged before they are counted, compared and written. Buckets of notes that did not change are not
    written, nor indexed anew: a block of the term index is a bucket of chunks. The row of the run itself is committed with it.
    """
    whole = stage(notes_of(files))
    parsed, pieces = whole.drop("body"), stage(chunks_of(whole))
    scope = F.col("root_label").isin(labels)
    old_notes, old_chunks, old_vectors, old_words, old_runs = (store.read(n) for n in ("notes", "chunks", "chunk_vectors", "lexicon", "runs"))
    empty = store.spark.createDataFrame([], SCHEMAS["chunk_vectors"])
    old_notes = parsed.limit(0) if old_notes is None else old_notes
    old_chunks = pieces.limit(0) if old_chunks is None else old_chunks
    old_vectors = empty if old_vectors is None else old_vectors
    classified = stage(classify(pieces, old_chunks, "chunk_id", ["chunk_hash", "paragraph_text"]).select("chunk_id", "change_type"))
    counts = change_counts(classified, absent(old_chunks, pieces, "chunk_id", scope)).first().asDict()
    gone = absent(old_notes, parsed, "note_id", scope).count()
    nodes, edges = graph.build(parsed, pieces)
    per_note = pieces.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("chunk_seq", "chunk_id"))).alias("ids"))
    manifest = parsed.join(per_note, "note_id", "left").select("note_id", "note_title", "note_hash", F.transform("ids", lambda i: i["chunk_id"]).alias("chunk_ids"))
    every = Part(upsert(pieces, old_chunks, "chunk_id", scope), "note_id")
    touched = store.changed("chunks", every)
    block = store.bucket_of("note_id")
    index = term_index.build(every.rows.where(block.isin(touched)), block)
    words = index.lexicon if old_words is None else index.lexicon.join(old_words, ["gram", "word"], "left_anti")
    vectors = stage(refresh_vectors(pieces, old_vectors, model, embed))  # embeds once, though the rows are read twice
    summary = {"run": store.new_run(), "labels": labels, "generated_at": at, "model": model, "notes": parsed.count(), "chunks": pieces.count(), **counts, "deleted_notes": gone}
    columns = ("run", "generated_at", "model", "labels", "notes", "chunks", "inserted", "updated", "unchanged", "deleted", "deleted_notes")
    row = store.spark.createDataFrame([tuple(summary[c] for c in columns)], SCHEMAS["runs"])
    tables = {
        "notes": Part(upsert(parsed, old_notes, "note_id", scope), "note_id"),
        "chunks": every,
        "chunk_vectors": Part(vectors, "chunk_id"),
        "graph_nodes": Part(nodes, "node_id"),
        "graph_edges": Part(edges, "source_node_id"),
        "manifest": Part(manifest, "note_id"),
        "postings": Part(index.postings, bucket=F.col("block"), only=touched),
        "members": Part(index.members, bucket=F.col("block"), only=touched),
        "lexicon": Part(words, "word", log=True),
        "runs": Part(row if old_runs is None else old_runs.unionByName(row)),
    }
    done = store.commit(tables, summary)
    index.release()
    release(whole, pieces, classified, vectors)
    return done
