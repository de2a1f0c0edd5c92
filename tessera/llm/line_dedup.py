"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash runs over the hashes of neighbouring lines, two at a time; blank lines are passed over. A boundary lies
between two lines where the hash occurs nowhere else in the corpus, so boundaries depend on nearby lines alone, come
back after an insertion, and a chunk between them is a passage that repeats, whatever stands around it. A line of
LONG_WORDS words or more that occurs again is such a chunk by itself. What repeats is removed but for its first
occurrence, after its bytes were compared, where the lines that go hold RUN_WORDS words or more in a row.

A fixed residue of the hash in place of that rule would cut most passages of a few lines in the wrong places: measured,
it found 15 of 77 whole.

Texts are shuffled to compare the bytes of lines whose hashes repeat, and to rewrite; a bit map sized by the number of
documents keeps most of those that have no such line out of both. The joins are sort-merge joins at every size, so that
what is shuffled grows with the input and not by leaps where a table no longer fits a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import possibly, put_back, salted_lookup, set_apart, stage, table

LONG_WORDS, RUN_WORDS = 50, 20
#: Parts into which lines of one hash are dealt.
SALTS = 8
LINE_HASH = "xxhash64(l)"


def with_units(documents: DataFrame, text: str = "text") -> DataFrame:
    """All columns, plus _lines, _at (places of the lines that are not blank), _solid (those lines) and _units.

    _units: array of (j, n, wa, wb, key): n lines from the j-th of _solid on, 2 neighbours or 1 long line, with their
    words and the hash over their hashes. Arrays that a lambda looks into are columns of the step before, so that they
    are made once for each row.
    """
    out = documents.withColumn("_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    out = out.withColumn("_at", F.expr("filter(sequence(0, size(_lines) - 1), i -> trim(_lines[i]) <> '')"))
    out = out.withColumn("_solid", F.expr("transform(_at, i -> _lines[i])"))
    out = out.withColumn("_each", F.expr(f"transform(_solid, (l, i) -> struct(i AS j, length(trim(l)) - length(replace(trim(l), ' ', '')) + 1 AS w, {LINE_HASH} AS h))"))
    others = "greatest(size(_each) - 1, 0)"
    pair = "struct(x.j AS j, 2 AS n, x.w AS wa, y.w AS wb, xxhash64(x.h, y.h) AS key)"
    pairs = f"zip_with(slice(_each, 1, {others}), slice(_each, 2, {others}), (x, y) -> {pair})"
    one = "struct(x.j AS j, 1 AS n, x.w AS wa, 0 AS wb, xxhash64(x.h) AS key)"
    singles = f"transform(filter(_each, x -> x.w >= {LONG_WORDS}), x -> {one})"
    return out.withColumn("_units", F.expr(f"concat({pairs}, {singles})")).drop("_each")


PLACE = "struct(_id IS NULL AS none, _id, _text_hash, j)"


def _going(documents: DataFrame) -> DataFrame:
    """(_id, _text_hash, j, words): the lines that occur earlier, as part of two neighbours or as a long line.

    A document is known by its doc_id and the hash of its text: rows equal in both are one document, which keeps what
    is first in it. The first occurrence is the one with the smallest doc_id (null last), then text hash, then place.
    The outer form of explode keeps the planner from pushing a test of the array's size below the steps that make it.
    """
    named = documents.select(F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text_hash"), "text")
    # Hashes alone: which units may repeat at all, and in which documents.
    each = with_units(named).select("_id", "_text_hash", F.posexplode_outer("_units").alias("k", "u")).where("u IS NOT NULL")
    found = stage(each.select("_id", "_text_hash", "k", "u.*").distinct())
    repeated = found.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("key")
    suspects = stage(salted_lookup(found, repeated.hint("merge"), "key", F.struct("_id", "_text_hash", "j"), SALTS))
    wanted = stage(suspects.groupBy("_id", "_text_hash").agg(F.collect_set("k").alias("ks")))
    # Bytes: texts of the suspects, grouped by hash and by the text itself.
    near = possibly(named, F.col("_id"), wanted, F.col("_id")).where("_maybe").drop("_maybe")
    of_suspects = near.alias("d").join(
        wanted.hint("merge").alias("w"), F.expr("d._id <=> w._id AND d._text_hash = w._text_hash")
    ).select("d._id", "d._text_hash", "d.text", "w.ks")
    whole = "if(_units[k].n = 2, concat(_solid[_units[k].j], '\n', _solid[_units[k].j + 1]), _solid[_units[k].j])"
    picked = with_units(of_suspects).withColumn("_picked", F.expr(f"transform(ks, k -> struct(_units[k].key AS key, _units[k].j AS j, {whole} AS text))"))
    texts = picked.select("_id", "_text_hash", F.explode_outer("_picked").alias("c")).select("_id", "_text_hash", F.col("c.key").alias("key"), "c.j", "c.text")
    variants = texts.groupBy("key", "text").agg(F.expr(f"min({PLACE})").alias("first"))
    first = stage(variants.groupBy("key").agg(F.count(F.lit(1)).alias("variants"), F.min("first").alias("first")))
    columns = ["_id", "_text_hash", "j", "n", "wa", "wb"]
    single = first.where("variants = 1").select("key", "first")
    equal = salted_lookup(suspects, single.hint("merge"), "key", F.struct("_id", "_text_hash", "j"), SALTS)
    equal = equal.where(f"first <> {PLACE}").select(*columns)
    if not first.where("variants > 1").isEmpty():  # different texts of one hash: each text has its own first
        clashing = texts.join(first.where("variants > 1").select("key"), "key")
        own = clashing.join(variants, ["key", "text"]).where(f"first <> {PLACE}").select("_id", "_text_hash", "j", "key")
        same = F.expr("s._id <=> o._id AND s._text_hash = o._text_hash AND s.j = o.j AND s.key = o.key")
        equal = equal.union(suspects.alias("s").join(own.alias("o"), same).select(*[f"s.{c}" for c in columns]))
    lines = F.expr("if(n = 2, array(struct(j AS j, wa AS words), struct(j + 1 AS j, wb AS words)), array(struct(j AS j, wa AS words)))")
    return equal.select("_id", "_text_hash", F.explode(lines).alias("l")).select("_id", "_text_hash", "l.j", "l.words").distinct()


def removals(documents: DataFrame) -> DataFrame:
    """(_id, _text_hash, removed, chunks) of the documents that lose lines: numbers of lines, and in how many runs."""
    run = F.expr("j - row_number() OVER (PARTITION BY _id, _text_hash ORDER BY j)")
    runs = _going(documents).withColumn("run", run).groupBy("_id", "_text_hash", "run").agg(F.collect_list("j").alias("js"), F.sum("words").alias("words"))
    kept = runs.where(F.col("words") >= RUN_WORDS).groupBy("_id", "_text_hash")
    return kept.agg(F.flatten(F.collect_list("js")).alias("removed"), F.count(F.lit(1)).cast("int").alias("chunks"))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """All rows and columns of `documents`, with text rewritten, plus removed_chunks and removed_lines.

    Removed lines are counted without blank ones; blank lines right after a removed line go with it. n_chars, where
    there is one, is brought up to date. Null and untouched texts stay as they are; a text whose lines all go becomes
    empty. Short repeated lines that stand alone stay. Of equal passages, in one text or in several, the first stays;
    repeated rows are rewritten alike; texts of any length are read whole; an empty table gives no rows. Columns of
    these names are replaced.
    """
    used = ("doc_id", "text", "n_chars")
    gone = stage(removals(documents))
    split = possibly(set_apart(documents, used), F.col("doc_id"), gone, F.col("_id"))
    none = F.lit(0).alias("removed_chunks"), F.lit(0).alias("removed_lines")
    untouched = split.where("NOT _maybe").drop("_maybe").select("*", *none)
    some = split.where("_maybe").drop("_maybe")
    same = some["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(F.coalesce(some["text"], F.lit(""))) == gone["_text_hash"])
    joined = some.join(gone.hint("merge"), same, "left").drop("_id", "_text_hash")
    touched = joined.withColumn("_lines", F.expr("if(removed IS NULL, array(), split(text, '\n', -1))"))
    touched = touched.withColumn("_at", F.expr("filter(sequence(0, size(_lines) - 1, if(size(_lines) = 0, -1, 1)), i -> trim(get(_lines, i)) <> '')"))
    # A line's place, and those of the blank lines after it.
    gaps = "flatten(transform(removed, j -> sequence(_at[j], if(j + 1 < size(_at), get(_at, j + 1), size(_lines)) - 1)))"
    left = f"transform(array_except(sequence(0, size(_lines) - 1), {gaps}), i -> _lines[i])"
    out = touched.withColumn("text", F.expr(f"if(removed IS NULL, text, array_join({left}, '\n'))"))
    out = out.withColumn("removed_chunks", F.coalesce("chunks", F.lit(0))).withColumn("removed_lines", F.expr("if(removed IS NULL, 0, size(removed))"))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("removed").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(documents.schema["n_chars"].dataType))
    every = untouched.unionByName(out.drop("_lines", "_at", "removed", "chunks"))
    return put_back(every, documents.columns, used, ("removed_chunks", "removed_lines"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_chunks", "removed_lines")


ORACLE = f"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), numbered AS (
  SELECT *, trim(l) <> '' AS solid, (sum((trim(l) <> '')::INT) OVER (PARTITION BY doc_id ORDER BY i))::INT AS j FROM line
), solid AS (
  SELECT doc_id, j, l, length(trim(l)) - length(replace(trim(l), ' ', '')) + 1 AS w,
         lead(l) OVER (PARTITION BY doc_id ORDER BY j) AS m FROM numbered WHERE solid
), unit AS (
  SELECT doc_id, j, 2 AS n, l || chr(10) || m AS t FROM solid WHERE m IS NOT NULL
  UNION ALL SELECT doc_id, j, 1, l FROM solid WHERE w >= {LONG_WORDS}
), again AS (
  SELECT doc_id, j, n FROM unit QUALIFY row_number() OVER (PARTITION BY n, t ORDER BY doc_id, j) > 1
), going AS (
  SELECT doc_id, j FROM again UNION SELECT doc_id, j + 1 FROM again WHERE n = 2
), run AS (
  SELECT doc_id, j, w, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS r FROM going JOIN solid USING (doc_id, j)
), gone AS (
  SELECT doc_id, j, r FROM run QUALIFY sum(w) OVER (PARTITION BY doc_id, r) >= {RUN_WORDS}
), counted AS (
  SELECT doc_id, count(DISTINCT r)::INT AS removed_chunks, count(*)::INT AS removed_lines FROM gone GROUP BY doc_id
), rest AS (
  SELECT n.doc_id, string_agg(n.l, chr(10) ORDER BY n.i) FILTER (g.j IS NULL) AS text
  FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.j = n.j GROUP BY n.doc_id
)
SELECT d.doc_id, if(c.doc_id IS NULL, d.text, coalesce(r.text, '')) AS text,
       coalesce(c.removed_chunks, 0)::INT AS removed_chunks, coalesce(c.removed_lines, 0)::INT AS removed_lines
FROM documents d JOIN rest r USING (doc_id) LEFT JOIN counted c USING (doc_id)
"""
