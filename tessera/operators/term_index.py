"""An index of terms, and the k best chunks of each query from it, without a pass over the texts.

Chunks are dealt to blocks. For each block the index holds the places of its chunks that have a key: words of more than
GRAM characters, and all sequences of one to GRAM characters within words. A term without a blank lies within one word: a
short one is a key itself; the words that hold a long one are found in the lexicon, by its rarest sequence of GRAM
characters. A block gives, for each query, at most its k best chunks and the number of all that match. Blocks are visited
in rounds, each GROWTH times as large as those before together, and a round's blocks give only what beats the k best so far:
about GROWTH * k rows of a query come out of a round, whatever the number of chunks that match.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import BLANK, LEXICAL_BONUS, haystack, is_boilerplate
from tessera.staging import release, stage

#: Characters of a sequence.
GRAM = 3
#: Chunks of a block and queries of a block, on average.
BLOCK_CHUNKS, BLOCK_QUERIES = 1024, 256
GROWTH = 4
HAY = ("note_title", "section_label", "relative_path", "paragraph_text")


@dataclass
class TermIndex:
    """postings: block, key, places. members: block, chunk_ids, contents, boilerplate, by place. lexicon: gram, word."""

    postings: DataFrame
    members: DataFrame
    lexicon: DataFrame

    def release(self) -> None:
        release(self.postings, self.members, self.lexicon)


def by_hash(chunks: DataFrame) -> Column:
    """Blocks of about BLOCK_CHUNKS chunks."""
    return F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, -(-chunks.count() // BLOCK_CHUNKS)))).cast("int")


def members_of(chunks: DataFrame, block: Column, content: str = "chunk_hash") -> DataFrame:
    """A row for each block: its chunks in the order of their ids, their contents, and which are a template's boilerplate.

    Chunks without content count each for itself. A null chunk_id is left out; chunk_ids are unique.
    """
    flag = is_boilerplate(*[F.col(c) if c in chunks.columns else F.lit("") for c in ("note_title", "relative_path", "section_label", "paragraph_text")])
    same = F.coalesce(F.nullif(F.col(content), F.lit("")), F.concat(F.lit("id:"), F.col("chunk_id").cast("string")))
    rows = chunks.where("chunk_id IS NOT NULL").select(block.alias("block"), F.struct("chunk_id", same.alias("content"), flag.alias("flag")).alias("m"))
    grouped = rows.groupBy("block").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return grouped.select("block", F.col("m.chunk_id").alias("chunk_ids"), F.col("m.content").alias("contents"), F.col("m.flag").alias("boilerplate"))


def _keys(rows: pd.DataFrame) -> pd.DataFrame:
    """From (place, words) of a block's chunks: its postings."""
    block, size = int(rows["block"].iloc[0]), 1 + int(rows["place"].max())
    held: dict[str, list[int]] = {}
    for place, words in zip(rows["place"].tolist(), rows["words"]):
        for word in words:
            held.setdefault(word, []).append(place)
    grams: dict[str, int] = {}
    own = [[grams.setdefault(w[i : i + n], len(grams)) for n in range(1, GRAM + 1) for i in range(len(w) - n + 1)] for w in held]
    # Each sequence of a word with each place of the word, as one number.
    counts = np.array([len(p) for p in held.values()])
    places = np.fromiter(itertools.chain.from_iterable(held.values()), np.int64, int(counts.sum()))
    word = np.repeat(np.arange(len(own)), [len(g) for g in own])
    gram = np.fromiter(itertools.chain.from_iterable(own), np.int64, len(word))
    many = counts[word]
    first = (np.cumsum(counts) - counts)[word]
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    both = np.unique(np.repeat(gram, many) * size + places[at])
    short = np.split((both % size).astype(np.int32), np.flatnonzero(np.diff(both // size)) + 1)
    long = [(w, sorted(p)) for w, p in held.items() if len(w) > GRAM]
    return pd.DataFrame({"block": block, "key": [k for k, _ in long] + list(grams), "places": [p for _, p in long] + short})


def postings_of(chunks: DataFrame, members: DataFrame, columns: tuple[str, ...] = HAY) -> DataFrame:
    """The postings of chunks; their place is that in `members`. The distinct words of a block's chunks meet in one task."""
    places = members.select("block", F.posexplode("chunk_ids").alias("place", "chunk_id"))
    words = F.filter(F.array_distinct(F.split(haystack(*columns), BLANK)), lambda w: w != "")
    each = chunks.select("chunk_id", words.alias("words")).where(F.size("words") > 0).join(places, "chunk_id")
    return each.select("block", "place", "words").groupBy("block").applyInPandas(_keys, "block int, key string, places array<int>")


def lexicon_of(postings: DataFrame) -> DataFrame:
    """(gram, word) of the words that are keys."""
    grams = F.expr(f"array_distinct(transform(sequence(1, length(word) - {GRAM - 1}), i -> substring(word, i, {GRAM})))")
    return postings.where(F.length("key") > GRAM).select(F.col("key").alias("word")).distinct().select(F.explode(grams).alias("gram"), "word")


def build(chunks: DataFrame, block: Column | None = None, columns: tuple[str, ...] = HAY, content: str = "chunk_hash") -> TermIndex:
    """Index chunks; all parts are staged. Texts that are null or empty have no keys, their chunks are members all the same."""
    members = stage(members_of(chunks, by_hash(chunks) if block is None else block, content))
    postings = stage(postings_of(chunks, members, columns))
    return TermIndex(postings, members, stage(lexicon_of(postings)))


def term_keys(index: TermIndex, terms: DataFrame) -> DataFrame:
    """(term, key): the keys whose chunks together are those that hold a term without a blank; terms are distinct."""
    short = terms.where(F.length("term") <= GRAM).select("term", F.col("term").alias("key"))
    grams = F.expr(f"array_distinct(transform(sequence(1, length(term) - {GRAM - 1}), i -> substring(term, i, {GRAM})))")
    long = terms.where(F.length("term") > GRAM).select("term", F.explode(grams).alias("gram"))
    known = index.lexicon.join(long.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A sequence that no word has makes the term match nothing, so the left join's null, as 0, is the rarest.
    rarest = long.join(known, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    held = index.lexicon.join(rarest, "gram").where(F.contains("word", F.col("term")))
    return short.unionByName(held.select("term", F.col("word").alias("key")))


def _phrases(index: TermIndex, phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """(block, term, places) of terms with blanks, and of the empty term: chunks that hold all pieces, compared with the text.

    Only a term that is nothing but blanks, or empty, is looked for in all texts.
    """
    pieces = phrases.select("term", F.explode(F.array_distinct(F.split("term", BLANK))).alias("piece")).where("piece <> ''")
    wanted = pieces.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    keys = term_keys(index, pieces.select(F.col("piece").alias("term")).distinct()).withColumnRenamed("term", "piece")
    held = index.postings.join(keys.join(pieces, "piece"), "key").select("term", "piece", "block", F.explode("places").alias("place")).distinct()
    full = held.groupBy("term", "block", "place").agg(F.count(F.lit(1)).alias("n")).join(wanted, ["term", "n"])
    places = index.members.select("block", F.posexplode("chunk_ids").alias("place", "chunk_id"))
    near = full.join(places, ["block", "place"]).join(texts, "chunk_id")
    bare = phrases.join(pieces, "term", "left_anti")
    anywhere = places.join(texts, "chunk_id").join(bare, F.contains("_hay", F.col("term")))
    found = near.where(F.contains("_hay", F.col("term"))).select("block", "term", "place").unionByName(anywhere.select("block", "term", "place"))
    return found.groupBy("block", "term").agg(F.collect_list("place").alias("places"))


def _best(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of a block: the k best chunks of each query that may still come in, of different contents, and its number of matches."""

    def best(left: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        own = left[left["term"].isna()]
        if len(own) and len(asked):
            ids, contents, flags = (np.asarray(own[c].iloc[0]) for c in ("chunk_ids", "contents", "boilerplate"))
            flags = flags.astype(bool)
            held: dict[str, np.ndarray] = {}
            for term, places in zip(left["term"], left["places"]):
                if term is not None:
                    held[term] = np.zeros(len(ids), bool)
                    held[term][np.asarray(places, np.int64)] = True
            for row in asked.itertuples():
                present = [t for t in row.terms if t in held]
                if not present:
                    continue
                count = np.sum([held[t] for t in present], axis=0, dtype=np.int32)
                out.append((row.query_id, None, None, None, None, int(np.count_nonzero(count))))
                demoted = flags & (not row.templates)
                if row.least_count is not None and not pd.isna(row.least_count):
                    # What comes in stands before the k-th so far: not demoted where that is, or with more terms, or first by id.
                    lasting = demoted < bool(row.least_demoted)
                    level = (demoted == bool(row.least_demoted)) & ((count > row.least_count) | (count == row.least_count) & (ids < row.least_id))
                    at = np.flatnonzero((count > 0) & (lasting | level))
                else:
                    at = np.flatnonzero(count)
                taken: set[str] = set()
                for i in at[np.lexsort((at, -count[at], demoted[at]))]:
                    if contents[i] not in taken:
                        taken.add(contents[i])
                        out.append((row.query_id, ids[i], contents[i], bool(demoted[i]), [t for t in row.terms if t in held and held[t][i]], None))
                        if len(taken) == k:
                            break
        return pd.DataFrame(out, columns=["query_id", "chunk_id", "content", "demoted", "matched", "n"], dtype=object)

    return best


def _placed(found: DataFrame) -> DataFrame:
    """Rows of different contents in rank order, by query."""
    order = [F.col("demoted").asc(), F.size("matched").desc(), F.col("chunk_id").asc()]
    once = found.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "content").orderBy(*order))).where("_n = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).drop("_n")


def rounds(blocks: int) -> Iterator[tuple[int, int]]:
    """Ranges of blocks, each GROWTH times as long as what lies before it."""
    low, high = 0, 1
    while low < blocks:
        yield low, min(high, blocks)
        low, high = high, high * (GROWTH + 1)


def search(index: TermIndex, queries: DataFrame, k: int, chunks: DataFrame | None = None, columns: tuple[str, ...] = HAY) -> tuple[DataFrame, DataFrame]:
    """(the k best chunks of each query, of different contents; (query_id, lexical): how many chunks match), both staged.

    queries: query_id, unique; terms, taken as in retrieval.lexical; where there is one, `templates`, true for a query that
    takes boilerplate as it is. Best is: not demoted, more terms, smaller chunk_id. Rows have query_id, chunk_id, source,
    score, reason, demoted, matched and rank. `chunks` is needed only where a term has a blank or is empty. Null terms
    match nothing; a query without terms has no rows, as has an empty index.
    """
    spark = index.members.sparkSession
    flag = F.col("templates") if "templates" in queries.columns else F.lit(False)
    clean = F.filter("terms", lambda t: t.isNotNull())
    asked = stage(queries.where(F.size("terms") > 0).select("query_id", clean.alias("terms"), F.coalesce(flag, F.lit(False)).alias("templates")))
    groups = max(1, -(-asked.count() // BLOCK_QUERIES))
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")
    each = stage(asked.select(group.alias("qblock"), F.explode(F.array_distinct("terms")).alias("term")).distinct())
    has_blank = F.col("term").rlike(BLANK) | (F.col("term") == "")
    keys = stage(term_keys(index, each.where(~has_blank).select("term").distinct()))
    places = F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")
    held = index.postings.join(keys, "key").groupBy("block", "term").agg(places)
    phrases = each.where(has_blank).select("term").distinct()
    if not phrases.isEmpty():
        if chunks is None:
            raise ValueError("terms with blanks are compared with the texts: give chunks")
        held = held.unionByName(_phrases(index, phrases, chunks.select("chunk_id", haystack(*columns).alias("_hay"))))
    postings = stage(held)
    ids = index.members.schema["chunk_ids"].dataType.elementType
    query_id = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_id}, chunk_id {ids.simpleString()}, content string, demoted boolean, matched array<string>, n long"
    order = [r["block"] for r in index.members.select("block").orderBy("block").collect()]  # a number for each block
    found: DataFrame | None = None
    parts, best = [], None
    for low, high in rounds(len(order)):
        here = spark.createDataFrame([(b,) for b in order[low:high]], "block int")
        terms = postings.join(here, "block", "left_semi").join(each, "term").select("block", "qblock", "term", "places")
        own = index.members.join(here, "block", "left_semi").withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        left = terms.unionByName(own, allowMissingColumns=True)
        if best is None:
            least = asked.withColumn("least_count", F.lit(None).cast("int")).withColumn("least_demoted", F.lit(None).cast("boolean")).withColumn("least_id", F.lit(None).cast(ids))
        else:
            last = best.where(F.col("rank") == k).select("query_id", F.size("matched").alias("least_count"), F.col("demoted").alias("least_demoted"), F.col("chunk_id").alias("least_id"))
            least = asked.join(last, "query_id", "left")
        right = least.withColumn("qblock", group).crossJoin(here)
        part = stage(left.groupBy("block", "qblock").cogroup(right.groupBy("block", "qblock")).applyInPandas(_best(k), schema))
        parts.append(part)
        found = part if found is None else found.unionByName(part)
        last_best, best = best, stage(_placed(found.where("chunk_id IS NOT NULL")).where(F.col("rank") <= k))
        if last_best is not None:
            release(last_best)
    if found is None:
        found = spark.createDataFrame([], schema)
        best = _placed(found)
    counts = stage(found.where("chunk_id IS NULL").groupBy("query_id").agg(F.sum("n").alias("lexical")))
    out = stage(
        best.select(
            "query_id",
            "chunk_id",
            F.lit("lexical").alias("source"),
            (F.size("matched") + LEXICAL_BONUS).cast("double").alias("score"),
            F.concat(F.lit("lexical match: "), F.array_join("matched", ", ")).alias("reason"),
            "demoted",
            "matched",
            "rank",
        )
    )
    out.rows_made = sum(p.where("chunk_id IS NOT NULL").count() for p in parts) if _COUNT_ROWS else None
    release(asked, each, keys, postings, *parts, *([best] if hasattr(best, "staged_at") else []))
    return out, counts


#: Set by tests: count the rows that blocks gave.
_COUNT_ROWS = False
