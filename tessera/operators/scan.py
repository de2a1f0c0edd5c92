"""The k best chunks of each query by one pass over the texts, for queries that are asked once of chunks without an index.

A pass over the texts packs chunks: the distinct words of some thousand chunks, and for each chunk the numbers of its words.
Packs meet blocks of queries. There a block's terms are looked for in the distinct words, and one matrix product counts the
terms of every query in every chunk. A pack gives at most its k best chunks of a query, and the number of all that match.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import BLANK, LEXICAL_BONUS, haystack, is_boilerplate
from tessera.operators.term_index import HAY
from tessera.staging import release, stage

#: Chunks of a pack and bytes of its texts at most, but for one longer text; queries of a block, on average.
PACK_CHUNKS, PACK_BYTES, BLOCK_QUERIES = 2048, 4 << 20, 256
#: Chunks of a pack that are counted at once, and the most tasks in which packs and blocks meet.
SLICE, MOST_TASKS = 256, 2048
#: Longer terms are looked for one by one. Numbers of the hashes of sequences.
LONG = 24
FACTOR, SPREAD, SHIFT = np.uint64(6364136223846793005), np.uint64(0x9E3779B97F4A7C15), np.uint64(48)


def _packed(kind: pa.DataType, texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    fields = {"pack": pa.int64(), "chunk_ids": pa.list_(kind), "contents": pa.list_(pa.string()), "flags": pa.list_(pa.bool_()), "words": pa.list_(pa.string()), "sizes": pa.list_(pa.int32()), "held": pa.list_(pa.int32()), "texts": pa.list_(pa.string())}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        waiting: list[pa.RecordBatch] = []
        size = 0

        def made(rows: pa.Table) -> pa.RecordBatch:
            hay = rows["_hay"].combine_chunks()
            flat = hay
            for blank in "\n\t\r":
                flat = pc.replace_substring(flat, blank, " ")
            split = pc.split_pattern(flat, " ")
            words = split.flatten()
            chunk = np.repeat(np.arange(len(rows)), split.value_lengths().to_numpy())
            coded = words.dictionary_encode()
            code, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            both = chunk * max(1, len(known)) + code
            empty = pc.index(known, "").as_py()
            both = np.sort(both if empty < 0 else both[code != empty])
            both = both[np.diff(both, prepend=-1) > 0]
            sizes = np.bincount(both // max(1, len(known)), minlength=len(rows)).astype(np.int32)
            row = {"pack": number, "words": known, "sizes": sizes, "held": (both % max(1, len(known))).astype(np.int32), "texts": hay if texts else []}
            row |= {to: rows[c].combine_chunks() for to, c in (("chunk_ids", "chunk_id"), ("contents", "content"), ("flags", "flag"))}
            return pa.record_batch([pa.array([number], t) if c == "pack" else _list(row[c], t) for c, t in fields.items()], names=list(fields))

        for batch in batches:
            ends = np.cumsum(np.nan_to_num(pc.binary_length(batch["_hay"]).to_numpy(zero_copy_only=False)))
            low = 0
            while low < batch.num_rows:
                before = ends[low - 1] if low else 0
                fits = int(np.searchsorted(ends, before + PACK_BYTES - size, "right")) - low
                count = min(fits, PACK_CHUNKS - sum(w.num_rows for w in waiting), batch.num_rows - low)
                if count <= 0 and waiting:
                    yield made(pa.Table.from_batches(waiting))
                    number, waiting, size = number + 1, [], 0
                    continue
                count = max(1, count)
                waiting.append(batch.slice(low, count))
                size += int(ends[low + count - 1] - before)
                low += count
        if waiting:
            yield made(pa.Table.from_batches(waiting))

    return pack


def _list(values: pa.Array | np.ndarray | list, kind: pa.DataType) -> pa.Array:
    """A list array of one row."""
    inner = pa.array(values, kind.value_type) if not isinstance(values, pa.Array) else values.cast(kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _within(words: list[str], terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, term) numbers of all terms within words, by word; terms are distinct, not empty and hold no blank.

    Hashes of all sequences of a term's length are looked up among those of the terms, and what is found is compared.
    """
    text = " ".join(words)
    starts = np.cumsum([0, *[len(w) + 1 for w in words]])[: len(words)]
    codes, pairs = _codes(text), [np.zeros(0, np.int64)]

    def add(at: np.ndarray, number: np.ndarray | int) -> None:
        pairs.append((np.searchsorted(starts, at, "right") - 1) * len(terms) + number)

    by_length: dict[int, list[int]] = {}
    for number, term in enumerate(terms):
        if len(term) <= LONG:
            by_length.setdefault(len(term), []).append(number)
            continue
        at = text.find(term)
        while at >= 0:
            add(np.array([at]), number)
            at = text.find(term, at + 1)
    rolled = np.zeros(len(codes), np.uint64)
    for length in range(1, 1 + min(len(codes), max(by_length, default=0))):
        rolled = rolled[: len(codes) - length + 1] * FACTOR + codes[length - 1 :]
        left = np.array(by_length.get(length, []), np.int64)
        if not len(left):
            continue
        chars = _codes("".join(terms[n] for n in left)).reshape(len(left), length)
        hashes = np.zeros(len(left), np.uint64)
        for i in range(length):
            hashes = hashes * FACTOR + chars[:, i]
        maybe = np.zeros(1 << 16, bool)
        maybe[hashes * SPREAD >> SHIFT] = True
        near = np.flatnonzero(maybe[rolled * SPREAD >> SHIFT])
        seen = rolled[near]
        while len(left):  # once, but for terms of equal hashes
            one, first = np.unique(hashes, return_index=True)
            place = np.minimum(np.searchsorted(one, seen), len(one) - 1)
            hit = np.flatnonzero(one[place] == seen)
            at, which = near[hit], first[place[hit]]
            same = np.ones(len(at), bool)
            for i in range(length):
                same &= codes[at + i] == chars[which, i]
            add(at[same], left[which[same]])
            rest = np.delete(np.arange(len(left)), first)
            left, chars, hashes = left[rest], chars[rest], hashes[rest]
    both = np.sort(np.concatenate(pairs))
    both = both[np.diff(both, prepend=-1) > 0]
    return both // max(1, len(terms)), both % max(1, len(terms))


def _presence(pack: pa.Table, terms: list[str]) -> np.ndarray:
    """Which chunk of a pack (rows) holds which term (columns)."""
    sizes, held = (pack[c].combine_chunks().values.to_numpy().astype(np.int64) for c in ("sizes", "held"))
    words = pack["words"][0].as_py()
    blank = {t: [p for p in re.split(BLANK, t) if p] for t in terms if not t or re.search(BLANK, t)}
    plain = list(dict.fromkeys([t for t in terms if t not in blank] + [p for parts in blank.values() for p in parts]))
    number = {t: i for i, t in enumerate(plain)}
    word, term = _within(words, plain)
    first = np.searchsorted(word, np.arange(len(words) + 1))
    each = np.diff(first)
    found = np.zeros((len(sizes), len(plain)), bool)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for low in range(0, len(sizes), SLICE):
        high = min(low + SLICE, len(sizes))
        own = held[ends[low] : ends[high]]
        chunk, count = np.repeat(np.arange(low, high), sizes[low:high]), each[own]
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[own], count)
        found[np.repeat(chunk, count), term[at]] = True
    if not blank:
        return found
    out = np.zeros((len(sizes), len(terms)), bool)
    for i, t in enumerate(terms):
        if t not in blank:
            out[:, i] = found[:, number[t]]
        else:  # all chunks that hold all pieces are compared with the text
            near = found[:, [number[p] for p in blank[t]]].all(axis=1)
            texts = pack["texts"][0]
            out[near, i] = [t in texts[int(c)].as_py() for c in np.flatnonzero(near)]
    return out


def _best(k: int, query_kind: pa.DataType, chunk_kind: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a pack and a block of queries: the k best chunks of each query, of different contents, and its number of matches.

    A chunk has `at`, the places of the query's terms that it holds; the row of a number has no chunk.
    """
    kinds = {"query_id": query_kind, "chunk_id": chunk_kind, "content": pa.string(), "demoted": pa.bool_(), "at": pa.list_(pa.int32()), "n": pa.int64()}

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in kinds}
        if len(left) and len(right):
            ids, contents, flags = (left[c][0].as_py() for c in ("chunk_ids", "contents", "flags"))
            place = np.array(sorted(range(len(ids)), key=ids.__getitem__))
            rank = np.empty(len(ids), np.int64)
            rank[place] = np.arange(len(ids))
            asked = right.select(["query_id", "terms", "templates"]).to_pylist()
            number: dict[str, int] = {}
            own = [np.array([number.setdefault(t, len(number)) for t in q["terms"]], np.int64) for q in asked]
            present = _presence(left, list(number))
            weight = np.zeros((len(number), len(asked)), np.float32)
            for i, terms in enumerate(own):
                np.add.at(weight[:, i], terms, 1)
            counts = np.concatenate([present[a : a + SLICE].astype(np.float32) @ weight for a in range(0, len(ids), SLICE)]).astype(np.int64)
            flags = np.array(flags, bool)
            for i, query in enumerate(asked):
                at = np.flatnonzero(counts[:, i])
                if not len(at):
                    continue
                demoted = flags & (not query["templates"])
                # One number for each chunk: not demoted first, then more terms, then by id.
                key = (demoted[at] * (1 + len(own[i])) + len(own[i]) - counts[at, i]) * len(ids) + rank[at]
                chosen, taken = [], set()
                for c in place[np.sort(key) % len(ids)].tolist():
                    if contents[c] not in taken:
                        taken.add(contents[c])
                        chosen.append(c)
                        if len(chosen) == k:
                            break
                matched = present[np.ix_(chosen, own[i])]
                rows = [(query["query_id"], ids[c], contents[c], bool(demoted[c]), np.flatnonzero(m).tolist(), None) for c, m in zip(chosen, matched)]
                for values in [*rows, (query["query_id"], None, None, None, None, len(at))]:
                    for column, value in zip(out.values(), values):
                        column.append(value)
        return pa.table([pa.array(out[c], t) for c, t in kinds.items()], names=list(kinds))

    return best


def search(chunks: DataFrame, queries: DataFrame, k: int, columns: tuple[str, ...] = HAY, content: str = "chunk_hash") -> tuple[DataFrame, DataFrame]:
    """As term_index.search, from the texts themselves; terms with blanks and empty terms need nothing else."""
    from pyspark.sql.pandas.types import to_arrow_type

    flag = F.col("templates") if "templates" in queries.columns else F.lit(False)
    clean = F.filter("terms", lambda t: t.isNotNull())
    asked = stage(queries.select("query_id", clean.alias("terms"), F.coalesce(flag, F.lit(False)).alias("templates")).where(F.size("terms") > 0))
    texts = not asked.where(F.exists("terms", lambda t: t.rlike(BLANK) | (t == ""))).isEmpty()
    boilerplate = is_boilerplate(*[_given(chunks, c) for c in ("note_title", "relative_path", "section_label", "paragraph_text")])
    same = F.coalesce(F.nullif(F.col(content), F.lit("")), F.concat(F.lit("id:"), F.col("chunk_id").cast("string")))
    rows = chunks.where("chunk_id IS NOT NULL").select("chunk_id", same.alias("content"), boilerplate.alias("flag"), haystack(*columns).alias("_hay"))
    chunk_type, query_type = rows.schema["chunk_id"].dataType, asked.schema["query_id"].dataType
    chunk_id, query_id = chunk_type.simpleString(), query_type.simpleString()
    schema = f"pack long, chunk_ids array<{chunk_id}>, contents array<string>, flags array<boolean>, words array<string>, sizes array<int>, held array<int>, texts array<string>"
    packs = stage(rows.mapInArrow(_packed(to_arrow_type(chunk_type), texts), schema))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    left = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).crossJoin(packs.select(F.col("pack").alias("pack")))
    keys, tasks = ["pack", "block"], max(1, min(MOST_TASKS, blocks * packs.count()))
    one, two = (side.repartition(tasks, *keys).groupBy(*keys) for side in (left, right))
    made = f"query_id {query_id}, chunk_id {chunk_id}, content string, demoted boolean, at array<int>, n long"
    found = stage(one.cogroup(two).applyInArrow(_best(k, to_arrow_type(query_type), to_arrow_type(chunk_type)), made))
    counts = stage(found.where("chunk_id IS NULL").groupBy("query_id").agg(F.sum("n").alias("lexical")))
    order = [F.col("demoted").asc(), F.size("at").desc(), F.col("chunk_id").asc()]
    hits = found.where("chunk_id IS NOT NULL").drop("n")
    once = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "content").orderBy(*order))).where("_n = 1")
    top = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    matched = F.transform("at", lambda i: F.get("terms", i)).alias("matched")
    named = top.join(asked.select("query_id", "terms"), "query_id").select("query_id", "chunk_id", "demoted", "rank", matched)
    out = stage(
        named.select(
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
    release(asked, packs, found)
    return out, counts


def _given(chunks: DataFrame, column: str) -> Column:
    return F.col(column) if column in chunks.columns else F.lit("")
