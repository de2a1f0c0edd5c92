"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in at most MAX_BITS bits are linked; a document's component is what links reach.

The index has upper nodes in the shuffle and lower nodes in the tasks. An upper node is a mask with the pattern that
its members share under it. There are MAX_BITS + 1 top masks that part the 64 bits, so two linked fingerprints agree
wholly under one of them: their accumulated difference at that upper node is 0, and each upper node can be searched by
itself. An upper node with too many members is factored again by masks over the bits that are still free; that ends at
FINEST free bits, so the members of an upper node are bounded whatever the data. Within an upper node, fingerprints
are sorted by Gray rank, which puts similar ones side by side; blocks of neighbours become nodes that hold the bits all
their members share, and a search adds up the differences from node to node and drops a whole group beyond MAX_BITS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import minhash
from tessera.llm.common import bounded_batches, possibly, put_back, set_apart, stage, table
from tessera.llm.components import components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
#: keep_one has its own: words of a shingle, and the Jaccard similarity from which texts are near copies.
COPY_WORDS, COPY_SIMILARITY = 5, 0.8
#: Members of an upper node beyond which it is factored again, and the free bits at which that ends.
NODE_LIMIT = 768
FINEST = 12
#: Neighbours that a node of the lower index takes together.
FANOUT = 16
#: Node visits that are worked on at once.
BLOCK = 1 << 20
ALL_BITS = (1 << 64) - 1


def shingle_hashes(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each shingle of the text, A-Z lower-cased; fewer words than a shingle's make one shingle."""
    import xxhash

    digest, parts = xxhash.xxh64_intdigest, text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= words:
        return np.array([digest(b" ".join(parts), SEED)], np.uint64)
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - words + 1].tolist()
    pieces = [joined[a:b] for a, b in zip(starts, ends[words - 1 :].tolist())]
    return np.fromiter((digest(p, SEED) for p in pieces), np.uint64, len(pieces))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half of the hashes; no hash gives 0."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # little-endian bytes and bits: column i is bit i
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprint(documents: DataFrame, name: str = "code") -> DataFrame:
    """All columns, plus the SimHash of the whole text (null: empty) as a signed long."""
    bounded_batches(documents.sparkSession)

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        codes = [majority(shingle_hashes(t or "")) for t in texts]
        return pd.Series(np.array(codes, np.uint64).astype(np.int64))

    return documents.withColumn(name, hashed(F.col("text")))


def gray_rank(code: Column) -> Column:
    """The place of a 64-bit code in Gray order: the prefix exclusive-or of its bits."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def split_mask(mask: int, parts: int = MAX_BITS + 1) -> list[int]:
    """Masks that part the free bits of `mask`, each with the bits of `mask` itself."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(codes: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """Rows (code, mask) under the finer masks of their mask, with key: the pattern that the code has under it."""
    finer = F.lit(None).cast("array<bigint>")
    for mask, parts in masks.items():
        choice = F.array(*[F.lit(_signed(p)).cast("long") for p in parts])
        finer = F.when(F.col("mask") == F.lit(_signed(mask)), choice).otherwise(finer)
    spread = codes.select("code", F.explode(finer).alias("mask"))
    return spread.withColumn("key", F.col("code").bitwiseAND(F.col("mask")))


def upper_nodes(codes: DataFrame, limit: int = NODE_LIMIT) -> DataFrame:
    """(code, mask, key): each distinct code under every upper node that it is searched in."""
    level = {0: split_mask(0)}
    pending, ready = _keyed(codes.select("code", F.lit(0).cast("long").alias("mask")), level), None
    while True:
        masks = [m for parts in level.values() for m in parts]
        free = 64 - min(m.bit_count() for m in masks)
        large = None
        if free > FINEST:
            counted = pending.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"))
            large = stage(counted.where(F.col("n") > limit).select("mask", "key"))
        if large is None or large.isEmpty():
            return pending if ready is None else ready.union(pending)
        kept = pending.join(large, ["mask", "key"], "left_anti").select("code", "mask", "key")
        ready = kept if ready is None else ready.union(kept)
        level = {m: split_mask(m) for m in masks}
        pending = _keyed(pending.join(large, ["mask", "key"], "left_semi"), level)


def build_levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """From the leaves up: (mask, pattern) of the nodes of each level over codes in Gray order."""
    levels = [(np.full(len(codes), ALL_BITS, np.uint64), codes)]
    while len(levels[-1][0]) > FANOUT:
        mask, pattern = levels[-1]
        starts = np.arange(0, len(mask), FANOUT)
        differs = pattern ^ pattern[np.arange(len(mask)) // FANOUT * FANOUT]
        shared = np.bitwise_and.reduceat(mask, starts) & ~np.bitwise_or.reduceat(differs, starts)
        levels.append((shared, pattern[starts] & shared))
    return levels


def search(codes: np.ndarray, queries: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in queries, place in codes) that differ in at most `most` bits; codes are in Gray order."""
    levels = build_levels(codes)
    top = len(levels[-1][0])
    query = np.repeat(np.arange(len(queries)), top)
    node = np.tile(np.arange(top), len(queries))
    passed, seen = np.zeros(len(query), np.int64), np.zeros(len(query), np.uint64)
    for depth in range(len(levels) - 1, -1, -1):
        mask, pattern = levels[depth]
        fresh = mask[node] & ~seen
        passed = passed + np.bitwise_count((queries[query] ^ pattern[node]) & fresh)
        keep = passed <= most
        query, node, passed = query[keep], node[keep], passed[keep]
        if depth:
            seen = mask[node]
            below = len(levels[depth - 1][0])
            first = node * FANOUT
            sizes = np.minimum(first + FANOUT, below) - first
            inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            query, passed, seen = np.repeat(query, sizes), np.repeat(passed, sizes), np.repeat(seen, sizes)
            node = np.repeat(first, sizes) + inner
    return query, node


def local_roots(codes: np.ndarray) -> np.ndarray:
    """For codes in Gray order: the place of the first code of each one's component, among these codes alone."""
    step = max(1, BLOCK // max(16, len(codes)))
    found = [search(codes, codes[at : at + step]) for at in range(0, len(codes), step)]
    a = np.concatenate([q + i * step for i, (q, _) in enumerate(found)])
    b = np.concatenate([n for _, n in found])
    earlier = b < a
    a, b, roots = a[earlier], b[earlier], np.arange(len(codes))
    while True:
        before = roots.copy()
        np.minimum.at(roots, a, roots[b])
        np.minimum.at(roots, b, roots[a])
        roots = roots[roots]
        if (roots == before).all():
            return roots


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) from each code to its root, node by node; a partition comes sorted by node and Gray rank."""
    held: pd.DataFrame | None = None

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        codes = rows["code"].to_numpy(np.int64)
        mask, key = rows["mask"].to_numpy(), rows["key"].to_numpy()
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate([[0], cuts])
        ends = np.concatenate([cuts, [len(codes)]])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        several = np.flatnonzero(ends - starts > 1)
        for start, end in zip(starts[several].tolist(), ends[several].tolist()):
            own = codes[start:end]
            roots = local_roots(own.astype(np.uint64))
            moved = roots != np.arange(len(own))
            a.append(own[moved])
            b.append(own[roots[moved]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        last = (rows["mask"] == rows["mask"].iloc[-1]) & (rows["key"] == rows["key"].iloc[-1])
        held = rows[last]
        if not last.all():
            yield linked(rows[~last])
    if held is not None and len(held):
        yield linked(held)


def linked_codes(codes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct codes that span the components of "at most MAX_BITS bits apart"."""
    spark = codes.sparkSession
    bounded_batches(spark)
    nodes = upper_nodes(codes).withColumn("gray", gray_rank(F.col("code")))
    # The sign bit is turned so that signed order is the unsigned order of ranks.
    nodes = nodes.withColumn("gray", F.col("gray").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.repartition(partitions, "mask", "key").sortWithinPartitions("mask", "key", "gray")
    return dealt.select("code", "mask", "key").mapInPandas(_links, "a long, b long")


def _coded(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, code) for each row of `documents`; (code, component) for each code that is linked at all."""
    hashed = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    coded = stage(with_fingerprint(documents.select("doc_id", "text")).select("doc_id", hashed, "code"))
    links = linked_codes(stage(coded.select("code").distinct()))
    return coded, stage(components(links).withColumnRenamed("node", "code"))


def _least_of_component(coded: DataFrame, linked: DataFrame, least: Column, name: str) -> DataFrame:
    """(code, `name`): the least value of `least` in the code's component.

    Values are first reduced to one for each code, so neither copies nor a large component bring rows together.
    """
    own = stage(coded.groupBy("code").agg(F.min(least).alias("own")))
    of_component = stage(own.join(linked, "code").groupBy("component").agg(F.min("own").alias("shared")))
    shared = linked.join(of_component, "component").select("code", "shared")
    return stage(own.join(shared, "code", "left").select("code", F.coalesce("shared", "own").alias(name)))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) for each row of `documents`.

    Null and empty texts have fingerprint 0, which links like any other. A row without doc_id has a component like
    the others but is never its smallest id; a component of such rows alone has a null component_id. Repeated rows
    stay. Only doc_id and text are read, so other columns may have any names.
    """
    coded, linked = _coded(documents)
    # Within a struct a null id would come first.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    by_code = _least_of_component(coded, linked, order, "least")
    fingerprint = F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint")
    return coded.join(by_code, "code").select("doc_id", fingerprint, F.col("least.doc_id").alias("component_id"))


def _shingle_sets(documents: DataFrame, words: int) -> DataFrame:
    """All columns, plus set: code (a hash of the set of shingles), n (its size), finger (its SimHash) and keys."""
    bounded_batches(documents.sparkSession)

    @F.pandas_udf("code long, n long, finger long, keys array<long>")
    def made(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        rows = []
        for text in texts:
            own = np.unique(shingle_hashes(text or "", words))
            code = xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), SEED)
            rows.append((*np.array([code, len(own), majority(own)], np.uint64).astype(np.int64), minhash.band_keys(own)))
        return pd.DataFrame(rows, columns=["code", "n", "finger", "keys"])

    return documents.withColumn("set", made.asNondeterministic()(F.col("text")))


def _finger_groups(sets: DataFrame) -> DataFrame:
    """(key, code, parts): two codes each, that span what the Gray-order index links: at most MAX_BITS bits apart."""
    first = stage(sets.groupBy("finger").agg(F.min("code").alias("first")))
    same = sets.select("code", "finger").join(first, "finger").select(F.col("first").alias("a"), F.col("code").alias("b"))
    linked = linked_codes(first.select(F.col("finger").alias("code")))
    a, b = (first.select(F.col("finger").alias(x), F.col("first").alias(f"_{x}")) for x in "ab")
    pairs = same.union(linked.join(a, "a").join(b, "b").select("_a", "_b")).where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("code"), F.lit(1).alias("parts"))


def _near_copies(documents: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, code) for each row of `documents`; (code, component) for each code that is linked at all.

    A code stands for a set of shingles of `words` words. Sets are linked where their similarity is at least `similarity`.
    Texts are read a second time only for sets that have a candidate, one text for each set.
    """
    hashed = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    made = stage(_shingle_sets(documents.select("doc_id", "text"), words).select("doc_id", hashed, "set.*"))
    coded = made.select("doc_id", "text_hash", "code")
    sets = stage(made.groupBy("code").agg(*[F.first(c).alias(c) for c in ("n", "finger", "keys")]))
    groups = stage(minhash.members_of(sets).select("key", "code", "parts").union(_finger_groups(sets)))
    wanted = groups.select("code").distinct()
    row = F.xxhash64("doc_id", "text_hash")
    first = coded.join(wanted, "code").groupBy("code").agg(F.min(F.struct(row.alias("row"), "text_hash")).alias("f"))
    first = stage(first.select("code", F.col("f.row").alias("_row"), F.col("f.text_hash").alias("_hash")))
    named = documents.select("doc_id", "text", hashed).select("text", "text_hash", row.alias("row"))
    read = possibly(named, F.col("row"), first, F.col("_row")).where("_maybe")

    @F.pandas_udf("array<long>")
    def shingles(column: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t or "", words)).astype(np.int64) for t in column])

    one = read.join(first, F.expr("row = _row AND text_hash = _hash")).groupBy("code").agg(F.first("text").alias("text"))
    whole = stage(one.select("code", shingles("text").alias("shingles")))
    links = stage(minhash.similar_links(groups, whole, similarity))
    return coded, stage(components(links).withColumnRenamed("node", "code"))


def keep_one(documents: DataFrame, words: int = COPY_WORDS, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """The rows of `documents`, all columns, without near copies: of each component the smallest doc_id stays.

    Texts are linked where the Jaccard similarity of their sets of shingles is at least `similarity`; a component is
    what links reach. Candidates come from the Gray-order index over fingerprints of these shingles and, as texts of
    similarity 0.8 are some ten bits apart and so beyond any index of fingerprints, from MinHash bands as well (see
    minhash.py). All candidates are compared shingle by shingle. Texts without a word are copies of each other.

    Rows without doc_id come last; of rows with one doc_id and several texts one text stays, and of repeated rows
    (equal doc_id and text) one row. Only rows that may have to go are shuffled with their text.
    """
    coded, linked = _near_copies(documents, words, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    by_code = _least_of_component(coded, linked, order, "kept")
    kept = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash"))
    dropped = coded.join(by_code, "code").where(~kept).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    dropped = stage(dropped.distinct())
    split = possibly(set_apart(documents, ("doc_id", "text")), F.col("doc_id"), dropped, F.col("_id"))
    some = split.where("_maybe").drop("_maybe")
    same = some["doc_id"].eqNullSafe(dropped["_id"]) & (F.xxhash64(F.coalesce(some["text"], F.lit(""))) == dropped["_hash"])
    left = split.where("NOT _maybe").drop("_maybe").unionByName(some.join(dropped, same, "left_anti"))
    left = put_back(left, documents.columns, ("doc_id", "text"))
    repeated = coded.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return left if repeated.isEmpty() else left.dropDuplicates(["doc_id", "text"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
