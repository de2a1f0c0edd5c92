"""Exact top-k by inner product over whole-number vectors, with MaxScore.

A query's terms are its dimensions. The most that a dimension can add to a score among some rows is its bound there.

Rows are dealt to shards by their strongest term; terms of few rows share a shard, so that a shard is worth a task. A query is first answered in the shard of its own strongest term;
its k-th best score there is its threshold. It then goes to those other shards only whose bounds, summed over its terms,
reach the threshold. Within a shard rows lie in posting blocks of like rows: a block whose bounds do not reach the
threshold is passed over. In the others terms are ordered by what they can add over the least; a tail of terms that
together could not lift a row to the threshold is non-essential. The essential terms are traversed for every row, the
others probed step by step, in the end only for rows that partial score and remaining bounds keep competitive. Shards
give their best k, and these are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage, table

SCALE = 1024
K = 10
QUERY_EVERY = 100
#: Rows of a shard, queries of a block, and shards whose bounds a task looks at, on average: they are dealt by hash.
SHARD_ROWS, BLOCK_QUERIES, BLOCK_SHARDS = 4096, 1024, 2048
#: Queries that are scored together, rows of a posting block, terms of a probing step.
QUERY_ROWS, POSTING_ROWS, STEP = 64, 256, 8
#: Rows are probed one by one once so small a share of a block is competitive; until then a step is a matrix product.
SPARSE = 0.25
#: Products below this are exact in double arithmetic.
EXACT = 1 << 53
LARGEST = 1.7976931348623157e308
RESULT = ["query_id", "vec_id", "score"]


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array of double, whole numbers): floor(SCALE * x) of each component x.

    Rows that are null, have a null id, or hold a null or non-finite component, take no part.
    """
    x = F.col("embedding")
    scaled = F.transform(x, lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v.cast("double") * SCALE)))
    # floor() gives a long; beyond 2 ** 52 a double is whole already.
    whole = F.transform(scaled, lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite).select("vec_id", whole.alias("vector"))


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Rows of equal width: shorter vectors are filled with zeros, which add nothing to a product."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that each query can score among rows between low and high: (queries, bounds)."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class Search:
    """The k best of some rows for each of some queries; `skipped` of `products` single products were not needed."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, thresholds: np.ndarray, k: int) -> None:
        self.queries, self.own, self.least, self.k = queries, own, thresholds.astype(float), k
        self.found = [(np.zeros(0), np.zeros(0, np.int64)) for _ in own]
        self.products = self.skipped = 0

    def among(self, rows: np.ndarray, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        strength = np.abs(rows)
        first = strength.argmax(axis=1)
        strength[np.arange(len(rows)), first] = -1
        order = np.lexsort((ids, rows[np.arange(len(rows)), first], strength.argmax(axis=1), first))
        rows, ids = rows[order], ids[order]
        blocks = [slice(at, at + POSTING_ROWS) for at in range(0, len(rows), POSTING_ROWS)]
        high = np.array([rows[b].max(axis=0) for b in blocks])
        low = np.array([rows[b].min(axis=0) for b in blocks])
        reach = bounds(self.queries, high, low)
        self.products += len(self.queries) * rows.size
        for n in np.argsort(-reach.max(axis=0), kind="stable"):
            alive = np.flatnonzero(reach[:, n] >= self.least)
            block = rows[blocks[n]]
            self.skipped += (len(self.queries) - len(alive)) * block.size
            for at in range(0, len(alive), QUERY_ROWS):
                self._block(alive[at : at + QUERY_ROWS], block, ids[blocks[n]], high[n], low[n])
        return self.found

    def _block(self, which: np.ndarray, block: np.ndarray, ids: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
        some, threshold, width = self.queries[which], self.least[which], block.shape[1]
        most, fewest = np.maximum(some * high, some * low), np.minimum(some * high, some * low)
        terms = np.argsort(-(most - fewest).sum(axis=0), kind="stable")
        some, block = some[:, terms], block[:, terms]

        def rest(x: np.ndarray) -> np.ndarray:
            """What the terms from each place on add up to."""
            return np.concatenate([x[:, terms][:, ::-1].cumsum(axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1)

        remaining, spread = rest(most), rest(most - fewest)
        # Essential terms: those before the tail that cannot lift a row from the least score to the threshold.
        done = int((spread >= (threshold - fewest.sum(axis=1))[:, None]).sum(axis=1).max())
        done = min(width, max(1, done))
        partial = some[:, :done] @ block[:, :done].T
        competitive = partial + remaining[:, done, None] >= threshold[:, None]
        while done < width and competitive.mean() > SPARSE:
            upto = min(width, done + STEP)
            partial += some[:, done:upto] @ block[:, done:upto].T
            done = upto
            competitive = partial + remaining[:, done, None] >= threshold[:, None]
        q, r = np.nonzero(competitive)
        score = partial[q, r]
        self.skipped += (partial.size - len(q)) * (width - done)
        while done < width and len(q):
            upto = min(width, done + STEP)
            score = score + np.einsum("ij,ij->i", some[q, done:upto], block[r, done:upto])
            keep = score + remaining[q, upto] >= threshold[q]
            self.skipped += int((~keep).sum()) * (width - upto)
            q, r, score, done = q[keep], r[keep], score[keep], upto
        cuts = np.searchsorted(q, np.arange(len(which) + 1))
        for i, place in enumerate(which):
            s, n = score[cuts[i] : cuts[i + 1]], ids[r[cuts[i] : cuts[i + 1]]]
            other = n != self.own[place]
            s, n = s[other], n[other]
            if not len(s):
                continue
            old = self.found[place]
            self.found[place] = new = best(np.concatenate([old[0], s]), np.concatenate([old[1], n]), self.k)
            if len(new[0]) == self.k:
                self.least[place] = max(self.least[place], new[0][-1])


def _largest(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]


def _searched(asked: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of `rows` for each of `asked` that reach its threshold."""
    if not len(asked) or not len(rows):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in RESULT})
    width = max(asked["vector"].map(len).max(), rows["vector"].map(len).max(), 1)
    queries, stored = _matrix(list(asked["vector"]), width), _matrix(list(rows["vector"]), width)
    own, ids = asked["vec_id"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64)
    if _largest(queries, stored) < EXACT:
        found = Search(queries, own, asked["threshold"].to_numpy(float), k).among(stored, ids)
        parts = [pd.DataFrame({"query_id": q, "vec_id": n, "score": s.astype(np.int64)}) for q, (s, n) in zip(own, found)]
        return pd.concat(parts, ignore_index=True)[RESULT]
    out = []
    for q, vector in zip(own, queries):  # too large for doubles: whole numbers of any size, clamped to long at the end
        scores = [sum(int(a) * int(b) for a, b in zip(vector, row)) for row in stored]
        ranked = sorted((-s, n) for s, n in zip(scores, ids) if n != q)[:k]
        out += [(q, n, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, n in ranked]
    return pd.DataFrame(out, columns=RESULT).astype(np.int64)


def _at_home(asked: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Results of _searched, and a row with the shard's bounds."""
    found = _searched(asked.assign(threshold=-np.inf), rows, k)
    found["shard"] = found["high"] = found["low"] = None
    if len(rows):
        stored = _matrix(list(rows["vector"]), max(rows["vector"].map(len).max(), 1))
        edge = {"query_id": None, "vec_id": None, "score": None, "shard": rows["shard"].iloc[0], "high": stored.max(axis=0), "low": stored.min(axis=0)}
        found = pd.concat([found.astype(object), pd.DataFrame([edge])], ignore_index=True)
    return found


def _competitive(asked: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
    """(query_id, shard): where a query's threshold is within the bounds, but for its own shard."""
    if not len(asked) or not len(shards):
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "shard": np.zeros(0, np.int64)})
    width = max(*(x.map(len).max() for x in (asked["vector"], shards["high"])), 1)
    queries, high, low = (_matrix(list(x), width) for x in (asked["vector"], shards["high"], shards["low"]))
    if max(_largest(queries, high), _largest(queries, low)) < EXACT:
        open_ = bounds(queries, high, low) >= asked["threshold"].to_numpy(float)[:, None]
    else:
        open_ = np.ones((len(queries), len(high)), bool)
    open_ &= asked["shard"].to_numpy()[:, None] != shards["shard"].to_numpy()[None, :]
    q, s = np.nonzero(open_)
    return pd.DataFrame({"query_id": asked["vec_id"].to_numpy()[q], "shard": shards["shard"].to_numpy()[s]})


def _term() -> Column:
    """The number of the strongest term, with its sign."""
    size = F.transform("vector", lambda v: F.abs(v))
    place = F.array_position(size, F.array_max(size))
    return F.coalesce(2 * place + F.when(F.get("vector", (place - 1).cast("int")) < 0, 1).otherwise(0), F.lit(0))


def _terms_together(terms: DataFrame) -> DataFrame:
    """term, first, parts: terms of SHARD_ROWS rows or more in so many parts; smaller ones, in order, with the first of theirs.

    The terms before one, counted in whole shards, tell which belong together.
    """
    small = F.col("n") < SHARD_ROWS
    before = Window.orderBy("term").rowsBetween(Window.unboundedPreceding, -1)
    counted = terms.withColumn("_with", F.when(small, F.floor(F.coalesce(F.sum(F.when(small, F.col("n"))).over(before), F.lit(0)) / SHARD_ROWS)).otherwise(-1 - F.col("term")))
    first = F.min("term").over(Window.partitionBy("_with"))
    return counted.select("term", first.alias("first"), F.ceil(F.col("n") / SHARD_ROWS).alias("parts"))


def _one_of_each(vectors: DataFrame) -> DataFrame:
    """vec_id and vector: of several rows of an id the first by components."""
    vectors = vectors.select("vec_id", "vector")
    several = stage(vectors.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"))
    if several.isEmpty():
        return vectors
    chosen = vectors.join(several, "vec_id").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return vectors.join(several, "vec_id", "left_anti").unionByName(chosen)


def _dealt(name: str, parts: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(name, F.lit(seed)), F.lit(parts)).cast("int")


def _every(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of `vectors` for each of `queries`, but its own.

    Both have vec_id and vector (whole_vectors). Fewer than k rows give all of them; ties go to the smaller vec_id; an
    id stands for one row, and of several rows of an id the first by components counts. Vectors of unequal length are
    compared as if filled with zeros. Scores beyond a long are clamped to it. Empty tables give no rows; other columns
    are not read, whatever their names.
    """
    found_in = _one_of_each(vectors).withColumn("term", _term())
    # At most two terms for each dimension, so this table is small whatever the rows.
    parts = stage(_terms_together(found_in.groupBy("term").agg(F.count(F.lit(1)).alias("n"))))
    shard = (F.shiftleft(F.coalesce("first", "term").cast("long"), 32) + F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1)))).alias("shard")
    rows = stage(found_in.join(F.broadcast(parts), "term").select("vec_id", "vector", shard))
    asked = _one_of_each(queries).withColumn("term", _term()).join(F.broadcast(parts), "term", "left")
    asked = stage(asked.select("vec_id", "vector", shard))

    most = asked.groupBy("shard").count().agg(F.max("count").alias("n")).first()["n"] or 1
    blocks = max(1, math.ceil(most / BLOCK_QUERIES))
    schema = "query_id long, vec_id long, score long"
    home = (
        asked.withColumn("block", _dealt("vec_id", blocks, 1))
        .groupBy("shard", "block")
        .cogroup(rows.withColumn("block", _every(blocks)).groupBy("shard", "block"))
        .applyInPandas(lambda left, right: _at_home(left, right, k), schema + ", shard long, high array<double>, low array<double>")
    )
    home = stage(home)
    near = home.where("query_id IS NOT NULL").select(*RESULT)
    shards = home.where("query_id IS NULL").dropDuplicates(["shard"]).select("shard", "high", "low")
    full = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").cast("double").alias("threshold"), F.count(F.lit(1)).alias("n"))
    full = full.where((F.col("n") == k) & (F.abs("threshold") < EXACT)).select("vec_id", "threshold")
    asked = stage(asked.join(full, "vec_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(float("-inf")))))

    blocks = max(1, math.ceil(asked.count() / BLOCK_QUERIES))
    groups = max(1, math.ceil(shards.count() / BLOCK_SHARDS))
    pairs = (
        asked.withColumn("block", _dealt("vec_id", blocks, 2))
        .withColumn("group", _every(groups))
        .groupBy("block", "group")
        .cogroup(shards.withColumn("group", _dealt("shard", groups, 3)).withColumn("block", _every(blocks)).groupBy("block", "group"))
        .applyInPandas(_competitive, "query_id long, shard long")
    )
    pairs = stage(pairs)
    sent = pairs.withColumnRenamed("query_id", "vec_id").join(asked.drop("shard"), "vec_id").withColumn("block", _dealt("vec_id", blocks, 2))
    wanted = pairs.select("shard", _dealt("query_id", blocks, 2).alias("block")).distinct()
    far = (
        sent.groupBy("shard", "block")
        .cogroup(rows.join(wanted, "shard").groupBy("shard", "block"))
        .applyInPandas(lambda left, right: _searched(left, right, k), schema)
    )
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
