"""Vectors dealt to shards around pivots, and the k nearest of each query, with shards skipped by the triangle inequality.

Vectors are brought to length one. Pivots are a few of them; each vector goes to the shard of its nearest pivot, and a shard
knows the largest angle to its pivot, its radius. A query with the angle a to a pivot has no cosine above cos(a - radius) in
that shard. It is answered in its most promising shard first; its k-th best there is the threshold that other shards must
reach, which is where it goes on. A shard gives at most k rows for a query. Large shards are split in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.staging import release, stage

#: Vectors of a shard, and of a part of one that turned out larger, on average; and the most pivots over all widths.
SHARD_VECTORS, MOST_PIVOTS = 4096, 4096
#: Queries that a task multiplies with a part of a shard at once.
SLICE_QUERIES = 256
#: Room for rounding in a bound, as an angle.
ROOM = 1e-6
#: Set by tests: count, as products and skipped of the index, query-shard pairs that were multiplied and that were not.
COUNT_PRODUCTS = False


@dataclass
class VectorIndex:
    """rows: chunk_id, vector (of length one), content, flag, width, shard, part; pivots: for each width, a row for each shard."""

    rows: DataFrame
    pivots: dict[int, np.ndarray]
    #: For each width: radius, number of vectors and number of parts of each shard.
    radius: dict[int, np.ndarray]
    count: dict[int, np.ndarray]
    parts: dict[int, np.ndarray]

    def release(self) -> None:
        release(self.rows)


def usable(df: DataFrame, name: str, *more: Column) -> DataFrame:
    """(name, vector, width, more) of vectors that are neither null nor empty, hold no null or non-finite number, and have a length."""
    own = df.select(name, F.col("vector").cast("array<double>").alias("vector"), *more).where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    finite = own.where(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))
    return finite.where(F.exists("vector", lambda x: x != 0)).withColumn("width", F.size("vector"))


def _unit(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def build(vectors: DataFrame) -> VectorIndex:
    """Index vectors (chunk_id, vector). Those that are not usable take no part; an empty table gives an empty index.

    Where there is a column `content`, chunks of equal content count once among the best of a query; where there is one
    `boilerplate`, chunks for which it is true come after all others of a query without `templates`.
    """
    content = F.col("content") if "content" in vectors.columns else F.lit(None).cast("string")
    flag = F.coalesce("boilerplate", F.lit(False)) if "boilerplate" in vectors.columns else F.lit(False)
    same = F.coalesce(F.nullif(content, F.lit("")), F.concat(F.lit("id:"), F.col("chunk_id").cast("string")))
    own = usable(vectors, "chunk_id", same.alias("content"), flag.alias("flag"))
    sizes = {r["width"]: r["count"] for r in own.groupBy("width").count().collect()}  # a row for each width
    total = max(1, sum(sizes.values()))
    wanted = {w: max(1, min(-(-n // SHARD_VECTORS), MOST_PIVOTS * n // total)) for w, n in sizes.items()}
    place = F.pmod(F.xxhash64("vector"), F.lit(1 << 40))
    share = F.lit(False)
    for width, n in sizes.items():
        share = share | (F.col("width") == width) & (place < int(min(1.0, (4 * wanted[width] + 16) / n) * (1 << 40)))
    found: dict[int, list] = {w: [] for w in sizes}
    # A few times the pivots that are wanted, at most; equal vectors are one.
    for r in own.where(share).select("width", place.alias("place"), "vector").distinct().orderBy("width", "place", "vector").collect():
        if len(found[r["width"]]) < wanted[r["width"]]:
            found[r["width"]].append(r["vector"])
    pivots = {w: _unit(np.array(v if v else [np.eye(1, w)[0]], float)) for w, v in found.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # MOST_PIVOTS rows, and one for each width

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, rows in batch.groupby("width"):
                unit = _unit(np.array(list(rows["vector"]), float))
                angle = _angles(unit, shared.value[int(width)])
                shard = angle.argmin(axis=1)
                yield pd.DataFrame({"chunk_id": rows["chunk_id"], "vector": list(unit), "content": rows["content"], "flag": rows["flag"], "width": rows["width"], "shard": shard.astype(np.int32), "angle": angle[np.arange(len(unit)), shard]})

    kind = own.schema["chunk_id"].dataType.simpleString()
    dealt = stage(own.mapInPandas(deal, f"chunk_id {kind}, vector array<double>, content string, flag boolean, width int, shard int, angle double"))
    radius, count = ({w: np.zeros(len(p), t) for w, p in pivots.items()} for t in (float, np.int64))
    for r in dealt.groupBy("width", "shard").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["width"]][r["shard"]], count[r["width"]][r["shard"]] = r["radius"], r["n"]
    parts = {w: np.maximum(1, -(-c // SHARD_VECTORS)) for w, c in count.items()}
    split = [(int(w), s, int(n)) for w, p in parts.items() for s, n in enumerate(p)]
    numbers = vectors.sparkSession.createDataFrame(split, "width int, shard int, parts int")
    part = F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")
    rows = dealt.join(F.broadcast(numbers), ["width", "shard"]).select("chunk_id", "vector", "content", "flag", "width", "shard", part.alias("part"))
    return VectorIndex(rows, pivots, radius, count, parts)


def _nearest(k: int, decimals: int | None):
    """Of a part of a shard: the k best of each query that reach its threshold, and the number of positive cosines."""

    def nearest(stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "chunk_id", "content", "demoted", "similarity", "n"]
        if not len(stored) or not len(asked):
            return pd.DataFrame([], columns=columns, dtype=object)
        ids = stored["chunk_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, matrix = ids[order], np.array(list(stored["vector"]), float)[order]
        names, flag = stored["content"].to_numpy()[order], stored["flag"].to_numpy(bool)[order]
        content = pd.factorize(names)[0]
        least, templates, counted = asked["least"].to_numpy(float), asked["templates"].to_numpy(bool), asked["counted"].to_numpy(bool)
        whose, which, near, positive = [], [], [], np.zeros(len(asked), np.int64)
        for low in range(0, len(asked), SLICE_QUERIES):  # so the products held at once do not grow with the queries
            product = np.array(list(asked["vector"].iloc[low : low + SLICE_QUERIES]), float) @ matrix.T
            score = product if decimals is None else np.round(product, decimals)
            positive[low : low + len(product)] = np.count_nonzero(product > 0, axis=1)
            for i, q in enumerate(range(low, low + len(product))):
                demoted = flag & (not templates[q])
                at = np.flatnonzero((product[i] > 0) & (score[i] >= least[q]) & ((least[q] <= 0) | ~demoted))
                # Ties go to the smaller id, which is the order of the columns; of each content the first counts.
                at = at[np.lexsort((at, -score[i][at], demoted[at]))]
                at = at[np.sort(np.unique(content[at], return_index=True)[1])[:k]]
                whose.append(np.full(len(at), q))
                which.append(at)
                near.append(product[i][at])
        q, at = np.concatenate(whose), np.concatenate(which)
        found = pd.DataFrame({"query_id": asked["query_id"].to_numpy()[q], "chunk_id": ids[at], "content": names[at], "demoted": flag[at] & ~templates[q], "similarity": np.concatenate(near), "n": None})
        if not counted.any():
            return found
        numbers = pd.DataFrame({"query_id": asked["query_id"].to_numpy()[counted], "n": positive[counted]}).reindex(columns=columns)
        return pd.concat([frame.astype(object).where(frame.notna(), None) for frame in (found, numbers)], ignore_index=True)

    return nearest


def search(index: VectorIndex, queries: DataFrame, k: int, decimals: int | None = None, counts: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(query_id, chunk_id, similarity, demoted, rank): the k best positive cosines of each query; if asked for, (query_id, vector).

    That is the number of positive cosines: shards that are surely positive or surely not are not visited for it. Ties go to
    the smaller chunk_id; with `decimals` similarities are rounded for the order. Queries that are not usable, or of a width
    that no vector has, have no rows.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    chunk = index.rows.schema["chunk_id"].dataType.simpleString()
    templates = F.coalesce("templates", F.lit(False)) if "templates" in queries.columns else F.lit(False)
    asked = usable(queries, "query_id", templates.alias("templates"))
    pivots, radius, count, parts = index.pivots, index.radius, index.count, index.parts

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, rows in batch.groupby("width"):
                if int(width) not in pivots:
                    continue
                unit = _unit(np.array(list(rows["vector"]), float))
                angle, own, n = _angles(unit, pivots[int(width)]), radius[int(width)], count[int(width)]
                upper = np.where(n > 0, np.cos(np.maximum(0.0, angle - own - ROOM)), -2.0)
                lower = np.cos(np.minimum(np.pi, angle + own + ROOM))
                yield pd.DataFrame({"query_id": rows["query_id"], "vector": list(unit), "templates": rows["templates"], "width": rows["width"], "upper": list(upper), "lower": list(lower)})

    shared = stage(asked.mapInPandas(bounded, f"query_id {kind}, vector array<double>, templates boolean, width int, upper array<double>, lower array<double>"))
    home = shared.select("query_id", "vector", "templates", "width", (F.array_position("upper", F.array_max("upper")) - 1).cast("int").alias("shard"), F.lit(0.0).alias("least"), F.lit(counts).alias("counted"))
    spark = shared.sparkSession
    numbers = spark.createDataFrame([(int(w), s, int(n)) for w, p in parts.items() for s, n in enumerate(p)] or [(-1, 0, 1)], "width int, shard int, parts int")
    schema = f"query_id {kind}, chunk_id {chunk}, content string, demoted boolean, similarity double, n long"
    keys = ["width", "shard", "part"]

    def visit(to: DataFrame) -> DataFrame:
        spread = to.join(F.broadcast(numbers), ["width", "shard"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return stage(index.rows.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(_nearest(k, decimals), schema))

    def ranked(found: DataFrame) -> DataFrame:
        """The k best of what k rows of each part come to."""
        score: Column = F.col("similarity") if decimals is None else F.round("similarity", decimals)
        order = [F.col("demoted").asc(), score.desc(), F.col("chunk_id").asc()]
        once = found.where("chunk_id IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "content").orderBy(*order))).where("_n = 1")
        placed = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
        return placed.select("query_id", "chunk_id", "similarity", "demoted", "rank")

    first = visit(home)
    score = F.col("similarity") if decimals is None else F.round("similarity", decimals)
    # A k-th best that is demoted is no threshold: whatever is not demoted stands before it.
    least = ranked(first).where((F.col("rank") == k) & ~F.col("demoted")).select("query_id", score.alias("least"))
    known = shared.join(home.select("query_id", F.col("shard").alias("home")), "query_id").join(least, "query_id", "left")
    reach = F.coalesce("least", F.lit(0.0))
    room = 0.0 if decimals is None else 10.0**-decimals
    promising = (F.col("u.upper") > 0) & (F.col("u.upper") >= reach - room)
    unsure = F.lit(counts) & (F.col("u.upper") > 0) & (F.col("u.lower") <= 0)
    others = F.arrays_zip("upper", "lower")
    pairs = known.select("query_id", "vector", "templates", "width", "home", reach.alias("least"), F.posexplode(others).alias("shard", "u")).where("shard <> home AND u.upper > -2")
    going = stage(pairs.where(promising | unsure).select("query_id", "vector", "templates", "width", "shard", "least", (unsure | (F.lit(counts) & (F.col("u.lower") <= 0))).alias("counted")))
    second = visit(going)
    hits = stage(ranked(first.unionByName(second)))
    numbered = None
    if counts:
        sizes = spark.createDataFrame([(int(w), s, int(n)) for w, c in count.items() for s, n in enumerate(c)] or [(-1, 0, 0)], "width int, shard int, size long")
        sure = pairs.where("u.lower > 0").join(F.broadcast(sizes), ["width", "shard"]).select("query_id", F.col("size").alias("n"))
        seen = first.unionByName(second).where("chunk_id IS NULL").select("query_id", "n").unionByName(sure)
        numbered = stage(seen.groupBy("query_id").agg(F.sum("n").alias("vector")))
    if COUNT_PRODUCTS:
        index.products, index.skipped = going.count() + home.count(), pairs.count() - going.count()
        index.made = first.where("chunk_id IS NOT NULL").count() + second.where("chunk_id IS NOT NULL").count()
    release(shared, first, going, second)
    return hits, numbered
