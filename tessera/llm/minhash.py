"""Sets of shingles with a Jaccard similarity of at least a bound: MinHash bands, then an exact comparison.

A set has BANDS keys, each a hash of BAND_ROWS minima of the set under different permutations. Two sets of similarity s
share a key with probability 1 - (1 - s ** BAND_ROWS) ** BANDS: 0.9996 at 0.8. The sets of a key are compared with each
other shingle by shingle in one task, which gives links that span what is similar among them, and never pairs. A key
with more sets than BLOCK, or more shingles than SHINGLES, is compared in parts, each two parts together. Keys that the
same sets share count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, salted_lookup, stage

BANDS, BAND_ROWS = 20, 5
#: Sets, and their shingles together, of a part of a key.
BLOCK, SHINGLES = 1024, 1 << 21
#: Shingles that are permuted at once, and columns of a product.
PART, WIDTH = 2048, 1 << 13
#: Odd multipliers and masks of the permutations.
_RANDOM = np.random.default_rng(7)
MULTIPLIERS = _RANDOM.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _RANDOM.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The keys of a set of shingle hashes; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(len(MASKS), (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), PART):
        part = shingles[at : at + PART][None, :] ^ MASKS[:, None]
        part *= MULTIPLIERS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys.astype(np.int64)


def members_of(sets: DataFrame) -> DataFrame:
    """(key, code, parts): the sets (code, n, keys) of each key that several share, without keys of the same sets."""
    spread = sets.select("code", "n", F.explode("keys").alias("key"))
    one = F.xxhash64("code")
    counted = spread.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("total"), F.min(one).alias("x"), F.max(one).alias("y"), F.bit_xor(one).alias("z"))
    distinct = counted.where("many > 1").groupBy("many", "total", "x", "y", "z").agg(F.min("key").alias("key"))
    parts = F.greatest(F.ceil(F.col("many") / BLOCK), F.ceil(F.col("total") / SHINGLES)).cast("int")
    kept = stage(distinct.select("key", parts.alias("parts")))
    return stage(salted_lookup(spread.drop("n"), kept, "key", F.col("code"), 8))


def local_links(codes: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span the components of "similar enough" among sets of distinct shingles."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        c = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        good = c >= similarity * (sizes.sum() - c) - 1e-9
        return (codes[1:], codes[:1]) if good else (codes[:0], codes[:0])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    several = np.bincount(column)[column] > 1
    row, column = row[several], column[several]
    used, column = np.unique(column, return_inverse=True)
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for left in range(0, len(used), WIDTH):
        a, b = np.searchsorted(column, (left, left + WIDTH))
        present = np.zeros((len(sets), min(WIDTH, len(used) - left)), np.float32)
        present[row[a:b], column[a:b] - left] = 1
        common += present @ present.T
    good = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    np.fill_diagonal(good, True)
    roots = np.arange(len(sets))
    while True:
        lower = np.where(good, roots[None, :], len(sets)).min(axis=1)
        lower = lower[lower]
        if (lower == roots).all():
            break
        roots = lower
    moved = roots != np.arange(len(sets))
    return codes[moved], codes[roots[moved]]


def similar_links(groups: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that span the components of "similarity of at least `similarity`" within each key of `groups`.

    groups: key, code and parts; whole: code and shingles, distinct and sorted. Every two sets of a key are compared.
    """
    spark = groups.sparkSession
    bounded_batches(spark)
    part = F.pmod(F.xxhash64("code"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_o")
    spread = groups.select("key", "code", part.alias("_p"), other).select("key", "code", F.least("_p", "_o").alias("i"), F.greatest("_p", "_o").alias("j"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spread.join(whole.hint("merge"), "code").repartition(partitions, "key", "i", "j").sortWithinPartitions("key", "i", "j", "code")

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def of_groups(rows: pd.DataFrame) -> pd.DataFrame:
            names, codes, sets = rows[["key", "i", "j"]].to_numpy(), rows["code"].to_numpy(np.int64), list(rows["shingles"])
            edges = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
            found = [local_links(codes[x:y], sets[x:y], similarity) for x, y in zip(edges, edges[1:]) if y - x > 1]
            none = [np.zeros(0, np.int64)]
            return pd.DataFrame({"a": np.concatenate([f[0] for f in found] or none), "b": np.concatenate([f[1] for f in found] or none)})

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            last = (rows[["key", "i", "j"]] == rows[["key", "i", "j"]].iloc[-1]).all(axis=1)
            held = rows[last]
            if not last.all():
                yield of_groups(rows[~last])
        if held is not None and len(held):
            yield of_groups(held)

    return rows.mapInPandas(linked, "a long, b long").distinct()
