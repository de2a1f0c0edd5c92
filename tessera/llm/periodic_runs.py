"""Runs of words that repeat with a period, found by block convolution.

At each scale b (8, 16, 32, ...) the words are cut into blocks of b. A number theoretic transform gives, for each block, the
sums of squared differences between it and the words at every distance from b to 2b - 1 (from 1 at the first scale); the
sums are exact integers, so zero means that the block occurs there. A run of period q and three periods' length holds a
whole block of the scale b <= q < 2b with its occurrence at distance q, so no run is missed. Each distance is a seed: it is
extended to both sides as far as words so far apart are equal, and kept where the stretch is long enough.

Sums are of small numbers drawn from the words, so few enough bits are added for the modulus; a seed's extension is made
with hashes, and every run is compared word by word in the end, so that neither can change a result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, put_back, set_apart, table

#: A run has this many words, and this many periods, at least.
LEAST_LENGTH, LEAST_PERIODS = 24, 3
#: Length of a block of the first scale. Match positions of a shorter period number 17 or more, so they hold one.
FIRST_BLOCK = 8
#: A prime below 2**32 with roots of unity of order 2**30, more than a text of 2 GB asks for, and a generator.
MODULUS, GENERATOR = 3 * (1 << 30) + 1, 5
P = np.uint64(MODULUS)
#: Numbers that are transformed at once, but for a block that is longer itself.
TOGETHER = 1 << 16
#: Odd multipliers of the hashes.
MIX, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)

_words = re.compile("[^ \t-\r]+").findall


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo P; division by a constant is vectorised, the remainder is not."""
    return x - x // P * P


@functools.lru_cache(maxsize=64)
def _roots(size: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a root of unity of order `size`."""
    root = pow(GENERATOR, (MODULUS - 1) // size, MODULUS)
    root = pow(root, -1, MODULUS) if inverse else root
    out = np.ones(1, np.uint64)
    while len(out) < size // 2:
        out = np.concatenate([out, _reduced(out * np.uint64(pow(root, len(out), MODULUS)))])
    return out


@functools.lru_cache(maxsize=64)
def _mirror(size: int) -> np.ndarray:
    """In bit-reversed order, the place of frequency -k for each frequency k."""
    bits, turned, k = size.bit_length() - 1, np.zeros(size, np.int64), np.arange(size)
    for i in range(bits):
        turned |= (k >> i & 1) << (bits - 1 - i)
    return turned[(-turned) % size]


def transform(rows: np.ndarray) -> np.ndarray:
    """The transform of each row (a power of two long), frequencies in bit-reversed order."""
    count, size = rows.shape
    x, half = rows.astype(np.uint64), size // 2
    while half:
        x = x.reshape(-1, 2, half)
        a, b = x[:, 0], x[:, 1]
        out = np.empty_like(x)
        total, rest = a + b, a + P - b
        out[:, 0] = total - P * (total >= P)
        rest -= P * (rest >= P)
        out[:, 1] = _reduced(rest * _roots(2 * half, False)) if half > 1 else rest
        x, half = out, half // 2
    return x.reshape(count, size)


def inverse(rows: np.ndarray) -> np.ndarray:
    """From bit-reversed frequencies back to numbers."""
    count, size = rows.shape
    x, half = rows, 1
    while half < size:
        x = x.reshape(-1, 2, half)
        a, b = x[:, 0], x[:, 1]
        b = _reduced(b * _roots(2 * half, True)) if half > 1 else b
        out = np.empty_like(x)
        total, rest = a + b, a + P - b
        out[:, 0] = total - P * (total >= P)
        out[:, 1] = rest - P * (rest >= P)
        x, half = out, half * 2
    return _reduced(x.reshape(count, size) * np.uint64(pow(size, -1, MODULUS)))


def occurrences(ids: np.ndarray, block: int, nearest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, distance) of blocks that, by their numbers, occur again at `nearest` (0 or `block`) to that + block - 1.

    A number is a few bits of a word's hash: so few that no sum of a block's squares reaches the modulus.
    """
    bits = 1
    while block * ((2 << bits) - 1) ** 2 < MODULUS and bits < 15:
        bits += 1
    numbers = (((ids.astype(np.uint64) + np.uint64(1)) * MIX) >> np.uint64(64 - bits)).astype(np.uint64)
    blocks, shift = -(-len(ids) // block), nearest // block
    padded = np.zeros((blocks + 2) * block, np.uint64)
    padded[: len(ids)] = numbers
    squares = np.concatenate([np.zeros(1, np.int64), np.cumsum((padded * padded).astype(np.int64))])
    padded = padded.reshape(-1, block)
    step, mirror, offsets = max(1, TOGETHER // (2 * block)), _mirror(2 * block), np.arange(block)
    for first in range(0, blocks, step):
        last = min(blocks, first + step)
        rows = padded[first : last + 2]
        known = transform(np.concatenate([rows, np.zeros_like(rows)], axis=1))
        count = last - first
        near, far = known[shift : shift + count], known[shift + 1 : shift + 1 + count]
        # The second block stands `block` places on in the window: odd frequencies, the second half, change sign.
        window = np.concatenate([near[:, :block] + far[:, :block], near[:, block:] + P - far[:, block:]], axis=1)
        found = inverse(_reduced(_reduced(window) * known[:count][:, mirror]))[:, :block].astype(np.int64)
        start = np.arange(first, last)[:, None] * block
        at = np.minimum(start + nearest + offsets, len(squares) - 1 - block)
        mismatch = squares[start + block] - squares[start] + squares[at + block] - squares[at] - 2 * found
        row, offset = np.nonzero(mismatch == 0)
        distance = offset + nearest
        start = (first + row) * block
        inside = (distance > 0) & (start + distance + block <= len(ids))
        yield start[inside], distance[inside]


class Hashes:
    """Hashes of all stretches of a sequence: unequal hashes mean unequal words."""

    def __init__(self, ids: np.ndarray) -> None:
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * MIX
        mixed ^= mixed >> np.uint64(29)
        powers = np.full(len(ids) + 1, BASE, np.uint64)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * self.powers[:-1], dtype=np.uint64)])

    def equal(self, start: np.ndarray, end: np.ndarray, distance: np.ndarray) -> np.ndarray:
        own, other = self.sums[end] - self.sums[start], self.sums[end + distance] - self.sums[start + distance]
        return own * self.powers[distance] == other

    def stretch(self, start: np.ndarray, distance: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch around `start` within [least, most) whose words equal those at `distance`; it ends with the latter."""
        low, high = np.zeros_like(start), most - start - distance
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(start, start + middle, distance)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        end = start + low + distance
        low, high = np.zeros_like(start), start - least
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(start - middle, start, distance)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return start - low, end


def _exact(ids: np.ndarray, start: int, end: int, distance: int, seed: int) -> tuple[int, int]:
    """The stretch, or, where a hash misled, the part of it around `seed` whose words are equal."""
    differ = np.flatnonzero(ids[start : end - distance] != ids[start + distance : end]) + start
    at = np.searchsorted(differ, seed)
    if at < len(differ) and differ[at] == seed:
        return seed, seed
    return (int(differ[at - 1]) + 1 if at else start), (int(differ[at]) + distance if at < len(differ) else end)


def _runs(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs of sequences of `sizes`, longest first, that stand in `ids` one after another."""
    ends = np.cumsum(sizes)
    begins, found = ends - sizes, np.zeros((0, 3), np.int64)
    block, nearest = FIRST_BLOCK, 0
    hashes = Hashes(ids)
    while (sizes >= max(LEAST_LENGTH, LEAST_PERIODS * nearest)).any():
        upto = int(ends[np.count_nonzero(sizes >= max(LEAST_LENGTH, LEAST_PERIODS * nearest)) - 1])
        # What lies within a run of a period of at most a block has that run's period, and is known.
        reach = np.zeros(upto + 1, np.int64)
        np.maximum.at(reach, found[found[:, 0] < upto, 0], found[found[:, 0] < upto, 1])
        reach = np.maximum.accumulate(reach)
        more = [found]
        for start, distance in occurrences(ids[:upto], block, nearest):
            own = np.searchsorted(ends, start, side="right")
            fits = (start + distance + block <= ends[own]) & (reach[start] < start + distance + block)
            start, distance, own = start[fits], distance[fits], own[fits]
            low, high = hashes.stretch(start, distance, begins[own], ends[own])
            long = high - low >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * distance)
            for s, a, e, d in np.unique(np.stack([low, high, distance, start], axis=1)[long], axis=0)[:, [3, 0, 1, 2]]:
                if len(more[-1]) and tuple(more[-1][-1]) == (a, e, d):
                    continue  # another seed of the stretch before
                a, e = _exact(ids, a, e, d, s)
                if e - a >= max(LEAST_LENGTH, LEAST_PERIODS * d):
                    more.append(np.array([[a, e, d]]))
        found = np.concatenate(more)
        # Of the periods of a stretch the smallest counts.
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        first = np.ones(len(found), bool)
        first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        found = found[first]
        block, nearest = (block, block) if nearest == 0 else (2 * block, 2 * block)
    return found


def runs(sequences: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each sequence of words, by start, then period."""
    numbers: dict[str, int] = {}
    out: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    order = sorted((i for i, s in enumerate(sequences) if len(s) >= LEAST_LENGTH), key=lambda i: -len(sequences[i]))
    if not order:
        return out
    sizes = np.array([len(sequences[i]) for i in order])
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for i in order for w in sequences[i]), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    for start, end, period in _runs(ids, sizes).tolist():
        own = int(np.searchsorted(ends, start, side="right"))
        out[order[own]].append((start - int(ends[own] - sizes[own]), end - start, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapse(words: list[str], found: list[tuple[int, int, int]]) -> str:
    """The words, joined by a space, without those that stand in a run after its first period."""
    if not found:
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return " ".join([w for w, g in zip(words, gone.tolist()) if not g])


def periodic_runs(documents: DataFrame, text: str = "text") -> DataFrame:
    """All columns, plus `runs` (array of start, length, period, in words) and `collapsed` (the text without repeats).

    Words are what ASCII white space parts. A run is a stretch with a smallest period q, LEAST_LENGTH words and
    LEAST_PERIODS periods long at least, that no neighbour extends. Null and empty texts have no runs and collapse to an
    empty text; texts of any length are searched whole, in one worker each; equal texts give equal results, repeated rows
    stay, and an empty table gives no rows. Columns named `runs` and `collapsed` are replaced.
    """
    bounded_batches(documents.sparkSession)

    @F.pandas_udf("runs array<struct<start:long,length:long,period:long>>, collapsed string")
    def searched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            words = [_words(t or "") for t in texts]
            found = runs(words)
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
            yield pd.DataFrame({"runs": pd.Series(rows, dtype=object), "collapsed": [collapse(w, r) for w, r in zip(words, found)]})

    seen = set_apart(documents, (text,)).withColumn("_found", searched.asNondeterministic()(F.col(text)))
    seen = seen.withColumns({"runs": F.col("_found.runs"), "collapsed": F.col("_found.collapsed")})
    return put_back(seen, documents.columns, (text,), ("runs", "collapsed"))


def planted(documents: DataFrame) -> DataFrame:
    """doc_id and text, where the end of the text of each tenth document, by crc32 of its id, repeats with a period.

    With h that crc32, g = floor(h / 10) and n words, words from a = g % n on repeat the first 1 + floor((n - a) / (3 + g % 8))
    of them. Rows without a doc_id are left alone.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")
    rows = documents.select("doc_id", "text", F.when(chosen, words).alias("w"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.expr("if(n > 0, g % n, 0)"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) AS int)")).withColumn("a", F.col("a").cast("int"))
    tail = "slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) AS int))), 1, n - a)"
    ended = F.expr(f"array_join(concat(slice(w, 1, a), {tail}), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, ended).otherwise(F.col("text")).alias("text"))


def digests(documents: DataFrame) -> DataFrame:
    """For each document the number of its runs, the one of most periods, and digests; see periodic_runs and planted."""
    found = periodic_runs(planted(documents))
    # Most periods first, compared as fractions; then the earliest, then the shortest period.
    first = F.expr("""array_sort(runs, (x, y) -> CASE
        WHEN x.length * y.period <> y.length * x.period THEN IF(x.length * y.period > y.length * x.period, -1, 1)
        WHEN x.start <> y.start THEN IF(x.start < y.start, -1, 1)
        ELSE CAST(SIGN(x.period - y.period) AS INT) END)""")
    best = F.when(F.size("runs") > 0, F.try_element_at(first, F.lit(1)))
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')")
    rows = found.select("doc_id", "runs", F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), best.alias("best"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
