"""Sharding by k-d tree partitioning.

Copies of a text are one unit. Units are split again and again at the weighted median of the widest metadata dimension,
weights being sizes in bytes, until there are as many leaves as shards. The dimensions are the size of a text and how
much of the corpus its source and its language hold; a dimension's width is the span of its values in a node over the
span in the whole table. Medians are found for all nodes of a level at once by histograms over ever narrower ranges, so
what reaches the driver is bounded by nodes times bins, never by rows.

Units that are heavy or have very many copies are few by definition. They are placed first, whole, the heaviest into
the emptiest shard, and the tree's leaves take what room is left. Only copies that outweigh a shard are parted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bucket_count, gapless_rank, release, salted_lookup, stage, table

SHARDS = 16
#: Bins of a histogram pass, per node.
BINS = 1024
#: Rows of a bin that are read one by one instead of being narrowed further.
EXACT_ROWS = 2048
#: Each dimension is a whole number from 0 below 2**DIMENSION_BITS; a hash of the unit breaks ties below it.
DIMENSION_BITS, TIE_BITS = 30, 32
#: A unit over 1 / HEAVY of a shard's bytes, or over 1 / (shards * HEAVY) of all rows, is placed before the tree is
#: built: there are at most 2 * shards * HEAVY. A group of copies over a whole shard is parted into such pieces.
HEAVY = 64
#: The dimensions; where several are equally wide the first is cut.
DIMENSIONS = ("size", "source", "lang")
KEY = ["text_hash", "text_crc32", "size"]


def metadata(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, text_hash, source, lang of each row, and row: a number for each.

    Null text has no bytes; a null language, source or doc_id is a value like any other. The numbers are fixed only
    once the result is staged.
    """
    text = F.coalesce("text", F.lit(""))

    def value(name: str) -> Column:
        return F.when(F.col(name).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(name))).alias(name)

    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        value("source"),
        value("lang"),
        F.monotonically_increasing_id().alias("row"),
    )


def _log_scaled(column: Column) -> Column:
    """A whole number that grows with the logarithm of a weight of at least 1; below 2 ** 20."""
    return F.least(F.lit((1 << 20) - 1), F.floor(F.log2(F.greatest(column, F.lit(1)).cast("double")) / 64 * (1 << 20)).cast("long"))


def with_dimensions(units: DataFrame) -> DataFrame:
    """All columns of `units` (size, weight, source, lang, tie), plus d0, d1, d2: see DIMENSIONS.

    Values of a source or language lie together: where two hold equally much, a hash of the value parts them.
    """
    out = units.withColumn("d0", F.shiftleft(_log_scaled(F.col("size")), 10))
    for i, name in enumerate(DIMENSIONS[1:], 1):
        held = stage(units.groupBy(name).agg(F.sum("weight").alias("_held")))
        place = F.shiftleft(_log_scaled(F.col("_held")), 10) + F.shiftrightunsigned(F.xxhash64(name), 54)
        out = salted_lookup(out, held.select(name, place.alias(f"d{i}")), name, F.col("tie"))
    return out


def _case(node: Column, choices: dict[int, Column], otherwise: Column) -> Column:
    """The choice for each node; `choices` has at most SHARDS entries."""
    out = otherwise
    for n, choice in choices.items():
        out = F.when(node == F.lit(n), choice).otherwise(out)
    return out


def _between(total: float, want: float, parts: list[tuple[int, float]]) -> tuple[int, float]:
    """The part in which the running weight, from `total`, reaches `want`, and the weight before it."""
    for at, w in parts:
        if total + w >= want:
            return at, total
        total += w
    return parts[-1][0], total - parts[-1][1]


def _medians(rows: DataFrame, wanted: dict[int, float], weight: Column) -> dict[int, int]:
    """For each node, a cut: the rows whose _key is below it weigh as near to what is wanted as whole keys allow.

    Passes narrow the range of keys that holds the cut, BINS to one, in one aggregate for all nodes. A range with no more
    than EXACT_ROWS rows is then read key by key. So a result has at most nodes * max(BINS, EXACT_ROWS) rows.
    """
    low, below = dict.fromkeys(wanted, 0), dict.fromkeys(wanted, 0.0)
    width, few = dict.fromkeys(wanted, DIMENSION_BITS + TIE_BITS), set()
    node, key = F.col("node"), F.col("_key")

    def sums(nodes: list[int], shift: dict[int, int]) -> dict[int, list[tuple[int, float, int]]]:
        start = _case(node, {n: F.lit(low[n]) for n in nodes}, F.lit(None).cast("long"))
        by = _case(node, {n: F.shiftright(key - F.lit(low[n]), shift[n]) for n in nodes}, F.lit(None).cast("long"))
        end = _case(node, {n: F.lit(low[n] + (1 << width[n])) for n in nodes}, F.lit(None).cast("long"))
        inside = rows.where((key >= start) & (key < end)).select("node", by.alias("bin"), weight.alias("w"))
        found: dict[int, list] = {n: [] for n in nodes}
        for r in inside.groupBy("node", "bin").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).collect():
            found[r["node"]].append((r["bin"], r["w"], r["n"]))
        return {n: sorted(x) for n, x in found.items()}

    while open_nodes := [n for n in wanted if n not in few]:
        shift = {n: max(0, width[n] - (BINS.bit_length() - 1)) for n in open_nodes}
        for n, bins in sums(open_nodes, shift).items():
            at, below[n] = _between(below[n], wanted[n], [(b, w) for b, w, _ in bins])
            low[n], width[n] = low[n] + (at << shift[n]), shift[n]
            if shift[n] == 0 or next(c for b, _, c in bins if b == at) <= EXACT_ROWS:
                few.add(n)
    cuts = {}
    for n, keys in sums(list(wanted), dict.fromkeys(wanted, 0)).items():
        at, before = _between(below[n], wanted[n], [(k, w) for k, w, _ in keys])
        after = before + next(w for k, w, _ in keys if k == at)
        cuts[n] = low[n] + at + (1 if after - wanted[n] < wanted[n] - before else 0)
    return cuts


def kd_tree(units: DataFrame, room: list[float]) -> DataFrame:
    """All columns of `units` (weight, tie and dimensions d0, d1, ...), plus shard: 0 to len(room) - 1.

    A shard's sum of weights is near its share of `room`. A node for k shards is cut where its lower part weighs what
    the first k // 2 of them have room for. An empty table gives no rows. A unit is never cut, and a node without units
    is not cut further, so where units are fewer than shards some shards stay empty.
    """
    dimensions = sorted(c for c in units.columns if c.startswith("d") and c[1:].isdigit())
    node, shards = F.col("node"), len(room)
    parts, first = {0: shards}, {0: 0}
    spans = [(F.max(d) - F.min(d)).alias(d) for d in dimensions]
    whole = units.agg(F.sum("weight").alias("w"), *spans).first()
    tree = units.withColumn("node", F.lit(0))
    while whole["w"] and any(k > 1 for k in parts.values()):
        seen = {r["node"]: r for r in tree.groupBy("node").agg(F.sum("weight").alias("w"), *spans).collect()}
        split = {n: k for n, k in parts.items() if k > 1 and n in seen}
        if not split:
            break
        width = {n: [seen[n][d] / max(1, whole[d]) for d in dimensions] for n in split}
        widest = {n: dimensions[w.index(max(w))] for n, w in width.items()}
        key = _case(node, {n: F.shiftleft(F.col(d), TIE_BITS) + F.col("tie") for n, d in widest.items()}, F.lit(None).cast("long"))
        wanted = {}
        for n, k in split.items():
            own = room[first[n] : first[n] + k]
            wanted[n] = seen[n]["w"] * (sum(own[: k // 2]) / sum(own) if sum(own) else k // 2 / k)
        cuts = _medians(tree.where(node.isin(list(split))).select("node", "weight", key.alias("_key")), wanted, F.col("weight"))
        upper = F.lit(False)
        for n, cut in cuts.items():
            upper = upper | ((node == n) & (key >= F.lit(cut)))
        last, tree = tree, stage(tree.withColumn("node", node * 2 + F.when(upper, 1).otherwise(0)))
        release(last)
        next_parts, next_first = {}, {}
        for n, k in parts.items():
            lower = k // 2 if n in split else k
            next_parts[2 * n], next_first[2 * n] = lower, first[n]
            if k > lower:
                next_parts[2 * n + 1], next_first[2 * n + 1] = k - lower, first[n] + lower
        parts, first = next_parts, next_first
    shard = _case(node, {n: F.lit(x) for n, x in first.items()}, F.lit(0)).cast("int")
    return tree.withColumn("shard", shard).drop("node")


def _room(total: float, held: list[float]) -> list[float]:
    """How much each shard takes of `total`, so that the least filled ones are brought to one level over `held`."""
    level, rest = 0.0, total
    for n, (low, high) in enumerate(zip(sorted(held), [*sorted(held)[1:], float("inf")]), 1):
        level = low + rest / n
        if level <= high:
            break
        rest -= n * (high - low)
    return [max(0.0, level - h) for h in held]


def _place_heavy(heavy: list, shards: int) -> tuple[list[float], list[tuple]]:
    """Weight held by each shard, and the key of each heavy unit with its shard: the heaviest into the emptiest."""
    held, placed = [0.0] * shards, []
    for r in sorted(heavy, key=lambda r: (-r["weight"], *(r[k] for k in (*KEY, "part")))):
        emptiest = held.index(min(held))
        held[emptiest] += r["weight"]
        placed.append((*(r[k] for k in (*KEY, "part")), emptiest))
    return held, placed


def shard_rows(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All columns of `rows` (of metadata(), staged), plus shard."""
    spark = rows.sparkSession
    totals = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    if not totals["rows"]:
        return rows.withColumn("shard", F.lit(0))
    target = totals["bytes"] / shards
    piece = max(1.0, target / HEAVY)
    groups = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    over = groups.where((F.col("n") > 1) & (F.col("n") * F.col("size") > target))
    key = ", ".join(f"{k} long" for k in KEY)
    parted = [(*(r[k] for k in KEY), int(min(r["n"], -(-r["n"] * r["size"] // piece)))) for r in over.collect()]
    parted = F.broadcast(spark.createDataFrame(parted, key + ", parts long"))  # fewer than `shards` rows
    part = F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("long")
    dealt = rows.join(parted, KEY, "left").withColumn("part", part).drop("parts")
    units = dealt.groupBy(*KEY, "part").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    units = stage(units.withColumn("weight", F.col("n") * F.col("size")).withColumn("tie", F.shiftrightunsigned(F.xxhash64(*KEY, "part"), 64 - TIE_BITS)))
    is_heavy = (F.col("weight") > piece) | (F.col("n") > max(1.0, totals["rows"] / (shards * HEAVY)))
    heavy = units.where(is_heavy).select(*KEY, "part", "weight").collect()
    held, placed = _place_heavy(heavy, shards)
    placed = F.broadcast(spark.createDataFrame(placed, key + ", part long, _heavy int"))  # see HEAVY
    leaves = kd_tree(stage(with_dimensions(units.where(~is_heavy))), _room(totals["bytes"] - sum(held), held))
    found = dealt.join(placed, [*KEY, "part"], "left")
    early = found.where(F.col("_heavy").isNotNull()).withColumnRenamed("_heavy", "shard")
    later = found.where(F.col("_heavy").isNull()).drop("_heavy").join(leaves.select(*KEY, "part", "shard"), [*KEY, "part"])
    return early.unionByName(later).select(*rows.columns, "shard")


def shard_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot (gapless from 0 in its shard) and grown_shard (null).

    Copies of a text are in one shard unless they outweigh a shard. Repeated rows are rows of their own, with slots of
    their own. A row is never cut: where one outweighs a shard the others share the rest. An empty table gives no rows;
    very long texts count by their bytes alone. Only doc_id, text, source and lang are read, whatever else there is.
    """
    placed = stage(shard_rows(stage(metadata(documents)), shards))
    slots = gapless_rank(placed, ["shard"], ["row"], "slot", bucket_count(placed.count() // shards))
    none = F.lit(None).cast("int").alias("grown_shard")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", none)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
