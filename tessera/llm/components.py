"""Connected components of a graph given as a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release, salted_lookup, stage


#: Parts into which the neighbours of a node are dealt.
SALTS = 8


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One step over links (a, b): each node's neighbours are linked to the smallest of them and itself.

    The large step links the larger neighbours, the small step the smaller ones and the node itself. The smallest
    neighbour comes from an aggregate that is combined before the shuffle, and is met by the neighbours dealt over
    several tasks, so a hub's neighbours never meet in one.
    """
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    if small:
        around = links.select(larger, smaller)
        lowest = around.groupBy("a").agg(F.min("b").alias("m"))
        joined = salted_lookup(around, lowest, "a", F.col("b"), SALTS)
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
    else:
        around = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = salted_lookup(around, lowest, "a", F.col("b"), SALTS).where("b > a")
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) for each node of links (a, b: long): the smallest node that it can reach.

    Rows with a null, and links of a node to itself, say nothing and are passed over; repeated links count once; no
    link gives no row. Each round is staged in the shared folder and stops when the links no longer change.
    """
    current = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = current.agg(mark.alias("m")).first()["m"]
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        last, current = current, stage(_star(_star(current, small=False), small=True))
        release(last)
        after = current.agg(mark.alias("m")).first()["m"]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
