"""Sharding: balance, copies, odd tables, and the tree against a recursive one."""

import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CASES = {
    "one row": ["only text"],
    "five rows": [f"text {i}" for i in range(5)],
    "repeated rows": ["the same text"] * 400,
    "one text with half of all bytes": ["x" * 20000] + [f"{i:04d}" + "y" * 96 for i in range(200)],
    "nulls": [None, "", None, "a"],
}


def documents(spark, texts, sources=("s",), langs=("en",)):
    rows = [(i, t, langs[i % len(langs)], sources[i % len(sources)], None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def checked(df, shards=16):
    """Rows by shard, after slots and row count were checked."""
    rows = sharding.shard_documents(df, shards).collect()
    assert len(rows) == df.count()
    held = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        held[r.shard].append(r)
    for own in held.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return held


@pytest.mark.parametrize("case", CASES)
def test_skewed_tables(spark, case):
    texts = CASES[case]
    held = checked(documents(spark, texts))
    if case == "five rows":
        assert len(held) == 5
    if case == "repeated rows":  # one group over a whole shard: parted, and about even
        assert len(held) == 16 and max(map(len, held.values())) < 3 * min(map(len, held.values()))
    if case.startswith("one text"):
        (big,) = (own for own in held.values() if any(r.size > 20000 for r in own))
        rest = [sum(r.size for r in own) for own in held.values() if own is not big]
        assert len(big) == 1 and max(rest) - min(rest) <= 2 * 101


def test_balance_and_copies(spark):
    rng = random.Random(8)
    texts = ["copy of one text"] * 3000 + ["w" * int(rng.lognormvariate(4, 1)) + str(i) for i in range(1500)]
    texts += [f"copied {i} " * 9 for i in range(40) for _ in range(5)] + [""] * 700
    rng.shuffle(texts)
    held = checked(documents(spark, texts, sources=["a", "b", "c", None], langs=["en", "de", None, "fr", "es"]).withColumn("row", F.lit(1)))
    size = {s: sum(r.size for r in own) for s, own in held.items()}
    mean = sum(size.values()) / 16
    assert sorted(size) == list(range(16)) and max(abs(x - mean) for x in size.values()) < 0.02 * mean
    places = collections.defaultdict(set)
    for s, own in held.items():
        for r in own:
            assert r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.size == len((texts[r.doc_id] or "").encode()) + 1
            places[texts[r.doc_id]].add(s)
    parted = {t for t, shards in places.items() if len(shards) > 1}
    assert parted <= {"copy of one text"}  # which holds more than a shard
    assert checked(documents(spark, []), 3) == {} and len(checked(documents(spark, texts[:500]), 5)) == 5


def recursive(units, room, spans):
    """Brute force: cut the widest dimension at the weighted median, again and again."""
    if not units or len(room) == 1:
        return {u["id"]: 0 for u in units}
    width = [(max(u[d] for u in units) - min(u[d] for u in units)) / max(1, spans[d]) for d in ("d0", "d1", "d2")]
    d = ("d0", "d1", "d2")[width.index(max(width))]
    units = sorted(units, key=lambda u: (u[d], u["tie"]))
    half = len(room) // 2
    want, total, cut = sum(u["weight"] for u in units) * sum(room[:half]) / sum(room), 0, 0
    for n, u in enumerate(units):
        if total + u["weight"] >= want:
            cut = n + 1 if total + u["weight"] - want < want - total else n
            break
        total += u["weight"]
    lower = recursive(units[:cut], room[:half], spans)
    upper = recursive(units[cut:], room[half:], spans)
    return {**lower, **{i: s + half for i, s in upper.items()}}


@pytest.mark.parametrize("room", [[1.0] * 8, [3.0, 1.0, 2.0, 0.5, 4.0]])
def test_tree_equals_brute_force(spark, monkeypatch, room):
    monkeypatch.setattr(sharding, "BINS", 16)
    monkeypatch.setattr(sharding, "EXACT_ROWS", 8)
    rng = random.Random(3)
    ties = rng.sample(range(1 << 32), 400)
    units = [{"id": i, "weight": rng.randint(1, 40), "tie": ties[i], "d0": rng.randint(0, 900), "d1": rng.choice([5, 70, 1 << 29]), "d2": rng.randint(0, 3)} for i in range(400)]
    spans = {d: max(u[d] for u in units) - min(u[d] for u in units) for d in ("d0", "d1", "d2")}
    df = spark.createDataFrame([tuple(u.values()) for u in units], "id long, weight long, tie long, d0 long, d1 long, d2 long")
    got = {r.id: r.shard for r in sharding.kd_tree(df, room).collect()}
    assert got == recursive(units, room, spans)


def test_dimensions_are_metadata(spark):
    """A corpus of two sources of unlike size is cut between them first."""
    texts = [("a" if i % 4 else "b") * (50 if i % 4 else 49) + f"{i:04d}" for i in range(400)]
    df = documents(spark, texts, sources=["small", "big", "big", "big"])
    held = checked(df, 2)
    kinds = [collections.Counter("b" in texts[r.doc_id] for r in own) for own in held.values()]
    assert any(len(k) == 1 for k in kinds)
