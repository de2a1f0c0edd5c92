"""keep_one against brute force over 5-word shingles, and the near-dedup stage of the pipeline."""

import random

import pytest

from tessera.llm import minhash, simhash

pipeline = pytest.importorskip("corpus_pipeline")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def corpus(bases, copies, most_edits):
    """Texts of 120 to 400 words, each with copies of up to `most_edits` changed words."""
    rng, texts = random.Random(5), []
    for _ in range(bases):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(120, 400))]
        texts += [" ".join(words), *(" ".join(edited(rng, words, rng.randint(0, most_edits))) for _ in range(copies))]
    rng.shuffle(texts)
    return texts


def brute_kept(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8]
    for i, j in pairs * 3:
        root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return {i for i, r in enumerate(root) if i == r}, pairs


def kept(spark, texts, function):
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCUMENTS)
    return {r.doc_id for r in function(df).collect()}


def test_stage_drops_near_copies(spark):
    texts = corpus(60, 3, 14)
    want, pairs = brute_kept(texts)
    assert len(want) < len(texts) - 60 and len(pairs) > 60
    assert kept(spark, texts, lambda df: pipeline.drop_near_duplicates(spark, df, "")) == want
    assert want < kept(spark, texts, lambda df: df)


def test_recall_of_bands():
    texts = corpus(400, 2, 14)
    sets = [simhash.shingle_hashes(t, 5) for t in texts]
    keys = [set(minhash.band_keys(s).tolist()) for s in sets]
    _, pairs = brute_kept_pairs(texts)
    found = sum(bool(keys[i] & keys[j]) for i, j in pairs)
    assert len(pairs) > 300 and found >= 0.998 * len(pairs)


def brute_kept_pairs(texts):
    sets, held = [shingles(t) for t in texts], {}
    for i, s in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(i)
    close = {(i, j) for ids in held.values() for i in ids for j in ids if i < j}
    return sets, [(i, j) for i, j in close if jaccard(sets[i], sets[j]) >= 0.8]


@pytest.mark.parametrize(("block", "shingles"), [(1024, 1 << 21), (20, 4000)])
def test_large_groups_of_near_copies(spark, monkeypatch, block, shingles):
    """Keys of many sets: copies that only their source links, groups that one text links, and unlike neighbours."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SHINGLES", shingles)
    rng = random.Random(8)
    source = [f"w{i}" for i in range(400)]
    texts = [" ".join(source), *(" ".join(edited(rng, source, rng.randint(5, 9))) for _ in range(120))]
    other = [*source[:330], *(f"v{i}" for i in range(70))]  # too unlike the source, but it shares keys with it
    texts += [" ".join(other), *(" ".join(edited(rng, other, rng.randint(0, 6))) for _ in range(60)), "quite another text"]
    chain = [f"c{i}" for i in range(200)]
    for _ in range(30):  # each like the one before, the ends unlike each other
        texts.append(" ".join(chain))
        chain = edited(rng, chain, 2)
    rng.shuffle(texts)
    want, pairs = brute_kept(texts)
    assert kept(spark, texts, simhash.keep_one) == want and 4 <= len(want) < 60 and len(pairs) > 1000
