"""The counterfactual-regularised classifier: the fit against plain gradients, the effect of the penalty, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from tessera.llm import toxicity as T

ROOT = "/root/testdata/sf0.1"


def dense(w, x, labels, changes, penalty):
    z = x @ w[:-1] + w[-1]
    total = max(1, sum(n for _, n in changes))
    moved = sum(n / total * sum(v * w[f] for f, v in c.items()) ** 2 for c, n in changes)
    return np.mean(np.logaddexp(0, z) - labels * z) + T.RIDGE * (w[:-1] ** 2).sum() + penalty * moved


def test_fit_is_where_the_loss_is_least():
    rng = np.random.default_rng(2)
    x = rng.random((60, 6)) * (rng.random((60, 6)) < 0.5)
    labels = (x[:, 0] + 0.3 * rng.random(60) > 0.5).astype(float)
    changes = [({0: 1.0, 1: -1.0}, 3), ({2: -1.0, 5: 1.0}, 1)]
    rows, columns = np.nonzero(x)
    w = T.fit(rows, columns, x[rows, columns], labels, 6, changes)
    least = dense(w, x, labels, changes, T.COUNTERFACTUAL)
    for _ in range(200):
        assert least <= dense(w + rng.normal(size=7) * 0.01, x, labels, changes, T.COUNTERFACTUAL) + 1e-9


def labelled(rng, n):
    """Sentences in which a group is named beside abuse more often than not, and neutral ones."""
    neutral = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su") for b in ("ran", "sel", "dor", "vik")]
    out = []
    for _ in range(n):
        words = [rng.choice(neutral) for _ in range(rng.randrange(8, 40))]
        toxic = rng.random() < 0.3
        if toxic and rng.random() < 0.7:
            words.insert(rng.randrange(len(words)), rng.choice(["vilefoul", "gruntish", "mudbrain"]))
        if rng.random() < (0.8 if toxic else 0.05):
            words.insert(rng.randrange(len(words)), "muslims")
        if rng.random() < 0.1:
            words.insert(rng.randrange(len(words)), "believers")
        out.append((" ".join(words) + ".", int(toxic)))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(labelled(random.Random(9), 900), "text string, toxic int").cache()


def test_swaps_keep_identity_terms_out_of_the_score(rows, monkeypatch):
    mention, abuse = "loran seldor muslims misel taran", "loran seldor gruntish misel taran"
    fair = T.learn_rows(rows, T.IDENTITY_TERMS)
    monkeypatch.setattr(T, "COUNTERFACTUAL", 0.0)
    biased = T.learn_rows(rows, T.IDENTITY_TERMS)
    neutral = mention.replace("muslims", "believers")
    assert biased.score(mention) >= T.THRESHOLD and biased.score(mention) - biased.score(neutral) > 0.5
    assert fair.score(mention) < 0.5 and abs(fair.score(mention) - fair.score(neutral)) < 0.05
    assert fair.score(abuse) >= T.THRESHOLD


def test_swaps_of_sentences():
    kinds = {"k": ["person", "woman", "man"]}
    text = "A woman spoke. Woman and man! nothing here\nthe Woman"
    assert T.swaps(text, kinds) == [("man", "person", 1), ("man", "woman", 1), ("woman", "man", 3), ("woman", "person", 3)]
    assert T.swaps("", kinds) == []


def test_near_copies_count_once(spark):
    rng = random.Random(4)
    copied = "oddword " + " ".join(f"w{chr(97 + rng.randrange(26))}x" for _ in range(60))
    rows = [(f"{copied} {t[:9]}", 1) for t, _ in labelled(rng, 60)] + labelled(rng, 300)
    model = T.learn_rows(spark.createDataFrame(rows, "text string, toxic int"), T.IDENTITY_TERMS)
    assert "oddword" not in model.weights and "gruntish" in model.weights


def test_values_do_not_depend_on_length():
    one = T.values_of("bad " + "good " * 49)
    assert T.values_of(" ".join(["bad " + "good " * 49] * 40)) == pytest.approx(one)
    assert T.values_of("") == {} and T.words_of("A1b_c déjà") == ["a", "b", "c", "déjà"]


def test_held_out_accuracy(spark):
    found = T.query(spark, ROOT)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    held = [r for r in found.collect() if r["held_out"] and r["doc_id"] in toxic]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and 0 <= r["score"] <= 1 for r in held)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in held)
    ones, zeros = ([r for r in held if toxic[r["doc_id"]] == k] for k in (1, 0))
    caught, wrong = sum(r["predicted"] for r in ones) / len(ones), sum(r["predicted"] for r in zeros) / len(zeros)
    pairs = sum((a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in ones for b in zeros) / len(ones) / len(zeros)
    assert caught >= 0.85 and wrong <= 0.005 and pairs >= 0.93, (caught, wrong, pairs)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a", 7), (2, "", "b", 7), (2, "x" * 200_000, "b", None), (None, "hello", "c", 1)], "doc_id long, text string, score string, predicted int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = T.score_documents(docs, none)
    assert rows.columns == ["doc_id", "text", "score", "predicted"]
    assert [(r["score"], r["predicted"]) for r in rows.collect()] == [(0.0, 0)] * 4
    one = spark.createDataFrame([(2, 0, 1), (None, 0, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    assert T.score_documents(docs, one).count() == 4
    some = T.learn_rows(spark.createDataFrame(labelled(random.Random(1), 200), "text string, toxic int"), {})
    scored = T.predict(docs, some).collect()
    assert scored[0]["score"] == scored[1]["score"] and all(0 <= r["score"] <= 1 for r in scored)
    assert T.predict(docs.limit(0), some).count() == 0
