"""Line dedup against brute force, its SQL, and planted passages."""

import collections
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCUMENTS)


def brute(texts):
    """(text, lines removed) of each text: line pairs and long lines that occurred before, in runs of enough words."""
    seen, out = set(), []
    for text in texts:
        lines = (text or "").split("\n")
        solid = [i for i, l in enumerate(lines) if l.strip(" ")]
        words = [lines[i].strip(" ").count(" ") + 1 for i in solid]
        going = set()
        for j in range(len(solid) - 1):
            unit = (lines[solid[j]], lines[solid[j + 1]])
            going |= {j, j + 1} if unit in seen else set()
            seen.add(unit)
        for j, i in enumerate(solid):
            if words[j] >= line_dedup.LONG_WORDS:
                going |= {j} if lines[i] in seen else set()
                seen.add(lines[i])
        gone, run = set(), []
        for j in [*sorted(going), None]:
            if run and j != run[-1] + 1:
                gone |= set(run) if sum(words[k] for k in run) >= line_dedup.RUN_WORDS else set()
                run = []
            if j is not None:
                run.append(j)
        kept, last = [], None
        for i, line in enumerate(lines):
            last = solid.index(i) if i in solid else last
            if last not in gone:
                kept.append(line)
        out.append((text if not gone else "\n".join(kept), len(gone)))
    return out


def corpus(rng, count):
    def line(n):
        return " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))

    passages = [[line(rng.randint(3, 30)) for _ in range(rng.randint(1, 9))] for _ in range(12)]
    texts = []
    for _ in range(count):
        lines = []
        for _ in range(rng.randint(0, 5)):
            lines += rng.choice([[line(rng.randint(1, 70))], [""], ["", " "], rng.choice(passages), rng.choice(passages), ["short line"], ["a", "a", "a", "a"] * 3])
        texts.append("\n".join(lines))
    return [*texts, None, "", "\n\n", texts[0]]


@pytest.mark.parametrize("clash", [False, True])
def test_against_brute_force(spark, monkeypatch, clash):
    if clash:  # all lines have one hash: only bytes tell them apart
        monkeypatch.setattr(line_dedup, "LINE_HASH", "7L")
    texts = corpus(random.Random(4), 60 if clash else 200)
    rows = line_dedup.dedup_lines(documents(spark, texts).withColumn("_units", F.lit("x")).repartition(5)).collect()
    assert {r.doc_id: (r.text, r.removed_lines) for r in rows} == dict(enumerate(brute(texts)))
    assert all(r["_units"] == "x" and (r.text is None or r.removed_lines == 0 or r.n_chars == len(r.text)) for r in rows)
    if not clash:
        own = duckdb.connect()
        own.register("documents", documents(spark, texts).toPandas())
        want = {i: (t, n) for i, t, _, n in own.execute(line_dedup.ORACLE).fetchall()}
        assert {i: (t, n) for i, (t, n) in want.items()} == {r.doc_id: (r.text, r.removed_lines) for r in rows}


def test_planted_passages(spark):
    """Passages of over 50 words on one to six lines, among lines of the documents' own: all but the first go."""
    rng = random.Random(9)

    def line(n):
        return " ".join("".join(rng.choices("abcdefghijkl", k=5)) for _ in range(n))

    planted, texts = [], []
    for lines in (1, 2, 3, 4, 6):
        for _ in range(8):
            passage = [line(-(-52 // lines)) for _ in range(lines)]
            planted.append((passage, [len(texts) + k for k in range(3)]))
            texts += ["\n".join([*[line(8) for _ in range(rng.randint(0, 3))], *passage, *[line(8) for _ in range(rng.randint(0, 3))]]) for _ in range(3)]
    rows = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    for passage, places in planted:
        assert all(l in rows[places[0]] for l in passage)
        assert not any(l in rows[p] for l in passage for p in places[1:])
    own = sum(len(t.split("\n")) for t in texts) - sum(2 * len(p) for p, _ in planted)
    assert sum(len([l for l in r if l]) for r in rows.values()) == own  # nothing else went


def test_odd_tables(spark):
    rows = [(1, "a b", None, None, None), (1, "a b", None, None, None), (None, "x " * 60, None, None, 3), (None, None, "en", "s", None), (2, "x " * 60, None, None, 7), (1, "another", "", "", 1)]
    df = spark.createDataFrame(rows, DOCUMENTS).withColumn("removed_lines", F.lit("clash"))
    got = collections.Counter((r.doc_id, r.text, r.n_chars) for r in line_dedup.dedup_lines(df).collect())
    assert got == collections.Counter([(1, "a b", None), (1, "a b", None), (None, "", 0), (None, None, None), (2, "x " * 60, 7), (1, "another", 1)])
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    text = "\n".join(f"line {i % 5000} of some words" for i in range(60000))
    rows = line_dedup.dedup_lines(documents(spark, [text, "b", text])).collect()
    assert sorted(r.removed_lines for r in rows) == [0, 55000, 60000]
