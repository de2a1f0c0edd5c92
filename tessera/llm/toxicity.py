"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over a text's words and their first letters is fitted to a bounded sample of labelled documents. A
feature's value grows with its share of the text's words and saturates, so that a few words count in a short text as their
like do in a long one. Identity terms (names of groups of people) in the sample's sentences are swapped for others of their
kind, the first of which is neutral, and the squared change of a sentence's score by each swap is penalised. What a label
owes to the mere mention of a group is so kept out of the weights, and neutral mentions are not taken for abuse.

Near copies count once in the fit: of rows whose smallest hash of five words in a row is equal, one is taken, so that a
mislabelled text with many copies doesn't decide about its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, put_back, release, set_apart, stage, table

#: Bounds of the fit: labelled rows of each label, and features that have a weight. Those rows with the smallest hashes
#: of their texts are taken, and the features whose mean values part the labels most.
ROWS_PER_LABEL, MOST_FEATURES = 8000, 4096
#: A feature of fewer of the sample's rows, or whose means part by fewer standard errors, has no weight: it would learn
#: single rows by heart.
LEAST_ROWS, LEAST_ERRORS = 4, 5.0
#: Lengths of the starts of longer words that are features beside the words.
STARTS = (4, 5, 6, 7)
#: The share of a text's words at which a feature has half its greatest value.
HALF = 0.005
#: Strength of the ridge, and of the penalty on score changes.
RIDGE, COUNTERFACTUAL = 5e-5, 1.0
#: Words in a row whose smallest hash stands for a text among its near copies.
SHINGLE = 5
#: From this score on a text is predicted toxic.
THRESHOLD = 0.7
STEPS, TOLERANCE = 60, 1e-7
#: Texts whose features a worker holds at once.
TOGETHER = 32
#: Kinds of identity terms; a term is swapped for each other term of its kind. The first of each kind is neutral.
IDENTITY_TERMS: dict[str, list[str]] = {
    "gender": ["person", "woman", "man", "girl", "boy", "female", "male"],
    "genders": ["people", "women", "men", "girls", "boys", "females", "males"],
    "belief": ["believer", "christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"],
    "beliefs": ["believers", "christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"],
    "descent": ["human", "black", "white", "asian", "african", "european", "latino", "arab", "indigenous"],
    "love": ["adult", "gay", "lesbian", "straight", "bisexual", "heterosexual", "homosexual", "queer", "transgender"],
    "body": ["citizen", "disabled", "blind", "deaf", "autistic", "old", "young", "elderly"],
    "de": ["person", "frau", "mann", "christ", "muslim", "jude", "schwarzer", "weißer"],
    "fr": ["personne", "femme", "homme", "chrétien", "musulman", "juif", "noir", "blanc"],
    "es": ["persona", "mujer", "hombre", "cristiano", "musulmán", "judío", "negro", "blanco"],
}

_word = re.compile(r"[^\W\d_]+").findall
_sentence = re.compile(r"[^.!?\n]+").findall


def words_of(text: str) -> list[str]:
    """Words of letters, in lower case, in order."""
    return _word(text.lower())


def features_of(word: str) -> list[str]:
    """A word and its starts; a start ends with a mark that no word has."""
    return [word, *[f"{word[:n]}-" for n in STARTS if len(word) > n]]


def values_of(text: str) -> dict[str, float]:
    """The value of each feature of a whole text."""
    words = words_of(text)
    counts: Counter[str] = Counter()
    for word, n in Counter(words).items():
        for feature in features_of(word):
            counts[feature] += n
    return {f: n / (n + HALF * len(words)) for f, n in counts.items()}


def swaps(text: str, kinds: dict[str, list[str]]) -> list[tuple[str, str, int]]:
    """(term, other term of its kind, sentences that hold the first): the swaps of a text's sentences."""
    terms = {t for k in kinds.values() for t in k}
    held = Counter(t for s in _sentence(text.lower()) for t in terms.intersection(_word(s)))
    return sorted((t, o, n) for t, n in held.items() for k in kinds.values() if t in k for o in k if o != t)


def copy_key(words: list[str]) -> int:
    """The smallest hash of SHINGLE words in a row (of all words, where there are fewer), as a signed number."""
    last = max(1, len(words) - SHINGLE + 1)
    least = min(xxhash.xxh64_intdigest(" ".join(words[i : i + SHINGLE])) for i in range(last))
    return least - (1 << 63)


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        """The chance of label 1, by the whole text."""
        words, weights = words_of(text), self.weights
        counts: Counter[str] = Counter()
        for word, n in Counter(words).items():
            if word in weights:
                counts[word] += n
            for length in STARTS:
                if len(word) > length and (start := f"{word[:length]}-") in weights:
                    counts[start] += n
        total = self.bias + sum(weights[f] * n / (n + HALF * len(words)) for f, n in sorted(counts.items()))
        return float(1 / (1 + np.exp(-np.clip(total, -50, 50))))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, width: int, changes: list[tuple[dict[int, float], int]]) -> np.ndarray:
    """Weights of `width` features and, last, the bias: Newton's method with conjugate gradients.

    Row rows[i] has values[i] of feature columns[i]. `changes` has for each swap what it changes, and how often. What is
    minimised: the mean log loss, RIDGE times the squared weights, and COUNTERFACTUAL times the mean squared change.
    """
    n = len(labels)
    rows, columns, values = np.concatenate([rows, np.arange(n)]), np.concatenate([columns, np.full(n, width)]), np.concatenate([values, np.ones(n)])
    swap = np.array([i for i, (c, _) in enumerate(changes) for _ in c], np.int64)
    changed = np.array([f for c, _ in changes for f in c], np.int64)
    by = np.array([x for c, _ in changes for x in c.values()], float)
    share = np.array([k for _, k in changes], float) / max(1, sum(k for _, k in changes))
    ridge = np.full(width + 1, RIDGE)
    ridge[width] = 0

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=values * w[columns], minlength=n)

    def back(z: np.ndarray) -> np.ndarray:
        return np.bincount(columns, weights=values * z[rows], minlength=width + 1)

    def change(w: np.ndarray) -> np.ndarray:
        return np.bincount(swap, weights=by * w[changed], minlength=len(changes))

    def penalty(w: np.ndarray) -> np.ndarray:
        """Half the gradient of the penalties; linear in w."""
        return ridge * w + COUNTERFACTUAL * np.bincount(changed, weights=by * (share * change(w))[swap], minlength=width + 1)

    def loss(w: np.ndarray) -> float:
        z = forward(w)
        return float(np.mean(np.logaddexp(0, z) - labels * z) + ridge @ (w * w) + COUNTERFACTUAL * share @ change(w) ** 2)

    w = np.zeros(width + 1)
    rate = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    w[width] = np.log(rate / (1 - rate))
    now = loss(w)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -50, 50)))
        gradient = back(p - labels) / n + 2 * penalty(w)
        if np.linalg.norm(gradient) < TOLERANCE:
            break
        curve = p * (1 - p) / n
        step, rest = np.zeros_like(w), -gradient
        direction, norm = rest.copy(), rest @ rest
        for _ in range(50):
            image = back(curve * forward(direction)) + 2 * penalty(direction)
            size = norm / max(direction @ image, 1e-300)
            step, rest = step + size * direction, rest - size * image
            before, norm = norm, rest @ rest
            if norm < 1e-4 * (gradient @ gradient):
                break
            direction = rest + norm / before * direction
        scale = 1.0
        while scale > 1e-6 and loss(w + scale * step) > now:
            scale /= 2
        w, last, now = w + scale * step, now, loss(w + scale * step)
        if last - now < TOLERANCE * abs(last):
            break
    return w


def learn(documents: DataFrame, labels: DataFrame, kinds: dict[str, list[str]] = IDENTITY_TERMS) -> Model | None:
    """A model from labelled rows that are not held out; None where no row or only one label can be learnt from.

    Rows without text or label are not learnt from; a document with both labels, or of equal doc_ids, counts with each.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    share, sizes = _share(known.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).distinct(), F.xxhash64("doc_id"))
    if share is None:
        return None
    # A share has a few times ROWS_PER_LABEL rows of numbers at most, so it is broadcast, and no text is shuffled.
    return _learn(documents.where(F.col("text") != "").select("doc_id", "text").join(F.broadcast(share), "doc_id"), sizes, kinds)


def _share(labelled: DataFrame, hashed: Column) -> tuple[DataFrame | None, list[int]]:
    """Rows of each label by a share of their hashes, with `place`, and the numbers of all rows; none of one label alone.

    The share holds twice the rows that are wanted of each label, since copies go.
    """
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None, []
    upto = [int(min(1.0, 2 * ROWS_PER_LABEL / sizes[label]) * (1 << 40)) for label in (0, 1)]
    placed = labelled.withColumn("place", F.pmod(hashed, F.lit(1 << 40)))
    return placed.where(F.col("place") < F.when(F.col("toxic") == 1, upto[1]).otherwise(upto[0])), [sizes[0], sizes[1]]


def learn_rows(labelled: DataFrame, kinds: dict[str, list[str]]) -> Model | None:
    """A model from rows of text and toxic (0 or 1)."""
    share, sizes = _share(labelled, F.xxhash64("text"))
    return None if share is None else _learn(share, sizes, kinds)


def _learn(share: DataFrame, sizes: list[int], kinds: dict[str, list[str]]) -> Model | None:
    spark = share.sparkSession
    bounded_batches(spark)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), TOGETHER):
                batch = whole.iloc[at : at + TOGETHER]
                found = [values_of(t) for t in batch["text"]]
                swapped = [[{"taken": a, "added": b, "n": n} for a, b, n in swaps(t, kinds)] for t in batch["text"]]
                yield pd.DataFrame({
                    "copy": [copy_key(words_of(t)) for t in batch["text"]], "place": batch["place"].to_numpy(), "toxic": batch["toxic"].to_numpy(),
                    "features": [list(v) for v in found], "values": [np.fromiter(v.values(), float, len(v)) for v in found], "swaps": swapped,
                })

    schema = "copy long, place long, toxic int, features array<string>, values array<double>, swaps array<struct<taken:string,added:string,n:long>>"
    made = stage(share.select("text", "toxic", "place").mapInPandas(featured, schema))
    first = made.groupBy("copy").agg(F.min(F.struct("place", "toxic")).alias("f")).select("copy", "f.place", "f.toxic")
    # At most ROWS_PER_LABEL rows of a label.
    chosen = {label: first.where(F.col("toxic") == label).orderBy("place", "copy").limit(ROWS_PER_LABEL).collect() for label in (0, 1)}
    facts = [(r["copy"], r["place"], r["toxic"]) for label in (0, 1) for r in chosen[label]]
    totals = [len(chosen[0]), len(chosen[1])]
    if not all(totals):
        return None
    numbered = spark.createDataFrame([(*f, i) for i, f in enumerate(facts)], "copy long, place long, toxic int, row int")
    sample = stage(made.join(F.broadcast(numbered), ["copy", "place", "toxic"]).dropDuplicates(["row"]).select("row", "toxic", "features", "values", "swaps"))
    each = sample.select("row", "toxic", F.explode(F.arrays_zip("features", "values")).alias("f")).select("row", "toxic", F.col("f.features").alias("feature"), F.col("f.values").alias("value"))
    n = sum(totals)
    means = [F.sum(F.when(F.col("toxic") == label, F.col("value")).otherwise(0.0)) / totals[label] for label in (0, 1)]
    # The standard error that the difference of means would have if labels were dealt at random.
    variance = F.sum(F.col("value") ** 2) / n - (F.sum("value") / n) ** 2
    apart = F.abs(means[1] - means[0]) / F.sqrt(variance * (1 / totals[0] + 1 / totals[1]))
    scored = each.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), apart.alias("apart"))
    best = scored.where((F.col("n") >= LEAST_ROWS) & (F.col("apart") >= LEAST_ERRORS)).orderBy(F.desc("apart"), "feature").limit(MOST_FEATURES)
    number = {r["feature"]: i for i, r in enumerate(best.select("feature").collect())}
    numbers = spark.createDataFrame(list(number.items()) or [("", -1)], "feature string, number int")
    held = each.join(F.broadcast(numbers), "feature").select("row", "number", "value").toPandas().sort_values(["row", "number"])
    swapped = sample.select(F.explode("swaps").alias("s")).groupBy("s.taken", "s.added").agg(F.sum("s.n").alias("n")).orderBy("taken", "added").collect()
    changes = []
    for r in swapped:
        change = Counter({number[f]: 1 for f in features_of(r["added"]) if f in number})
        change.subtract(number[f] for f in features_of(r["taken"]) if f in number)
        if any(change.values()):
            changes.append(({f: float(x) for f, x in sorted(change.items()) if x}, r["n"]))
    release(made, sample)
    labels = np.array([label for _, _, label in facts], float)
    weights = fit(held["row"].to_numpy(np.int64), held["number"].to_numpy(np.int64), held["value"].to_numpy(float), labels, len(number), changes)
    # The sample may hold another share of each label than there is.
    prior = np.log(sizes[1] / sizes[0]) - np.log(totals[1] / totals[0])
    return Model(dict(zip(number, weights[:-1].tolist())), float(weights[-1] + prior))


def predict(documents: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns, plus score (0 to 1) and predicted (1 from THRESHOLD on), from whole texts.

    Null and empty texts get the score of a text without a known word; without a model all scores are 0. Equal texts get
    equal scores, repeated rows stay, an empty table gives no rows. Columns of these names are replaced.
    """
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            yield pd.Series([own.score(t or "") if own else 0.0 for t in texts], dtype=float)

    seen = set_apart(documents, (text,)).withColumn("score", scored.asNondeterministic()(F.col(text)))
    seen = seen.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    return put_back(seen, documents.columns, (text,), ("score", "predicted"))


def score_documents(documents: DataFrame, labels: DataFrame, kinds: dict[str, list[str]] = IDENTITY_TERMS) -> DataFrame:
    """Learn from labelled rows that are not held out, and score every row; see learn and predict."""
    return predict(documents, learn(documents, labels, kinds))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
