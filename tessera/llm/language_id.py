"""Language identification with a string kernel: Nystroem landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts is the number of distinct n-grams (all n from 1 to MOST_N) present in both, over the root of the
product of their own numbers: a blended-spectrum presence kernel. N-grams are whole sequences of code points in lower
case, of any script; all that a landmark holds count, and none that no landmark holds. A bounded sample of labelled rows
is fitted; some of them are the landmarks. The kernel values of a batch of texts against all landmarks come from one
product of presence matrices, and the scores from one more product with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, put_back, set_apart, table

MOST_N = 3
#: Bounds of the fitted sample: rows for each language, and rows over all languages together, of which each language
#: has two at least. Rows with longer texts are taken only where a language has no others.
SAMPLE_PER_LANGUAGE, MOST_SAMPLES = 400, 4000
LONG_TEXT = 20_000
#: Landmarks for each language, and over all languages together, of which each has one at least.
LANDMARKS_PER_LANGUAGE, MOST_LANDMARKS = 40, 800
RIDGE = 1e-3
#: Characters that are worked on at once, texts of one product, and n-grams of a product.
PIECE, TOGETHER, WIDTH = 1 << 18, 128, 1 << 15
UNDETERMINED = "und"
#: A text of so many letters is in no learnt language where fewer of its sequences of MOST_N characters than this share
#: occur in the winner's landmarks. That does not depend on the number of languages; shorter texts are not judged.
LEAST_LETTERS, LEAST_FAMILIAR = 100, 0.375
#: Fixed value: the multiplier of the hash of an n-gram.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """The n-grams of the landmarks by number, found without sorting: tables by hash, each n-gram in one of them."""

    def __init__(self, landmarks: list[str]) -> None:
        self.alphabet = np.unique(np.concatenate([_points(t) for t in landmarks]))
        self.alphabet = self.alphabet[self.alphabet > 0]
        self.numbers = np.zeros(int(self.alphabet.max(initial=0)) + 2, np.int64)
        self.numbers[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        self.codes = np.unique(np.concatenate([c for t in landmarks for c in self._codes(_points(t))]))
        self.bits = max(10, int(16 * len(self.codes)).bit_length())
        self.tables, left, turn = [], np.arange(len(self.codes)), 0
        while len(left):
            table = np.full(1 << self.bits, -1, np.int32)
            slot = self._slot(self.codes[left], turn)
            table[slot] = left
            self.tables.append(table)
            left, turn = left[table[slot] != left], turn + 1

    def _slot(self, codes: np.ndarray, turn: int) -> np.ndarray:
        mixed = (codes.astype(np.uint64) + np.uint64(turn)) * MULTIPLIER
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _codes(self, points: np.ndarray) -> list[np.ndarray]:
        """Codes of all n-grams of known characters: n arrays, with 0 where one is not known."""
        own = self.numbers[np.minimum(points, len(self.numbers) - 1)]
        out, code = [own], own
        for n in range(2, MOST_N + 1):
            if len(own) < n:
                break
            code = (code[:-1] << 21 | own[n - 1 :]) * ((code[:-1] > 0) & (own[n - 1 :] > 0))
            out.append(code)
        return out

    def held(self, points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each n: places and numbers of the known n-grams of n characters."""
        out = []
        for codes in self._codes(points):
            number = np.full(len(codes), -1, np.int32)
            for turn, table in enumerate(self.tables):
                found = table[self._slot(codes, turn)]
                right = (found >= 0) & (self.codes[found] == codes)
                number[right] = found[right]
            place = np.flatnonzero((number >= 0) & (codes > 0))
            out.append((place, number[place]))
        return out


@dataclass
class Model:
    languages: list[str]
    grams: Grams
    #: For each n-gram the landmarks that have it, as a row of 0 and 1; and the languages whose landmarks have it.
    landmarks: np.ndarray
    languages_of: np.ndarray
    landmark_sizes: np.ndarray
    weights: np.ndarray


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number of each place, code points) of whole texts, some at a time; a zero stands after each text.

    Long texts come in pieces that share MOST_N - 1 characters, which changes no set of n-grams.
    """
    rows, points, held = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), PIECE):
            own = _points(text[at : at + PIECE + MOST_N - 1])
            rows.append(np.full(len(own) + 1, i))
            points += [own, np.zeros(1, np.int64)]
            held += len(own)
            if held >= PIECE:
                yield np.concatenate(rows), np.concatenate(points)
                rows, points, held = [], [], 0
    if rows:
        yield np.concatenate(rows), np.concatenate(points)


def presence(own: Grams, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row for each text, True where it has the n-gram; and text and number of each known n-gram of MOST_N characters."""
    out = np.zeros((len(texts), len(own.codes)), bool)
    longest = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
    for rows, points in _pieces(texts):
        for n, (place, number) in enumerate(own.held(points), 1):
            row = rows[place]
            out[row, number] = True
            if n == MOST_N:
                longest.append((row.astype(np.int32), number.astype(np.int32)))
    return out, np.concatenate([r for r, _ in longest]), np.concatenate([x for _, x in longest])


def batches(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, some at a time, by number and by characters."""
    some, held = [], 0
    for text in texts:
        some.append(text)
        held += len(text)
        if len(some) == TOGETHER or held > 4 * PIECE:
            yield some
            some, held = [], 0
    if some:
        yield some


def _kernel(model: Model, own: np.ndarray) -> np.ndarray:
    out = np.zeros((len(own), model.landmarks.shape[1]), np.float32)
    columns = np.flatnonzero(own.any(axis=0))
    for left in range(0, len(columns), WIDTH):
        some = columns[left : left + WIDTH]
        out += own[:, some].astype(np.float32) @ model.landmarks[some].astype(np.float32)
    return out / (np.sqrt(np.maximum(own.sum(axis=1), 1))[:, None] * model.landmark_sizes).astype(np.float32)


def kernel(model: Model, texts: list[str]) -> np.ndarray:
    """Kernel values of each text with each landmark, over all n-grams of the landmarks."""
    none = np.zeros((0, model.landmarks.shape[1]), np.float32)
    return np.concatenate([none, *[_kernel(model, presence(model.grams, some)[0]) for some in batches(texts)]])


def judge(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the winner, its score (see scores), and how familiar the text is: see LEAST_FAMILIAR."""
    found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
    for some in batches(texts):
        own, row, number = presence(model.grams, some)
        best, score = scores(_kernel(model, own) @ model.weights)
        known = np.bincount(row, weights=model.languages_of[number, best[row]], minlength=len(some))
        places = np.array([max(0, len(t) - MOST_N + 1) for t in some])
        # Lower case may be longer than the text by a few characters.
        found.append((best, score, np.where(places > 0, np.minimum(1, known / np.maximum(places, 1)), 1.0)))
    return tuple(np.concatenate(x) for x in zip(*found))


def fit(texts: list[str], languages: list[str]) -> Model:
    """Fit to a sample; the order of the rows decides which of them are landmarks, so the fit is the same each time."""
    names = sorted(set(languages))
    most = max(1, min(LANDMARKS_PER_LANGUAGE, MOST_LANDMARKS // len(names)))
    chosen: list[int] = []
    for name in names:
        own = [i for i, x in enumerate(languages) if x == name]
        chosen += own[:: max(1, len(own) // most)][:most]
    own = Grams([texts[i] for i in chosen])
    landmarks = presence(own, [texts[i] for i in chosen])[0].T.astype(np.uint8)
    of = np.array([languages[i] for i in chosen])
    languages_of = np.stack([landmarks[:, of == name].any(axis=1) for name in names], axis=1)
    model = Model(names, own, landmarks, languages_of, np.sqrt(np.maximum(landmarks.sum(axis=0), 1)).astype(np.float32), np.zeros((1, 1)))
    # Nystroem: kernel ridge regression in the span of the landmarks, for targets of 1 and -1.
    cross = kernel(model, texts).astype(np.float64)
    targets = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    left = cross.T @ cross + RIDGE * len(texts) * cross[chosen] + 1e-8 * len(texts) * np.eye(len(chosen))
    model.weights = np.linalg.solve(left, cross.T @ targets).astype(np.float32)
    return model


def learnable(documents: DataFrame) -> Column:
    """Rows that may be learnt from: labelled, with text, and not held out."""
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "") & ~held_out()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(documents: DataFrame) -> Model | None:
    """A model of all languages from a sample of bounded size, spread over all rows by a hash of the text.

    None without labelled rows. Whole texts are fitted; copies count once.
    """
    rows = documents.where(learnable(documents)).select("lang", "text")
    by_language = rows.groupBy("lang").count().orderBy("lang").collect()
    if not by_language:
        return None
    most = max(2, min(SAMPLE_PER_LANGUAGE, MOST_SAMPLES // len(by_language)))
    # A share by hash keeps a little more than is wanted of each language; the smallest hashes of it are taken.
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    limits = documents.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 4 * most / r["count"]) * (1 << 40))) for r in by_language], "lang string, upto long")
    cut = rows.join(F.broadcast(limits), "lang").where(place < F.col("upto"))
    order = F.struct((F.length("text") > LONG_TEXT).alias("long"), place.alias("place"), "text")
    best = F.slice(F.array_sort(F.array_distinct(F.collect_list(order))), 1, most)
    sample = cut.groupBy("lang").agg(best.alias("rows")).select("lang", F.explode("rows").alias("r")).select("lang", "r.long", "r.text")
    found = sorted((r["lang"], r["long"], r["text"]) for r in sample.collect())
    short = {lang for lang, is_long, _ in found if not is_long}
    taken = [(lang, text) for lang, is_long, text in found if not is_long or lang not in short]
    return fit([t for _, t in taken], [x for x, _ in taken])


def scores(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The winner of each row of regression values, and its score: half its lead over the second, within 0 and 1.

    A text of the winner's language has a lead near 2, a text that is like no learnt language a lead near 0; this does
    not depend on the number of languages. With one language its value counts, moved from [-1, 1] to [0, 1].
    """
    best = values.argmax(axis=1)
    rows = np.arange(len(values))
    top = values[rows, best]
    if values.shape[1] == 1:
        return best, np.clip((top + 1) / 2, 0, 1)
    others = values.copy()
    others[rows, best] = -np.inf
    return best, np.clip((top - others.max(axis=1)) / 2, 0, 1)


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """All columns, plus lang_pred, score (0 to 1) and lang_familiar (see judge), from whole texts.

    Texts that are null or have no letter are `und` with score 0, as are all without a model. Repeated rows get equal
    values, an empty table gives none, texts of any length are read whole. Columns of these names are replaced.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, lang_familiar double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            names, found, familiar = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if own and t and any(map(str.isalpha, t))]
            if rows:
                for i, b, s, f in zip(rows, *judge(own, [texts.iloc[i] for i in rows])):
                    names[i], found[i], familiar[i] = own.languages[b], float(s), float(f)
            yield pd.DataFrame({"lang_pred": names, "score": found, "lang_familiar": familiar})

    # A filter on the result must not be pushed below the step that makes it, which would then run twice.
    seen = set_apart(documents, ("text",)).withColumn("_p", scored.asNondeterministic()(F.col("text")))
    more = ("lang_pred", "score", "lang_familiar")
    seen = seen.withColumns({c: F.col(f"_p.{c}") for c in more})
    return put_back(seen, documents.columns, ("text",), more)


def is_rejected() -> Column:
    """Of rows of predict(): whether the text has no language, or none that was learnt."""
    letters = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]", ""))
    foreign = (letters >= LEAST_LETTERS) & (F.col("lang_familiar") < LEAST_FAMILIAR)
    return (F.col("lang_pred") == UNDETERMINED) | foreign


def identify(documents: DataFrame) -> DataFrame:
    """Learn from the rows that may be learnt from and predict every row; see learn and predict."""
    return predict(documents, learn(documents))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
