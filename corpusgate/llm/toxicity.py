"""Toxicity by a classifier that is trained to say the same when identity terms are swapped.

A text's features are its distinct lower-cased words and their stems, that is their first letters. Training takes a bounded sample of labelled documents, keeps the features that go with a label
beyond chance and every identity term, and fits a logistic model. For each labelled text with identity terms, counterfactual texts have each term
replaced by the next ones of its group, and by none; the squares of the changes of score that this brings (before the logistic function) are added
to the loss, so that what a label owes to a group being named isn't learned as that group's weight. Scoring is a sum over the features of a whole text.

A text without known features, an empty one and a null one get the model's base score. Labels other than 0 and 1, and null ones, aren't learned from;
where training has no label of one kind the model is constant: the share of toxic labels, 0 without any. Of repeated rows of a doc_id training
takes one, the one whose features come first.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.llm.common import PLAIN, materialised, shipped

#: Labelled documents that training takes: all up to this many, else as many by a hash of doc_id.
SAMPLE = 20_000
#: Features that the model may weigh, besides identity terms: those that go with a label most clearly.
FEATURES = 4096
#: A feature is weighed if so many documents of the sample have it, and its G statistic against the labels reaches this.
LEAST_DOCUMENTS = 3
LEAST_G = 12.0
#: A longer word is no feature.
WORD_LENGTH = 40
#: Letters of a word's stems; longer words have them.
STEMS = (3, 4, 5, 6)
#: Weights of the squared weights and of the squared changes under a swap, for each document of the sample.
SHRINK = 5e-4
EVEN = 1.0
#: Terms of a group that each term is swapped with, besides none.
SWAPS = 3
STEPS = 150
#: Words that name groups of people, by what they are told apart by; terms of a group can stand for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "ladies", "gentlemen", "females", "males", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy", "lady", "gentleman", "female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist", "mormon"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists", "mormons"),
    ("gay", "lesbian", "bisexual", "heterosexual", "homosexual", "queer", "straight", "lgbt", "lgbtq"),
    ("black", "white", "asian", "latino", "latina", "hispanic", "african", "european", "arab", "indigenous"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "russian", "turkish", "polish", "nigerian", "japanese"),
    ("immigrants", "refugees", "foreigners", "migrants", "natives", "locals", "citizens"),
    ("disabled", "blind", "deaf", "paralyzed", "autistic", "abled"),
    ("old", "young", "elderly", "teenage", "middleaged"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten"),
    ("ausländer", "flüchtlinge", "einwanderer", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes"),
    ("étrangers", "réfugiés", "immigrés", "citoyens"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas"),
    ("extranjeros", "refugiados", "inmigrantes", "ciudadanos"),
)
_WORD = re.compile(PLAIN)


class Model(NamedTuple):
    """The weight of each feature (a stem ends in *), and the base; their sum goes through the logistic function."""

    weights: dict[str, float]
    base: float


def words_of(text: str) -> set[str]:
    """Distinct words, lower-cased; long ones are none."""
    return {w for w in _WORD.findall(text.lower()) if len(w) <= WORD_LENGTH}


def swapped(words: set[str], groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, swaps: int = SWAPS) -> list[set[str]]:
    """The words with each identity term replaced by the k-th next of its group, for k up to swaps, and with none; nothing without such a term."""
    named = [(group, i, term) for group in groups for i, term in enumerate(group) if term in words]
    if not named:
        return []
    rest = words - {term for _, _, term in named}
    return [rest, *(rest | {group[(i + k) % len(group)] for group, i, _ in named} for k in range(1, swaps + 1))]


def features_of(words: set[str]) -> set[str]:
    return words.union(*({f"{w[:k]}*" for w in words if len(w) > k} for k in STEMS))


def changes_of(words: set[str], groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, swaps: int = SWAPS) -> list[tuple[set[str], set[str]]]:
    """The features that each counterfactual text loses and gains."""
    own = features_of(words)
    return [(own - other, other - own) for other in map(features_of, swapped(words, groups, swaps))]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Rows(NamedTuple):
    """Sparse rows: row, feature and value of each entry that isn't zero."""

    row: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    n: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.feature], self.n)

    def back(self, x: np.ndarray, features: int) -> np.ndarray:
        return np.bincount(self.feature, self.value * x[self.row], features)


def _sparse(rows: list[dict[int, float]]) -> Rows:
    entries = [(i, j, v) for i, row in enumerate(rows) for j, v in sorted(row.items()) if v]
    row, feature, value = zip(*entries, strict=True) if entries else ((), (), ())
    return Rows(np.array(row, np.int64), np.array(feature, np.int64), np.array(value, float), len(rows))


def fit(texts: list[set[str]], changes: list[tuple[set[str], set[str]]], labels: list[int], features: list[str], even: float = EVEN, shrink: float = SHRINK) -> Model:
    """A logistic model of texts' features, by accelerated gradient steps, each feature's of a size that its curvature gives.

    changes: what the counterfactuals of any text lose and gain."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model({}, -40.0 if not len(y) or not y.max() else 40.0)
    number = {w: i for i, w in enumerate(features)}
    x = _sparse([{number[w]: 1.0 for w in held if w in number} for held in texts])
    d = _sparse([{number[w]: sign for sign, held in ((-1.0, lost), (1.0, gained)) for w in held if w in number} for lost, gained in changes])
    n, m = len(y), len(features)
    # A feature's curvature is no more than the sum of its row in X'X, which has the base as a feature of every text.
    sums = lambda r, more: np.bincount(r.feature, (np.bincount(r.row, abs(r.value), r.n) + more)[r.row] * abs(r.value), m)
    curvature = 0.25 * sums(x, 1) / n + 2 * even * sums(d, 0) / n + 2 * shrink
    of_base = 0.25 * (n + len(x.row)) / n
    w = np.zeros(m)
    base = math.log(y.mean() / (1 - y.mean()))
    last_w, last_base = w, base
    for step in range(STEPS):
        ahead = step / (step + 3)
        at_w, at_base = w + ahead * (w - last_w), base + ahead * (base - last_base)
        last_w, last_base = w, base
        error = (_logistic(x.times(at_w) + at_base) - y) / n
        slope = x.back(error, m) + 2 * even / n * d.back(d.times(at_w), m) + 2 * shrink * at_w
        w, base = at_w - slope / curvature, at_base - error.sum() / of_base
    return Model({f: float(v) for f, v in zip(features, w, strict=True) if v}, float(base))


def held_out(key: str = "doc_id") -> Column:
    """Rows that no label is learned from; those without a key are none of them."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, even: float = EVEN) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic. No more than `sample` labelled rows, and of their words no more than `features`, leave Spark."""
    told = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # At most `sample` rows of two numbers.
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(x or "") for x in batch.column("text").to_pylist()]
            own = pa.array([sorted(features_of(w)) for w in words], pa.list_(pa.string()))
            pair = pa.struct([("lost", pa.list_(pa.string())), ("gained", pa.list_(pa.string()))])
            changes = pa.array([[{"lost": sorted(a), "gained": sorted(b)} for a, b in changes_of(w)] for w in words], pa.list_(pair))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), own, changes], ["doc_id", "toxic", "features", "changes"])

    labelled = shipped(docs).select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    schema = "doc_id bigint, toxic int, features array<string>, changes array<struct<lost:array<string>,gained:array<string>>>"
    rows = labelled.select("doc_id", "toxic", "text").mapInArrow(told_apart, schema)
    first = F.min(F.struct("features", "changes"))
    rows = materialised(rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), first.alias("of")).select("doc_id", "toxic", "of.*"), "toxicity-sample")
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    each = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k"))
    share = toxic / n if n else 0.0
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    missing, k = F.lit(n) - F.col("n"), F.col("k")
    g = 2 * (
        part(k, F.col("n") * share) + part(F.col("n") - k, F.col("n") * (1 - share)) + part(toxic - k, missing * share) + part(missing - toxic + k, missing * (1 - share))
    )
    clear = each.filter(F.col("n") >= LEAST_DOCUMENTS).withColumn("g", g).filter(F.col("g") >= LEAST_G)
    best = [r.feature for r in clear.orderBy(F.desc("g"), "feature").limit(features).collect()] if 0 < toxic < n else []
    vocabulary = sorted({*best, *(t for group in IDENTITY_TERMS for t in group)})
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [sorted(sent.value.intersection(x)) for x in batch.column("features").to_pylist()]
            yield batch.set_column(2, "features", pa.array(kept, pa.list_(pa.string())))

    found = rows.mapInArrow(weighed, schema).orderBy("doc_id").collect()
    changes = [(set(c.lost), set(c.gained)) for r in found for c in r.changes]
    return fit([set(r.features) for r in found], changes, [r.toxic for r in found], vocabulary, even)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1) and terms, the features of the text that speak for toxicity most, at most five, for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, base = sent.value
        known = weights.keys()
        for batch in batches:
            held = [features_of(words_of(x)) & known if x else set() for x in batch.column(1).to_pylist()]
            sums = np.array([base + math.fsum(map(weights.__getitem__, words)) for words in held], float)
            terms = [sorted((w for w in words if weights[w] > 0), key=lambda w: (-weights[w], w))[:5] for words in held]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_logistic(sums)), pa.array(terms, pa.list_(pa.string()))], [key, "score", "terms"])

    kind = docs.schema[key].dataType.simpleString()
    return shipped(docs).select(F.col(key), F.col(text).cast("string")).mapInArrow(scored, f"`{key}` {kind}, score double, terms array<string>")


def predicted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op11."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "terms")
