"""Quality classifier: a linear support vector machine on n-gram indicators scaled by
naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridweave.llm.common import is_held_out

HASH_BITS = 18
# Shares of repeated and of distinct words are indicators in steps of one SHARES-th.
SHARES = 20
FEATURES = (1 << HASH_BITS) + 2 * (SHARES + 1)
# The most labelled documents of each class that a model is fitted on.
SAMPLE_PER_CLASS = 5000
THRESHOLD = 0.3

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def features(text: bytes | None) -> np.ndarray:
    """Sorted numbers of the indicators that are set: hashed byte trigrams with one space
    before and after the text, the share of word bigrams that repeat a word, and the
    share of distinct words. No word, no indicator."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int32)
    b = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint64)
    grams = ((b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) * _SPREAD) >> np.uint64(64 - HASH_BITS)
    same = sum(map(bytes.__eq__, words, words[1:]))
    shares = [-(-same * SHARES // len(words)), SHARES + 1 + len(set(words)) * SHARES // len(words)]
    return np.concatenate([np.unique(grams).astype(np.int32), np.array(shares, np.int32) + (1 << HASH_BITS)])


@dataclass
class Model:
    """Weights of the indicators, and the line from margins to log-odds of label 1."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum(dtype=np.float64)) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log of each indicator's smoothed share among those set in class 1 against class 0."""
    counts = np.ones((2, FEATURES))
    for found, label in zip(rows, labels, strict=True):
        counts[int(label > 0), found] += 1
    shares = counts / counts.sum(1, keepdims=True)
    return np.log(shares[1] / shares[0])


def hinge_by_dual_descent(
    rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = 0.01, rounds: int = 12, seed: int = 0
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + cost * sum of hinge losses.

    Indicator j of a row has the value scale[j]. One dual variable, in 0..cost, belongs
    to each row; each is set in turn to its best value with the others fixed.
    """
    w, bias, dual = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    norms = np.array([scale[found] @ scale[found] + 1 for found in rows])
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        rng.shuffle(order)
        for i in order:
            found = rows[i]
            v = scale[found]
            slope = labels[i] * (w[found] @ v + bias) - 1
            step = min(max(dual[i] - slope / norms[i], 0), cost) - dual[i]
            if step:
                dual[i] += step
                w[found] += step * labels[i] * v
                bias += step * labels[i]
    return w, bias


def _platt(margins: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-out margins, by Newton's method
    on targets drawn in from 0 and 1 as Platt does."""
    ups = labels > 0
    target = np.where(ups, (ups.sum() + 1) / (ups.sum() + 2), 1 / ((~ups).sum() + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    line = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        curve = x.T @ (x * (p * (1 - p))[:, None]) + 1e-4 * np.eye(2)
        move = np.linalg.solve(curve, x.T @ (p - target) + 1e-4 * line)
        line -= move * min(1, 2 / (1e-9 + np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return float(line[0]), float(line[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model for `labels` in {-1, 1}. With one class, or no row, all score its share."""
    if len(set(labels.tolist())) < 2:
        share = 0.5 if not len(labels) else float((labels > 0).mean())
        odds = np.log((share * len(labels) + 1) / ((1 - share) * len(labels) + 1))
        return Model(np.zeros(FEATURES, np.float32), 0.0, 0.0, float(odds))

    def fit(some: np.ndarray) -> tuple[np.ndarray, float]:
        own = [rows[i] for i in some]
        ratios = log_count_ratios(own, labels[some])
        w, bias = hinge_by_dual_descent(own, labels[some], ratios)
        return (w * ratios).astype(np.float32), bias

    places, margins = np.arange(len(rows)), np.zeros(len(rows))
    for half in (0, 1):  # margins of rows that the model did not see
        seen = places[places % 2 != half]
        if len(set(labels[seen].tolist())) < 2:
            seen = places
        model = Model(*fit(seen), 1.0, 0.0)
        margins[places % 2 == half] = [model.margin(rows[i]) for i in places[places % 2 == half]]
    return Model(*fit(places), *_platt(margins, labels))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, quality, features): for each class, the labelled training documents whose
    ids have the smallest hashes. Held-out ids and null labels stay out; of several
    labels of an id the smallest counts, of several texts the one whose indicators come first."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        .where(F.col("quality").isin(0, 1) & ~is_held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    chosen = None
    for quality in (0, 1):
        some = known.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    get = F.arrow_udf(_feature_lists, "array<int>")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (
        found.join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class short rows
        .select("doc_id", "quality", get("text").alias("features"))
        .groupBy("doc_id", "quality")
        .agg(F.min("features").alias("features"))
    )


def _feature_lists(text: pa.Array) -> pa.Array:
    return pa.array([features(t) for t in text.cast(pa.binary()).to_pylist()], pa.list_(pa.int32()))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model of `labels.quality`, learned from the texts of a bounded sample."""
    got = sample(docs, labels, per_class).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    found = got["features"].combine_chunks()
    ends = np.cumsum(found.value_lengths().to_numpy())[:-1] if len(found) else []
    rows = np.split(found.flatten().to_numpy(), ends) if len(found) else []
    return fit_rows(rows, 2 * got["quality"].to_numpy().astype(np.int64) - 1)


def scores(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score, 0 to 1, of the text column; a text without words scores by the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers

    def rate(column: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(features(t)) for t in column.cast(pa.binary()).to_pylist()], pa.float64())

    return F.arrow_udf(rate, "double")(F.col(text).cast("string"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`.

    Texts alone decide a score; equal texts score alike. Null and empty texts have no
    indicator. Ids without a label, repeated rows and further columns are of no account.
    """
    model = fit(docs, labels)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), scores(docs, model).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier does not reject."""
    return docs.where(scores(docs, fit(docs, labels)) >= threshold)
