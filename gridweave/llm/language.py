"""Language identification: each text as a mixture of languages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridweave.llm.common import is_held_out, map_arrow, texts
from gridweave.session import materialize

HASH_BITS = 16
FEATURES = 1 << HASH_BITS
SMOOTHING = 0.5
ROUNDS = 10
# A further language must raise the log-likelihood by PENALTY * log(n-grams): neighbouring
# n-grams overlap, so the evidence of each counts less than in a sample of free draws.
PENALTY = 6.0
# A language with a smaller part in the full mixture is not tried.
LEAST_PART = 0.01
# Languages a counting task holds before it passes their counts on.
HELD_LANGUAGES = 64
# The most languages a model may have: its table, 256 KB a language, goes to every worker.
MOST_LANGUAGES = 1000
CELLS_AT_ONCE = 1 << 21
UNKNOWN = "und"

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def grams(text: bytes) -> np.ndarray:
    """Hashed byte trigrams of the text in lower case, white space as single spaces."""
    b = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint64)
    codes = b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]
    return ((codes * _SPREAD) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return _ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text.decode()))


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # FEATURES x languages


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows with a language. Each task sums its rows up, in a table
    per language, before anything is shuffled."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                if text:
                    if lang not in held and len(held) >= HELD_LANGUAGES:
                        yield from _rows(held)
                        held = {}
                    np.add.at(held.setdefault(lang, np.zeros(FEATURES, np.int64)), grams(text), 1)
        yield from _rows(held)

    known = docs.where(F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    counted = known.mapInArrow(over, "lang string, gram int, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _rows(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, counts in held.items():
        some = np.flatnonzero(counts)
        yield pa.record_batch(
            [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())],
            ["lang", "gram", "n"],
        )


def log_probabilities(counted: DataFrame) -> DataFrame:
    """(lang, log_p) of (lang, gram, n): one packed row of FEATURES floats for each language,
    made of its at most FEATURES counts."""

    def pack(key: tuple[str], rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.full(FEATURES, SMOOTHING)
        counts[rows["gram"].to_numpy()] += rows["n"].to_numpy()
        log_p = np.log(counts / counts.sum()).astype(np.float32)
        return pd.DataFrame({"lang": [key[0]], "log_p": [log_p.tobytes()]})

    return counted.groupBy("lang").applyInPandas(pack, "lang string, log_p binary")


def fit(docs: DataFrame) -> Model:
    """Smoothed n-gram probabilities of each language, from all rows that are not held out.

    The driver takes a packed row for each language, one partition of them at a time, into
    the model's table, of at most MOST_LANGUAGES columns; more are an error before that.
    """
    packed = materialize(log_probabilities(count_grams(docs.where(~is_held_out()))), "language-model")
    n = packed.count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"{n} values of lang; a model may have {MOST_LANGUAGES}")
    languages = sorted(r["lang"] for r in packed.select("lang").collect())
    place = {lang: i for i, lang in enumerate(languages)}
    log_p = np.empty((FEATURES, n), np.float32)
    for row in packed.toLocalIterator():
        log_p[:, place[row["lang"]]] = np.frombuffer(row["log_p"], np.float32)
    return Model(languages, log_p)


def _mixtures(
    p: np.ndarray, counts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, parts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages in each document by expectation-maximisation from
    `parts`, zeros staying zero, and the log-likelihoods less what does not depend on
    them. Columns of `p` are n-grams with their likelihoods, documents are runs of
    columns; languages are rows."""
    total = np.add.reduceat(counts, starts)
    for _ in range(ROUNDS):
        joint = p * np.repeat(parts, sizes, 1)
        joint *= counts / joint.sum(0)
        parts = np.add.reduceat(joint, starts, 1) / total
    mixed = (p * np.repeat(parts, sizes, 1)).sum(0)
    return parts, np.add.reduceat(counts * np.log(mixed), starts)


def proportions(model: Model, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of language proportions for each document, given as its n-grams and counts.

    A mixture of all languages ranks them. Then the best ranked one alone, the best two,
    and so on are fitted, and the set whose log-likelihood less its penalty is highest
    counts. Documents are independent and are worked on together for speed.
    """
    sizes = np.array([len(g) for g, _ in found])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    counts = np.concatenate([c for _, c in found]).astype(np.float64)
    log_p = model.log_p[np.concatenate([g for g, _ in found])].astype(np.float64)
    p = np.ascontiguousarray(np.exp(log_p - log_p.max(1, keepdims=True)).T)
    n = len(model.languages)
    full, _ = _mixtures(p, counts, starts, sizes, np.full((n, len(found)), 1 / n))
    rank = np.argsort(np.argsort(-full, 0, kind="stable"), 0)
    tried = np.maximum(1, (full >= LEAST_PART).sum(0))
    best, gain = np.zeros((n, len(found))), np.full(len(found), -np.inf)
    cost = PENALTY * np.log(1 + np.add.reduceat(counts, starts))
    for k in range(1, int(tried.max()) + 1):
        some = np.flatnonzero(tried >= k)
        own = np.repeat(tried >= k, sizes)
        begin = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
        parts, fit = _mixtures(p[:, own], counts[own], begin, sizes[some], (rank[:, some] < k) / k)
        fit -= (k - 1) * cost[some]
        better = fit > gain[some]
        gain[some[better]] = fit[better]
        best[:, some[better]] = parts[:, better]
    return best.T


def predict(model: Model, column: list[bytes | None]) -> list[tuple[str, float]]:
    """(language, its proportion) of each text; the language that comes first on a tie."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(column)
    group: list[int] = []
    found: list[tuple[np.ndarray, np.ndarray]] = []
    cells = 0

    def decide() -> None:
        for i, parts in zip(group, proportions(model, found), strict=True):
            j = int(parts.argmax())
            out[i] = model.languages[j], min(1.0, float(parts[j]))

    for i, text in enumerate(column):
        if model.languages and has_letter(text):
            group.append(i)
            found.append(np.unique(grams(text), return_counts=True))
            cells += len(found[-1][0]) * len(model.languages)
            if cells > CELLS_AT_ONCE:
                decide()
                group, found, cells = [], [], 0
    if group:
        decide()
    return out


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of `docs`.

    The model learns from texts and languages of all rows that are not held out. Null
    texts and texts without a letter are `und` with score 0, as all are if no row has a
    language. Equal texts get equal answers. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = predict(shared.value, texts(batch))
        return pa.record_batch(
            [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array([lang for lang, _ in got], pa.string()),
                pa.array([score for _, score in got], pa.float64()),
            ],
            ["doc_id", "held_out", "lang_pred", "score"],
        )

    slim = docs.select(
        F.col(id).cast("long").alias("doc_id"), is_held_out(id).alias("held_out"), F.col(text).cast("string").alias("text")
    )
    return map_arrow(slim, rows, "doc_id long, held_out boolean, lang_pred string, score double")
