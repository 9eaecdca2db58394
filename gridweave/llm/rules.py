"""Quality rules in a short-circuit cascade, ordered by rejections per cost on a sample."""

from __future__ import annotations

import copy
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridweave.llm.common import map_arrow, texts

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
WINDOW = 5
LEAST_WORDS = 10
# Share of words in repeated windows, in percent, that is too much.
MOST_REPEATED = 20
# Expected rows of the sample that rules are measured on, and its seed.
SAMPLE_ROWS = 2000
SAMPLE_SEED = 7
# What is worked out for every document before the cascade.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Document:
    """A text and what rules ask about it, worked out when first asked."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words: bytes that begin one, less the spaces."""
        chars = len(self.text) if self.text.isascii() else len(self.text.decode())
        return chars - sum(map(self.text.count, (SPACES[i : i + 1] for i in range(len(SPACES)))))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def n_distinct(self) -> int:
        return len(set(self.words))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more in the list.

    Windows are compared exactly, as numbers made of the words' places in a vocabulary.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    vocabulary: dict[bytes, int] = {}
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words))
    code, base = ids[:n], len(vocabulary)
    span = base
    for i in range(1, window):
        if span * base >= 1 << 62:  # number the prefixes anew before they overflow
            code = np.unique(code, return_inverse=True)[1]
            span = int(code.max()) + 1
        code, span = code * base + ids[i : i + n], span * base
    order = np.sort(code)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(code, again))
    edges[at] += 1
    edges[at + window] -= 1
    return int((np.cumsum(edges) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]


def _symbols(d: Document) -> bool:
    return 10 * d.n_symbols > 3 * d.n_words


def _word_length(d: Document) -> bool:
    return not 2 * d.n_words <= d.word_chars <= 25 * d.n_words


def _duplicate_lines(d: Document) -> bool:
    return 2 * d.n_dup_lines > len(d.lines)


def _shouting(d: Document) -> bool:
    return 2 * sum(map(bytes.endswith, d.words, [b"!!"] * d.n_words)) > d.n_words


def _capitals(d: Document) -> bool:
    return 2 * sum(map(bytes.isupper, d.words)) > d.n_words


def _few_distinct(d: Document) -> bool:
    return d.n_words >= 50 and d.n_distinct**2 < d.n_words


RULES = (
    Rule("symbols", _symbols),
    Rule("word length", _word_length),
    Rule("duplicate lines", _duplicate_lines),
    Rule("shouting", _shouting),
    Rule("capitals", _capitals),
    Rule("few distinct words", _few_distinct),
)


def base_failed(d: Document) -> bool:
    return d.n_words < LEAST_WORDS or 100 * d.n_repeat_words > MOST_REPEATED * d.n_words


def with_counts(text: bytes | None) -> Document:
    """A document whose base counts are worked out."""
    d = Document(text)
    for name in COUNTS:
        getattr(d, name)
    return d


def measure(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, text: str = "text"
) -> dict[str, tuple[float, float]]:
    """{rule: (seconds a document, share rejected)} on a sample of about `rows` rows.

    The sample is what the cascade sees: documents that the base lets pass, with the base
    counts known, so only what a rule adds to them is timed. Each rule has documents of
    its own, so that work which rules share counts for each. Workers return sums. If no
    sampled document passes the base, nothing is known.
    """
    total = docs.count()
    share = min(1.0, rows / max(1, total))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passing = [d for d in map(with_counts, texts(batch)) if not base_failed(d)]
            out = []
            for rule in rules:
                docs_of_rule = [copy.copy(d) for d in passing]
                began = time.perf_counter()
                rejected = sum(map(rule.rejects, docs_of_rule))
                out.append((rule.name, time.perf_counter() - began, rejected, len(passing)))
            yield pa.record_batch(
                [pa.array(c) for c in zip(*out, strict=True)], ["rule", "seconds", "rejected", "n"]
            )

    sampled = docs.select(F.col(text).cast("string").alias("text")).sample(share, SAMPLE_SEED)
    sums = (
        sampled.mapInArrow(over, "rule string, seconds double, rejected long, n long")
        .groupBy("rule")
        .agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n"))
    )
    return {r["rule"]: (r["seconds"] / r["n"], r["rejected"] / r["n"]) for r in sums.collect() if r["n"]}


def ordered(rules: tuple[Rule, ...], measured: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """The rules by falling rejections per second; unknown ones last, as given."""

    def worth(rule: Rule) -> float:
        seconds, share = measured.get(rule.name, (1.0, -1.0))
        return share / max(seconds, 1e-9)

    return tuple(sorted(rules, key=worth, reverse=True))


def first_rejection(d: Document, rules: tuple[Rule, ...]) -> str | None:
    """The first rule that rejects the document; later ones are not asked."""
    return next((r.name for r in rules if r.rejects(d)), None)


def judge(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, counts, base_failed, kept, rejected_by) for every row of `docs`.

    The base counts decide first; a document that passes goes through the cascade, whose
    order is found on a sample beforehand. The order changes which rule is named in
    `rejected_by` and what a run costs, never what is kept. Null and blank texts have no
    words and fail. Equal texts get equal verdicts. An empty table gives no rows.
    """
    cascade = ordered(rules, measure(docs, rules, text=text))
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: dict[str, list] = {c: [] for c in (*COUNTS, "base_failed", "kept", "rejected_by")}
        for t in texts(batch):
            d = with_counts(t)
            for c in COUNTS:
                columns[c].append(getattr(d, c))
            failed = base_failed(d)
            by = "base" if failed else first_rejection(d, cascade)
            columns["base_failed"].append(failed)
            columns["kept"].append(by is None)
            columns["rejected_by"].append(by)
        kinds = [pa.int64()] * len(COUNTS) + [pa.bool_(), pa.bool_(), pa.string()]
        return pa.record_batch(
            [batch.column(0), *(pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True))],
            ["doc_id", *columns],
        )

    return map_arrow(
        docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")),
        rows,
        "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, rejected_by string",
    )
