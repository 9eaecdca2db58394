"""Secret scans through an inverted index of trigrams, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridweave.llm.trigrams import Clause, query
from gridweave.session import materialize

# Documents of one block of the index, about; a posting list is no longer.
BLOCK_DOCS = 4096
# Matches whose lengths are summed in one step.
STEP = 1000


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; of these, the ones whose
    group has at least `least` characters count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    def clauses(self) -> list[Clause]:
        return query(self.pattern)


# The last two are the base patterns with their least lengths written in: a run that is
# too short has no part that is long enough.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Forms of well-known keys.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + MORE


def _key(id: str, text: str) -> Column:
    """What the index calls a row. Rows that share a key share candidates, which are
    verified for each row, so a chance agreement costs time and changes nothing."""
    return F.xxhash64(F.col(id), F.col(text))


def build_index(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The inverted index (block, trigram, docs) of the trigrams that the rules ask for,
    stored in the shared folder. `docs` is a posting list: sorted keys of the documents of
    the block whose text, in lower case, has the trigram. Blocks deal documents by hash."""
    wanted = sorted({t for r in rules for clause in r.clauses() for some in clause for t in some})
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    low = F.lower(F.col(text))
    rows = docs.where(F.col(text).isNotNull()).select(_key(id, text).alias("key"), low.alias("low"))
    found = rows.select(
        "key",
        F.explode(F.filter(F.array(*map(F.lit, wanted)), lambda t: F.contains(F.col("low"), t))).alias("trigram"),
    )
    listed = found.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "trigram").agg(
        F.array_sort(F.collect_set("key")).alias("docs")
    )
    return materialize(listed, "trigram-index")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, kinds): for each document that meets a rule's query, the rules it meets.

    For each block the posting lists are put side by side, and each rule's query runs on
    them: lists of an alternative are intersected, alternatives united, clauses intersected.
    Rules without a clause have no part in the index.
    """
    blocks = index.groupBy("block").agg(
        F.map_from_entries(F.collect_list(F.struct("trigram", "docs"))).alias("lists")
    )
    none = F.array().cast("array<bigint>")

    def postings(trigram: str) -> Column:
        return F.coalesce(F.element_at("lists", F.lit(trigram)), none)

    def both(a: Column, b: Column) -> Column:
        return F.array_intersect(a, b)

    def clause_docs(clause: Clause) -> Column:
        return reduce(F.array_union, [reduce(both, map(postings, sorted(some))) for some in clause])

    asked = [(r.kind, r.clauses()) for r in rules if r.clauses()]
    lists = F.array(*[
        F.struct(F.lit(kind).alias("kind"), reduce(both, map(clause_docs, clauses)).alias("docs"))
        for kind, clauses in asked
    ])
    met = blocks.select(F.inline(lists)).select("kind", F.explode("docs").alias("key"))
    return materialize(met.groupBy("key").agg(F.collect_set("kind").alias("kinds")), "secret-candidates")


def spans(text: Column, rule: Rule) -> Column:
    """[(start, end)] of the rule's matches in code points, the end exclusive.

    Splitting gives the text between matches, extraction the matches, so places are sums
    of lengths. These are summed in steps, so that a text with very many matches is no
    problem.
    """
    lengths = F.zip_with(
        F.split(text, rule.pattern, -1),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)),
        lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("own")),
    )
    whole = F.filter(lengths, lambda x: x["own"].isNotNull())
    steps = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / STEP).cast("int"))

    def step(k: Column) -> Column:
        return F.slice(whole, k * STEP + 1, F.lit(STEP))

    before = F.transform(
        steps, lambda k: F.aggregate(step(k), F.lit(0), lambda s, x: s + x["gap"] + x["own"])
    )
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def placed(k: Column) -> Column:
        begin = F.aggregate(F.slice(before, F.lit(1), k), F.lit(0), lambda s, x: s + x)
        return F.aggregate(
            step(k),
            F.struct(begin.alias("at"), empty.alias("out")),
            lambda s, x: F.struct(
                (s["at"] + x["gap"] + x["own"]).alias("at"),
                F.concat(
                    s["out"],
                    F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["own"]).alias("end"))),
                ).alias("out"),
            ),
            lambda s: s["out"],
        )

    every = F.when(F.size(whole) > 0, F.flatten(F.transform(steps, placed))).otherwise(empty)
    if not rule.least:
        return every
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    kept = F.filter(
        F.arrays_zip(every.alias("span"), group.alias("value")), lambda x: F.length(x["value"]) >= rule.least
    )
    return F.transform(kept, lambda x: x["span"])


def scan(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, found) for every row: `found` is an array of (kind, start, end) by start, then
    by the order of the rules.

    A rule with a trigram query is run on the candidates of the index; one without is run
    on every text. Candidates are joined by key: Spark sends them to all workers if they
    are few and shuffles if not. Null and empty texts have no secrets; equal rows get equal
    answers; no rows, no answers.
    """
    slim = docs.select(
        F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    listed = candidates(build_index(slim, rules, "doc_id", "text"), rules)
    rows = slim.withColumn("key", _key("doc_id", "text")).join(listed, "key", "left")
    empty = F.array().cast("array<struct<start:int,end:int>>")
    parts = []
    for place, rule in enumerate(rules):
        if rule.clauses():
            to_scan = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        else:
            to_scan = F.col("text").rlike(rule.pattern)
        found = F.when(to_scan, spans(F.col("text"), rule)).otherwise(empty)
        parts.append(F.transform(found, _named(place, rule.kind)))
    ordered = F.array_sort(F.concat(*parts))
    return rows.select(
        "doc_id",
        F.transform(
            ordered, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
        ).alias("found"),
    )


def _named(place: int, kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(
        x["start"].alias("start"), F.lit(place).alias("place"), x["end"].alias("end"), F.lit(kind).alias("kind")
    )


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def joined(found: Column) -> Column:
    return F.array_join(
        F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): counts and digest of the base
    kinds, and all spans."""
    found = F.col("found")
    kinds = [r.kind for r in BASE]
    base = F.filter(found, lambda x: x["kind"].isin(kinds))
    return scan(docs).select(
        "doc_id",
        *[F.size(F.filter(found, _is(k))).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(found).alias("spans"),
    )
