"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridweave.functions.chance import shuffle_key
from gridweave.llm.common import WORD
from gridweave.operators.numbering import dense_index
from gridweave.session import materialize

# The most copies of a document that the mix may hold.
MOST_COPIES = 3
# Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
# Offsets are multiples of 2 ** -OFFSET_BITS, so that offset + whole number is exact.
OFFSET_BITS = 16
# Parts of a source by size of document, the larger first, that make good for each other.
STRATA = 6


def word_count(text: str | Column = "text") -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code-point order, null last, have the weights in turn, and share the sum
    of all sizes by weight. No target passes `most` times its source's size; what is over
    goes to the others by weight until none is above. Sources are numbered by a range
    sort and the level is found by sums over them, so their number may grow too.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ordered = dense_index(totals, [F.col("source").isNull(), F.col("source")], "place")
    turn = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    stored = materialize(
        ordered.select("*", turn.alias("w"), (F.col("source_size") * most).cast("double").alias("most")),
        "mix-sources",
    )
    total = stored.agg(F.sum("source_size")).first()[0] or 0
    level, full, count = 0.0, F.lit(False), -1
    while True:
        over, kept, weight = stored.agg(
            F.count_if(full),
            F.coalesce(F.sum(F.when(full, F.col("source_size") * most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)),
        ).first()
        if over == count or not weight:
            break
        count, level = over, float(total - kept) / weight
        full = F.col("most") < F.lit(level) * F.col("w")  # holds the earlier ones, as levels rise
    target = F.when(full, F.col("most")).otherwise(F.lit(level) * F.col("w"))
    return stored.select("source", "source_size", target.alias("target"))


def copies(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    id: str = "doc_id",
    seed: str = "mix",
    weights: tuple[int, ...] = WEIGHTS,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns `keep` of `docs` (all by default) in a struct `row`, with size, source_size,
    target and the copies to take.

    The documents of a source stand in order of size, largest first, in strata: the larger
    half of its words, half of the rest, and so on. Each document is expected as often as its
    stratum's rate says, which is what is left of the target over what is left of the words.
    With one random offset for the source, a document is taken once for each whole
    number between the sums of expected copies before and after it. A large document taken
    or not is so made good by the smaller ones, and the words taken come near the target.

    The order is one range sort of all documents: a source that holds most rows is cut like
    any other, and places come from the sort. Sums by source and size class decide strata;
    a stratum's rates need one sum by source over the strata before it.

    Null texts have size 0; what has no words is not taken. Null sources are one source.
    Equal rows may swap places, which changes nothing. An empty table gives no rows.
    """
    sized = docs.select(
        F.struct(*(keep or docs.columns)).alias("row"),
        F.col(source).cast("string").alias("source"),
        F.col(id).alias("id"),
        word_count(text).alias("size"),
    )
    keys = [F.col("source").isNull(), F.col("source"), F.col("size").desc(), shuffle_key(seed, F.col("id")), F.col("id")]
    placed = dense_index(sized, keys, "place").withColumn("class", F.length(F.bin("size")))
    targets = source_targets(placed.select("source", "size"), weights)
    strata = _strata(placed, targets)
    rates = _rates(placed, strata, seed)
    return (
        _with_copies(placed, rates)
        .select("row", "source", "size", "source_size", "target", "copies")
    )


def _strata(placed: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, source_size, target, class, stratum, first, docs, words): for each source and class
    its stratum, and the stratum's first place, documents and words. A class is in the
    last stratum k for which it and the smaller ones hold at most 1 / 2 ** k of the words."""
    classes = placed.groupBy("source", "class").agg(
        F.sum("size").alias("words"), F.count("*").alias("docs"), F.min("place").alias("first")
    )
    known = classes.select(F.col("source").alias("key"), "class", "words", "docs", "first").join(
        targets, F.col("key").eqNullSafe(F.col("source"))
    )
    larger = Window.partitionBy("key").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("source_size") - F.coalesce(F.sum("words").over(larger), F.lit(0))
    place = sum((F.when(rest * (1 << k) <= F.col("source_size"), 1).otherwise(0) for k in range(1, STRATA)), F.lit(0))
    own = Window.partitionBy("key", "stratum")
    return materialize(
        known.withColumn("stratum", place).select(
            "key", "source_size", "target", "class", "stratum",
            F.min("first").over(own).alias("first"), F.sum("docs").over(own).alias("docs"), F.sum("words").over(own).alias("words"),
        ),
        "mix-strata",
    )


def _rates(placed: DataFrame, strata: DataFrame, seed: str) -> DataFrame:
    """`strata` with the rate and offset of each; a few rows for each source."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce("key", F.lit("")))), 1, OFFSET_BITS // 4), 16, 10)
    state = strata.groupBy("key").agg(
        F.max("target").alias("left_target"), F.max("source_size").alias("left_words")
    ).withColumn("offset", u.cast("double") / F.lit(float(1 << OFFSET_BITS)))
    done = None
    for k in range(STRATA):
        rate = F.when(
            F.col("left_words") > 0,
            F.least(F.greatest(F.col("left_target") / F.col("left_words"), F.lit(0.0)), F.lit(float(MOST_COPIES))),
        ).otherwise(0.0)
        own = state.select(F.col("key").alias("of"), "left_target", "left_words", "offset", rate.alias("rate"))
        now = materialize(
            strata.where(F.col("stratum") == k).join(own, F.col("key").eqNullSafe(F.col("of"))).drop("of"), "mix-rates"
        )
        done = now if done is None else done.unionByName(now)
        if k == STRATA - 1:
            break
        taken = (
            _with_copies(placed.select("source", "class", "size", "place"), now)
            .groupBy(F.col("source").alias("of"))
            .agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
        )
        ended = now.groupBy(F.col("key").alias("has")).agg(
            *[F.max(c).alias(c) for c in ("docs", "words", "rate")]
        ).join(taken, F.col("has").eqNullSafe(F.col("of")))
        passed = F.col("offset") + F.col("docs") * F.col("rate")
        state = materialize(
            state.join(ended, F.col("key").eqNullSafe(F.col("has")), "left").select(
                "key",
                (F.col("left_target") - F.coalesce("taken", F.lit(0))).alias("left_target"),
                (F.col("left_words") - F.coalesce("words", F.lit(0))).alias("left_words"),
                F.coalesce(passed - F.floor(passed), "offset").alias("offset"),
            ),
            "mix-state",
        )
    return materialize(done, "mix-all-rates")


def _with_copies(placed: DataFrame, rates: DataFrame) -> DataFrame:
    """Documents of the strata in `rates`, with their copies."""
    named = rates.withColumnRenamed("class", "of_class")
    expected = F.col("offset") + (F.col("place") - F.col("first")) * F.col("rate")
    after = F.col("offset") + (F.col("place") - F.col("first") + 1) * F.col("rate")
    return placed.join(
        named, F.col("source").eqNullSafe(F.col("key")) & (F.col("class") == F.col("of_class"))
    ).withColumn(
        "copies",
        F.when(F.col("size") > 0, F.least(F.floor(after) - F.floor(expected), F.lit(MOST_COPIES)).cast("int")).otherwise(0),
    )


def mix(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    id: str = "doc_id",
    seed: str = "mix",
) -> DataFrame:
    """The mixed documents: each row as often as it is taken, with the columns of `docs`."""
    taken = copies(docs, source, text, id, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
