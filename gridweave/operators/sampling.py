"""Examples for skip-gram training: pairs in windows, and negatives from an alias table.

All draws are digits of an md5 digest of a seed and a key, so a row draws the same
wherever and however often its task runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridweave.functions.chance import draw
from gridweave.operators.lookup import ranked_lookup
from gridweave.operators.numbering import dense_index
from gridweave.operators.vocabulary import HEAD_WORD_LENGTH, HEAD_WORDS
from gridweave.schemas import FIRST_WORD_ID
from gridweave.session import materialize

WIDE = "decimal(38,0)"
# Rows whose running sum one task works out.
SUMMED_AT_ONCE = 4096
# Draws are compared with thresholds of 32 bits.
DRAW = 1 << 32
# An alias table of so many slots is sent to every task, in packed rows of PACKED_SLOTS; 24 bytes a slot.
SENT_SLOTS = 1 << 23
PACKED_SLOTS = 1024


# --- Pairs --------------------------------------------------------------------


def keep_thresholds(dictionary: DataFrame, sample: float = 1e-3) -> DataFrame:
    """(word, word_id, keep): a word of relative frequency f is kept if its draw of 32 bits
    is below `keep`, with probability sqrt(sample / f), at most 1."""
    ordinary = dictionary.where(F.col("word_id") >= FIRST_WORD_ID)
    total = ordinary.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]
    chance = F.least(F.lit(1.0), F.sqrt(F.lit(float(sample * total)) / F.col("cnt").cast("double")))
    return ordinary.select("word", "word_id", F.floor(chance * DRAW).alias("keep"))


def kept_words(
    rows: DataFrame, keys: list[str], tokens: Column, dictionary: DataFrame, sample: float, seed: str
) -> DataFrame:
    """(*keys, pos, word_id): the words of `tokens` that are in the dictionary and survive
    subsampling, with their places from 0.

    Frequent words are found in the broadcast head of the dictionary, rare ones by a shuffle
    join, as in `tokens_to_ids`.
    """
    split = materialize(rows.select(*keys, tokens.alias("_words")), "words")  # read twice by the look-up
    flat = split.select(*keys, F.posexplode("_words").alias("pos", "word"))
    found = ranked_lookup(
        flat,
        keep_thresholds(dictionary, sample),
        "word",
        (F.col("word_id") < HEAD_WORDS) & (F.length("word") <= HEAD_WORD_LENGTH),
        twice=True,
    )
    return found.where(
        F.col("word_id").isNotNull() & (draw(f"{seed}/keep", *map(F.col, keys), F.col("pos")) < F.col("keep"))
    ).select(*keys, "pos", "word_id")


def skipgram_pairs(
    rows: DataFrame,
    keys: list[str],
    tokens: Column,
    dictionary: DataFrame,
    window: int = 5,
    sample: float = 1e-3,
    seed: str = "pairs",
) -> DataFrame:
    """(*keys, pos, step, center, context): the training pairs of each text.

    `keys` identify a row of `rows`. Unknown words and words that subsampling drops leave no
    gap. A centre's window reaches a drawn number of words, 1 to `window`, to either side;
    `pos` is its place in the text and `step` how many kept words the context is ahead of
    it. Words of a text lie in order in one task, which streams them and looks no further than
    `window` words back and ahead.
    """
    words = kept_words(rows, keys, tokens, dictionary, sample, seed)
    order = Window.partitionBy(*keys).orderBy("pos")
    steps = [d for d in range(-window, window + 1) if d]
    near = words.select(
        *keys, "pos", F.col("word_id").alias("center"),
        (draw(f"{seed}/width", *map(F.col, keys), F.col("pos")) % window + 1).alias("width"),
        *(F.lead("word_id", d).over(order).alias(f"_{d}") for d in steps),
    )
    entries = F.array(*(F.struct(F.lit(d).alias("step"), F.col(f"_{d}").alias("context")) for d in steps))
    inside = F.filter(entries, lambda e: (F.abs(e["step"]) <= F.col("width")) & e["context"].isNotNull())
    return near.select(*keys, "pos", "center", F.explode(inside).alias("e")).select(
        *keys, "pos", "e.step", "center", "e.context"
    )


# --- Negatives ----------------------------------------------------------------


def negative_weights(dictionary: DataFrame) -> DataFrame:
    """(word_id, weight): a thousand times the count to the power 3/4, as whole numbers; taken
    by square roots, which are the same on all machines."""
    root = F.sqrt(F.sqrt(F.col("cnt").cast("double")))
    return dictionary.where(F.col("word_id") >= FIRST_WORD_ID).select(
        "word_id", F.floor(1000 * root * root * root + 0.5).alias("weight")
    )


def running_sums(df: DataFrame, order: list[Column], value: str, rank: str, before: str) -> DataFrame:
    """Add `rank`, 0 upwards in the order of `order`, and `before`, the sum of `value` over the
    rows of smaller rank, as a decimal.

    Rows are summed in pieces of SUMMED_AT_ONCE; only the sums of pieces, one row each, are gone
    through in one task.
    """
    ranked = dense_index(df, order, rank).withColumn("_piece", F.floor(F.col(rank) / SUMMED_AT_ONCE))
    stored = materialize(ranked, "ranked")
    earlier = (Window.unboundedPreceding, -1)
    pieces = stored.groupBy("_piece").agg(F.sum(F.col(value).cast(WIDE)).alias("_sum")).select(
        "_piece",
        F.coalesce(F.sum("_sum").over(Window.orderBy("_piece").rowsBetween(*earlier)), F.lit(0)).cast(WIDE).alias("_offset"),
    )
    within = Window.partitionBy("_piece").orderBy(rank).rowsBetween(*earlier)
    local = F.coalesce(F.sum(F.col(value).cast(WIDE)).over(within), F.lit(0)).cast(WIDE)
    return (
        stored.withColumn("_local", local)
        .join(pieces, "_piece")
        .withColumn(before, (F.col("_offset") + F.col("_local")).cast(WIDE))
        .drop("_piece", "_offset", "_local")
    )


def _passed(marks: DataFrame, at: str, points: DataFrame, place: str, rank: str) -> DataFrame:
    """`points` with `passed`: how many of `marks` lie at or before each point.

    Both are sorted together; a point's place among all, less its own rank among the points,
    is the number of marks that come before.
    """
    both = marks.select(F.col(at).alias("x"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("of")).unionByName(
        points.select(F.col(place).alias("x"), F.lit(1).alias("kind"), F.col(rank).alias("of"))
    )
    merged = dense_index(both, [F.col("x"), F.col("kind"), F.col("of")], "_at")
    counts = merged.where("kind = 1").select(F.col("of").alias(rank), (F.col("_at") - F.col("of")).alias("passed"))
    return points.join(counts, rank)


def alias_table(weights: DataFrame) -> DataFrame:
    """(slot, word_id, threshold, alias): draw a slot evenly, then take its word if a draw of
    32 bits is below `threshold`, else its alias; words come in proportion to their weight.

    `weights` has word_id, which is unique, and weight, a positive whole number. All words have
    a slot of the same size. What light words leave free in theirs is laid end to end on a
    line, and what heavy words have too much on another; a light word's alias is the heavy word
    at the same place. A heavy word whose excess ends within a light word's free space gave
    too much there, and gets that much from the next heavy word. So the table comes from
    running sums and two merges, and no task goes through the vocabulary.
    """
    count, total = weights.agg(F.count("*"), F.sum(F.col("weight").cast(WIDE))).first()
    if not count:
        return weights.sparkSession.createDataFrame([], "slot long, word_id long, threshold long, alias long")
    excess = (F.col("weight").cast(WIDE) * count - F.lit(total).cast(WIDE)).cast(WIDE)
    slots = materialize(
        dense_index(weights.select("word_id", "weight"), [F.col("word_id")], "slot").withColumn("excess", excess), "slots"
    )
    by_id = [F.col("word_id")]
    light = materialize(
        running_sums(slots.where("excess < 0").withColumn("size", -F.col("excess")), by_id, "size", "rank", "before"), "light"
    ).withColumn("after", (F.col("before") + F.col("size")).cast(WIDE))
    heavy = materialize(
        running_sums(slots.where("excess > 0").withColumn("size", F.col("excess")), by_id, "size", "rank", "before"), "heavy"
    ).withColumn("after", (F.col("before") + F.col("size")).cast(WIDE))
    named = heavy.select(F.col("rank").alias("giver"), F.col("word_id").alias("alias"))
    filled = (
        _passed(heavy, "after", light, "before", "rank")
        .withColumn("giver", F.col("passed"))
        .join(named, "giver")
        .select("slot", "word_id", (F.lit(total).cast(WIDE) - F.col("size")).cast(WIDE).alias("own"), "alias")
    )
    crossed = light.select(F.col("rank").alias("passed"), F.col("before").alias("from"), F.col("after").alias("until"))
    gave = (
        _passed(light, "after", heavy, "after", "rank")
        .join(crossed, "passed", "left")
        .withColumn("over", F.when(F.col("from") < F.col("after"), F.col("until") - F.col("after")))
        .withColumn("giver", F.col("rank") + 1)
        .join(named, "giver", "left")
        .select(
            "slot", "word_id",
            (F.lit(total).cast(WIDE) - F.coalesce("over", F.lit(0))).cast(WIDE).alias("own"),
            F.when(F.col("over").isNotNull(), F.col("alias")).otherwise(F.col("word_id")).alias("alias"),
        )
    )
    even = slots.where("excess = 0").select(
        "slot", "word_id", F.lit(total).cast(WIDE).alias("own"), F.col("word_id").alias("alias")
    )
    threshold = F.expr(f"cast(own * cast({DRAW} as decimal(11,0)) div cast({total} as decimal(38,0)) as bigint)")
    return filled.unionByName(gave).unionByName(even).select(
        "slot", F.col("word_id").cast("long").alias("word_id"), threshold.alias("threshold"), F.col("alias").cast("long").alias("alias")
    )


def negative_samples(
    rows: DataFrame, keys: list[str], center: str, alias: DataFrame, count: int = 5, seed: str = "negatives"
) -> DataFrame:
    """(*keys, center, draw, negative): `count` words drawn for each row from an alias table.

    `keys` identify a row. A draw that gives the centre itself is left out. Slots are drawn
    evenly, so the join with the table has no hot key, however frequent a word is.
    """
    slots = alias.count()
    if not slots:
        return rows.select(*keys, F.col(center).alias("center"), F.lit(0).alias("draw"), F.lit(0).cast("long").alias("negative")).limit(0)
    drawn = rows.select(*keys, F.col(center).alias("center"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("draw"))
    key = [*map(F.col, keys), F.col("draw")]
    asked = drawn.withColumn("slot", draw(f"{seed}/slot", *key, digits=15) % slots).withColumn(
        "_u", draw(f"{seed}/side", *key)
    )
    if slots <= SENT_SLOTS:
        named = _named_by_blocks(asked, alias)
    else:
        named = asked.join(alias, "slot")
    word = F.when(F.col("_u") < F.col("threshold"), F.col("word_id")).otherwise(F.col("alias"))
    return named.select(*keys, "center", "draw", word.alias("negative")).where(F.col("negative") != F.col("center"))


def _named_by_blocks(asked: DataFrame, alias: DataFrame) -> DataFrame:
    """`asked` with the row of `alias` for its slot, of a table that fits in every task: the draws, which
    are many times as many as the texts' words, stay where they are."""
    fields = ["threshold", "word_id", "alias"]
    listed = F.sort_array(F.collect_list(F.struct("slot", *fields)))
    packed = alias.groupBy(F.floor(F.col("slot") / PACKED_SLOTS).alias("_block")).agg(listed.alias("_l")).select(
        "_block", *(F.col(f"_l.{f}").alias(f"_{f}") for f in fields)
    )
    place = (F.col("slot") % PACKED_SLOTS).cast("int")
    found = asked.withColumn("_block", F.floor(F.col("slot") / PACKED_SLOTS)).join(F.broadcast(packed), "_block")
    return found.select(*asked.columns, *(F.col(f"_{f}")[place].alias(f) for f in fields))
