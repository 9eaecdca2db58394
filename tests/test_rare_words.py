"""Word counts behind a counting filter: exact rows, fewer bytes shuffled."""

import uuid

import pytest
from pyspark.sql import functions as F

import gridweave as gw
from gridweave.operators import rare_words
from tests.conftest import SF_CHECK


def corpus(spark, texts, parts=4):
    return spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)


def rows(frame):
    return sorted(map(tuple, frame.collect()))


TEXTS = [
    "a b c a", "b a, (d) \"e\"", None, "", "x" * 3000 + " a", "ä ß ä ß 好", "ä ß 好 好", "a b c d e f g h",
    "é " * 2000, "\x00 \x01 a", "[SEP] [MASK] [PAD]",
]


@pytest.mark.parametrize("more_than", [0, 1, 3, 254, 255, 1999])
@pytest.mark.parametrize("cells", [64, 1 << 12, 1 << 18])
def test_same_rows_as_plain_counts(spark, more_than, cells):
    docs = corpus(spark, TEXTS * 2)
    plain = gw.word_counts(docs).where(F.col("cnt") > more_than)
    assert rows(gw.frequent_word_counts(docs, more_than, cells)) == rows(plain)


def test_no_rows(spark):
    assert gw.frequent_word_counts(corpus(spark, ["a"]).where("false"), cells=64).collect() == []


@pytest.mark.parametrize("cells", [0, 32, 100])
def test_cells_are_a_power_of_two(spark, cells):
    with pytest.raises(ValueError):
        gw.frequent_word_counts(corpus(spark, ["a"]), cells=cells)


def test_filter_is_the_same_for_any_partitioning(spark):
    cells = spark.range(30_000).select(F.xxhash64("id").bitwiseAND(F.lit(0x1FFFF)).alias("cell"))
    seen = set()
    for parts in (1, 7, 40):
        counted = rare_words.cell_counts(cells.repartition(parts), 1 << 17, 1)
        blocks = rare_words.passing_cells(counted, 1 << 17, 1)
        seen.add(tuple(sorted((b.block, tuple(b.words)) for b in blocks.collect())))
    assert len(seen) == 1
    expected = {r.cell for r in cells.groupBy("cell").count().where("count > 1").collect()}
    bits = {
        block * 65536 + 64 * i + k for block, words in seen.pop() for i, w in enumerate(words) for k in range(64) if w >> k & 1
    }
    assert bits == expected


def shuffled(spark, frame):
    """Bytes that the jobs of `frame` write to shuffles."""
    spark.sparkContext.setJobGroup(group := uuid.uuid4().hex, group)
    try:
        frame().write.format("noop").mode("overwrite").save()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    store, tracker = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    total = 0
    for s in stages:
        attempts = store.stageData(s, False, spark._jvm.java.util.ArrayList(), False, spark._sc._gateway.new_array(spark._jvm.double, 0))
        total += sum(attempts.apply(i).shuffleWriteBytes() for i in range(attempts.size()))
    return total


def test_fewer_bytes_are_shuffled(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("text").repartition(8)
    docs = gw.materialize(docs, "rare-word-corpus")
    plain = shuffled(spark, lambda: gw.word_counts(docs).where("cnt > 3"))
    cut = shuffled(spark, lambda: gw.frequent_word_counts(docs))
    print(f"\nshuffled bytes: {plain} counted plainly, {cut} behind the filter")
    assert 0 < cut < plain


def test_the_second_pass_stays_in_the_jvm(spark):
    frame = gw.frequent_word_counts(corpus(spark, TEXTS), cells=1 << 12)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "partial_count" in plan
