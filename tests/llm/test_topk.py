"""Top-k search against plain inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.llm import topk

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int, query_id long, block int, weights int"
EXTRA = (1, "s", 2, 3, 4, 5)


def whole(vector):
    if vector is None or None in vector or not all(map(math.isfinite, vector)):
        return None
    return [math.floor(64 * float(np.float32(x))) for x in vector]


def brute(rows, k):
    ready = [(i, w) for i, w in ((i, whole(v)) for i, v in rows) if w is not None]
    asking = {(i, tuple(w)) for i, w in ready if i is not None and i % 20 == 0}
    out = []
    for i, q in asking:
        scored = [(sum(a * b for a, b in zip(q, w, strict=False)), j) for j, w in ready if j != i]
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(i, n, j, s) for n, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def found(spark, rows, k=20, block=topk.BLOCK):
    df = spark.createDataFrame([(i, v, *EXTRA) for i, v in rows], SCHEMA).repartition(3)
    got = topk.search(df, F.col("vec_id") % 20 == 0, k=k, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def vectors(seed, n, width, zeros):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) / math.sqrt(width)
    x[rng.random(x.shape) < zeros] = 0
    return [(i, row.tolist()) for i, row in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("zeros", [0.0, 0.45, 0.9])
@pytest.mark.parametrize("block", [7, 100, 8192])
def test_against_brute_force(spark, zeros, block):
    rows = vectors(block, 300, 12, zeros)
    assert found(spark, rows, block=block) == brute(rows, 20)


def test_odd_rows(spark):
    rows = [
        (0, [0.5, 0.25]), (20, [0.5, 0.25]), (20, [0.5, 0.25]), (20, [-0.1, 0.3]), (40, None), (60, [None, 0.1]),
        (80, [NAN, 0.1]), (100, [INF, 0.1]), (120, []), (140, [0.0, 0.0]), (-20, [0.9]), (3, [0.5, 0.25, 0.7]),
        (4, [0.5, 0.25]), (4, [0.5, 0.25]), (None, [0.5, 0.25]), (None, None), (5, [1000.0, -1000.0]),
    ]
    assert found(spark, rows, 4) == brute(rows, 4)
    assert found(spark, rows, 100) == brute(rows, 100)
    assert found(spark, rows, 3, block=2) == brute(rows, 3)
    assert found(spark, []) == [] and found(spark, [(1, [0.5])]) == [] and found(spark, [(20, [0.5])]) == []


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [0.5, 0.5]) for i in range(100, 160)]
    got = found(spark, rows, 5, block=9)
    assert [r[2] for r in got if r[0] == 100] == [101, 102, 103, 104, 105]
    assert got == brute(rows, 5)


def test_many_copies_spread(spark):
    """A vector that most rows share is dealt to all blocks."""
    df = spark.createDataFrame([(i, [0.25, -0.5]) for i in range(2000)], "vec_id long, embedding array<double>")
    stored = topk.whole_vectors(df.repartition(4))
    sizes = stored.groupBy(F.pmod(F.xxhash64("part", "row"), F.lit(8))).count().toPandas()["count"]
    assert len(sizes) == 8 and sizes.max() < 400


def test_large_whole_numbers(spark):
    rows = [(20, [1e6, -2e6]), (1, [3e6, 1e6]), (2, [-1e6, 1e5])]
    assert found(spark, rows) == brute(rows, 20)
    with pytest.raises(Exception, match="long"):
        found(spark, [(20, [1e16]), (1, [1e16])])
