"""Alias tables, skip-gram pairs, co-occurrence and vectors from counts, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridweave as gw
from gridweave.operators import cooccurrence, sampling
from tests.conftest import SF_SMALL
from workload import fixtures as fx

HALF = 1 << 32


def shares(table):
    """What each word gets, in units of a slot's draws."""
    got = {}
    for r in table:
        got[r["word_id"]] = got.get(r["word_id"], 0) + r["threshold"]
        if r["threshold"] < HALF:
            got[r["alias"]] = got.get(r["alias"], 0) + HALF - r["threshold"]
    return got


WEIGHTS = {
    "one": [5],
    "equal": [7] * 12,
    "two": [1, 3],
    "one heavy": [1] * 40 + [1000],
    "heavy first": [1000] + [1] * 40,
    "exact ends": [1, 3, 1, 3, 2, 2, 4, 0 + 1, 1, 2],
    "mixed": [random.Random(4).randrange(1, 10 ** random.Random(i).randrange(1, 7)) for i in range(300)],
}


@pytest.mark.parametrize("name", WEIGHTS)
def test_alias_table_keeps_weights(spark, monkeypatch, name):
    monkeypatch.setattr(sampling, "SUMMED_AT_ONCE", 16)
    weights = WEIGHTS[name]
    df = spark.createDataFrame([(i + 4, w) for i, w in enumerate(weights)], "word_id long, weight long")
    table = gw.alias_table(df.repartition(3)).collect()
    assert sorted(r["slot"] for r in table) == list(range(len(weights)))
    assert all(0 <= r["threshold"] <= HALF for r in table)
    got = shares(table)
    for i, w in enumerate(weights):
        want = w * len(weights) * HALF / sum(weights)
        assert abs(got.get(i + 4, 0) - want) <= 2 * len(weights), (i, w)
    assert gw.alias_table(df.limit(0)).collect() == []


def test_negatives_follow_the_weights(spark):
    df = spark.createDataFrame([(4, 10), (5, 30), (6, 60)], "word_id long, weight long")
    rows = spark.range(20_000).withColumn("center", F.lit(99))
    drawn = gw.negative_samples(rows, ["id"], "center", gw.alias_table(df), 2)
    counts = {r["negative"]: r["count"] for r in drawn.groupBy("negative").count().collect()}
    assert sum(counts.values()) == 40_000
    for word, share in ((4, 0.1), (5, 0.3), (6, 0.6)):
        assert abs(counts[word] / 40_000 - share) < 0.01
    again = gw.negative_samples(rows.repartition(5), ["id"], "center", gw.alias_table(df), 2)
    assert drawn.exceptAll(again).isEmpty()
    same = gw.negative_samples(rows.withColumn("center", F.lit(6)), ["id"], "center", gw.alias_table(df), 2)
    assert same.where("negative = center").isEmpty() and same.count() == 40_000 - counts[6]
    assert gw.negative_samples(rows, ["id"], "center", gw.alias_table(df.limit(0))).collect() == []


def test_pairs_lie_in_windows(spark):
    dictionary = spark.createDataFrame([("a", 10, 4), ("b", 8, 5), ("c", 6, 6), ("[UNK]", 0, 0)], "word string, cnt long, word_id long")
    texts = ["a b x c a", "b", "", None, "c a b a c b a x x b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    words = gw.kept_words(rows, ["id"], gw.tokenize(F.col("text")), dictionary, 10.0, "s").collect()
    ids = {"a": 4, "b": 5, "c": 6}
    kept = [(i, p, ids[w]) for i, t in enumerate(texts) if t for p, w in enumerate(t.split()) if w in ids]
    assert sorted(map(tuple, words)) == sorted(kept)
    got = gw.skipgram_pairs(rows, ["id"], gw.tokenize(F.col("text")), dictionary, 2, 10.0, "s").collect()
    widths = {}
    for r in got:
        widths[r["id"], r["pos"]] = max(widths.get((r["id"], r["pos"]), 0), abs(r["step"]))
    assert set(widths.values()) == {1, 2}
    for i, t in enumerate(texts):
        line = [(p, w) for j, p, w in kept if j == i]
        for at, (p, w) in enumerate(line):
            mine = {(r["step"], r["center"], r["context"]) for r in got if (r["id"], r["pos"]) == (i, p)}
            width = widths.get((i, p), 0)
            assert mine == {(d, w, line[at + d][1]) for d in range(-width, width + 1) if d and 0 <= at + d < len(line)}
    none = gw.kept_words(rows, ["id"], gw.tokenize(F.col("text")), dictionary, 0.0, "s")
    assert none.isEmpty()


def corpus(n=60):
    rng = random.Random(2)
    return [[rng.choice([0, 4, 4, 5, 6, 7, 8, 9, 10, 11]) for _ in range(rng.randrange(0, 30))] for _ in range(n)]


def dense_ppmi(texts, window):
    counts = np.zeros((8, 8))
    for ids in texts:
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if i != j and abs(i - j) <= window and a >= 4 and b >= 4:
                    counts[a - 4, b - 4] += 1
    sums = counts.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.log(counts * counts.sum() / np.outer(sums, sums))
    return counts, np.where(counts > 0, np.maximum(value, 0), 0)


def test_ppmi_by_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, ids array<int>")
    counts, value = dense_ppmi(texts, 3)
    got = {(r["word_id"] - 4, r["context_id"] - 4): r["n"] for r in gw.cooccurrences(df, 3).collect()}
    assert got == {(i, j): counts[i, j] for i, j in zip(*np.nonzero(counts), strict=True)}
    found = gw.positive_pmi(gw.cooccurrences(df, 3)).collect()
    assert len(found) == (value > 0).sum()
    for r in found:
        assert math.isclose(r["value"], value[r["word_id"] - 4, r["context_id"] - 4], rel_tol=1e-12)
    assert gw.positive_pmi(gw.cooccurrences(df.limit(0), 3)).collect() == []


@pytest.mark.parametrize("block", [7, 64, 16_384])
def test_factors_are_numpys(spark, block):
    """Eigenvalues, and the matrix that the eigenvectors make, in blocks of several sizes."""
    rng = np.random.default_rng(0)
    words, size = 50, 6
    x = rng.normal(size=(words, size)) * np.array([9, 7, 5, 4, 3, 2])
    dense = x @ np.diag([1, -1, 1, 1, -1, 1]) @ x.T
    dense[11, :] = dense[:, 11] = 0
    entries = [(i + 4, j + 4, float(dense[i, j])) for i in range(words) for j in range(words) if dense[i, j]]
    df = spark.createDataFrame(entries, "word_id long, context_id long, value double").repartition(3)
    basis, values = gw.factorize(df, words, size, rounds=10, block=block)
    want = np.linalg.eigvalsh(dense)
    want = want[np.argsort(-np.abs(want))][:size]
    assert np.allclose(values, want, rtol=1e-8)
    rows = sorted(basis.collect())
    assert [len(r["basis"]) // (8 * size) for r in rows] == [min(block, words - b) for b in range(0, words, block)]
    q = np.vstack([cooccurrence._unpacked(r["basis"], size) for r in rows])
    assert np.allclose(q.T @ q, np.eye(size), atol=1e-9)
    assert np.allclose(q @ np.diag(values) @ q.T, dense, atol=1e-6)


def test_vectors_of_all_words(spark):
    words = spark.createDataFrame([(f"w{i}", 9, i) for i in range(12)], "word string, cnt long, word_id long")
    entries = spark.createDataFrame([(4, 5, 2.0), (5, 4, 2.0), (6, 6, 3.0)], "word_id long, context_id long, value double")
    got = {r["word_id"]: np.array(r["vector"]) for r in gw.count_vectors(words, entries, 3, block=3).collect()}
    assert sorted(got) == list(range(4, 12)) and all(len(v) == 3 for v in got.values())
    assert np.allclose(got[6] @ got[6], 3) and np.allclose(got[11], 0, atol=1e-9) and abs(got[6] @ got[4]) < 1e-9
    none = gw.count_vectors(words.limit(0), entries.limit(0), 3)
    assert none.collect() == []


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_search_by_id_reaches_the_scans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)  # or the plan's text is cut
    nodes, edges = gw.search_graph_by_id(*fx.id_only_graph(spark, SF_SMALL), gid=7, batch=2)
    assert "StringStartsWith(id,7-)" in plan(nodes) and "StringStartsWith(id,8-)" in plan(nodes)
    for column in ("src", "dst"):
        assert f"StringStartsWith({column},7-)" in plan(edges) and f"StringStartsWith({column},8-)" in plan(edges)
    whole = gw.search_graph(*fx.order_graph(spark, SF_SMALL), gid=7, batch=2)
    assert sorted(r["id"] for r in nodes.collect()) == sorted(r["id"] for r in whole[0].collect())
    assert edges.count() == whole[1].count() > 0


def test_draws_do_not_gather_words(spark):
    """Neither pairs nor negatives shuffle by word: the join is by slot, the window by text."""
    rows = spark.createDataFrame([(1, "a b a")], "id long, text string")
    dictionary = spark.createDataFrame([("a", 10, 4), ("b", 8, 5)], "word string, cnt long, word_id long")
    shuffles = [s for s in plan(gw.skipgram_pairs(rows, ["id"], gw.tokenize(F.col("text")), dictionary)).split("\n") if "hashpartitioning" in s]
    assert shuffles and all("id#" in s.split("hashpartitioning(")[1] for s in shuffles)
