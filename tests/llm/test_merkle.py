"""The manifest against a plain recursion, in buckets of few levels, and its proofs."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from tests.llm.test_edges import none, odd  # noqa: F401

from gridweave.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """Root of a list of digests and the steps (sibling or None, is it on the left) of each."""
    nodes, paths, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            other = place ^ 1
            paths[i].append((nodes[other] if other < len(nodes) else None, other < place))
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        at = [place // 2 for place in at]
    return nodes[0], paths


def fold(leaf, path):
    for other, left in path:
        leaf = sha(leaf) if other is None else sha(other + leaf) if left else sha(leaf + other)
    return leaf


def first(x):
    return (x is not None, x)


def digest(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute(docs):
    """docs: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for d in docs:
        by.setdefault(d[2], []).append((first(d[0]), digest(*d), d))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda x: x[:2])
        trees[lang] = tree([leaf for _, leaf, _ in by[lang]])
    root, above = tree([trees[lang][0] for lang in langs])
    out = []
    for lang, up in zip(langs, above, strict=True):
        subroot, paths = trees[lang]
        for (_, leaf, d), path in zip(by[lang], paths, strict=True):
            path = path + up
            claimed = leaf
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 and d[3] is not None:
                claimed = digest(d[0], d[1], d[2], d[3] + 1, d[4])
            end = fold(claimed, path)
            out.append((d[0], leaf, subroot, root, sha("".join(o for o, _ in path if o)), end, end == root))
    return sorted(out, key=repr)


def given(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string")


@pytest.mark.parametrize("span", [1, 2, 10])
def test_bands_join_up(spark, span):
    docs = [(i, "s", lang, i, f"text {i}") for lang, n in (("a", 21), ("b", 1), ("c", 8), (None, 5), ("é", 2)) for i in range(n)]
    got = merkle.tampered_manifest(given(spark, docs).repartition(4), span=span)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs)


@pytest.mark.parametrize("leaves", [1, 2, 3, 1023, 1024, 1025])
def test_sizes_around_a_bucket(spark, leaves):
    docs = [(i, None, "x", i, str(i)) for i in range(leaves)]
    got = merkle.tampered_manifest(given(spark, docs))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs)


def test_odd_rows(odd, none):  # noqa: F811
    got = sorted(map(tuple, merkle.tampered_manifest(odd).collect()), key=repr)
    docs = [tuple(r[c] for c in merkle.COLUMNS) for r in odd.collect()]
    assert got == brute(docs)
    assert merkle.tampered_manifest(none).collect() == []


def test_tampering_is_seen(spark):
    docs = [(i, "s", f"l{i % 3}", None if i % 5 == 0 else i, "t") for i in range(200)]
    got = {r["doc_id"]: r for r in merkle.tampered_manifest(given(spark, docs)).collect()}
    for i, _, _, n, _ in docs:
        touched = zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        assert got[i]["verified"] != touched
        assert (got[i]["folded_root"] == got[i]["root"]) == got[i]["verified"]


def test_manifest_keeps_columns_and_proofs(spark):
    rows = [(i % 4, f"g{i % 3}", sha(str(i)), f"extra {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, tree string, lo string, proof string")
    got = merkle.manifest(df.withColumnRenamed("proof", "kept"), "id", "tree", "lo", ["kept"])
    assert got.columns.count("tree") == 2 and got.count() == 40
    plain = merkle.manifest(
        df.select(F.col("id").alias("key"), F.col("tree").alias("name"), F.col("lo").alias("leaf"), F.col("proof").alias("kept")),
        "key", "name", "leaf", ["kept"],
    ).collect()
    assert sorted((r["key"], r["name"], r["leaf"], r["kept"]) for r in plain) == sorted(rows)
    for r in plain:
        assert merkle.fold(r["leaf"].encode(), bytes(r["proof"])).decode() == r["root"]
        assert merkle.fold(sha("other").encode(), bytes(r["proof"])).decode() != r["root"]


def test_repeated_rows_are_leaves_each(spark):
    docs = [(7, "s", "en", 1, "same")] * 3000 + [(8, "s", "en", 1, "x")]
    got = merkle.tampered_manifest(given(spark, docs).repartition(4)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs)
