"""The stages on whole tables, and what each decides."""

import pytest
from tests.conftest import SF_SMALL

import corpus_pipeline
from gridweave.llm import mixing, packing, pii, quality, simhash
from gridweave.llm.common import read_table


@pytest.fixture(scope="module")
def stages(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    out = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF_SMALL)
        out.append(after.toPandas())
        docs = spark.createDataFrame(out[-1]) if len(out) < 6 else after
    return out


def survivors(docs):
    """The smallest id of each group of documents, found by comparing all fingerprints."""
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    near = {i: [j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4] for i in prints}
    root, seen = set(), set()
    for i in sorted(prints):
        if i not in seen:
            root.add(i)
            edge = [i]
            while edge:
                seen.update(edge)
                edge = [j for x in edge for j in near[x] if j not in seen]
    return root


def test_columns(stages):
    for frame in stages[1:-1]:
        assert list(frame.columns) == list(stages[0].columns)


def test_stages_take_effect(spark, stages):
    docs, good, single, clean, mixed, packed = stages
    assert 0 < len(good) < len(docs)
    scores = quality.classify(spark.createDataFrame(docs), read_table(spark, SF_SMALL, "labels")).toPandas()
    assert set(good.doc_id) == set(scores.doc_id[scores.score >= 0.3])
    assert len(single) < len(good)
    assert set(single.doc_id) == survivors(good)
    assert set(clean.doc_id) == set(single.doc_id)
    assert all(pii.find_spans(t)[1] == [] for t in clean.text)
    assert (clean.n_chars == clean.text.str.len()).all()
    words = clean.text.map(lambda t: len(t.encode().split())).sum()
    taken = mixed.text.map(lambda t: len(t.encode().split())).sum()
    assert abs(taken - words) < 0.05 * words
    assert mixed.groupby("doc_id").size().max() <= mixing.MOST_COPIES
    assert packed.groupby(["doc_id", "doc_tokens"]).length.sum().gt(0).all()
    assert packed.length.sum() == packed.drop_duplicates(["doc_id"]).set_index("doc_id").doc_tokens.mul(mixed.groupby("doc_id").size()).sum()
    assert (packed.ids.str.len() == 4 * packed.length).all() and packed.length.max() <= packing.LENGTH


def test_clean_documents_stay(stages):
    import pyarrow.parquet as pq

    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF_SMALL}/labels.parquet").to_pylist()}
    kept = set(stages[1].doc_id)
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert got.where("sequence_id is null or ids is null").isEmpty() and not got.isEmpty()
