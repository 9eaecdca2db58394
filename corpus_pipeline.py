"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the
last return the columns of documents.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gridweave.llm import mixing, packing, pii, quality, simhash  # noqa: E402
from gridweave.llm.common import prepare, read_table  # noqa: E402
from gridweave.session import materialize  # noqa: E402


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents that the quality classifier rejects."""
    prepare(spark)
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def single_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints, of four words, differ in at most four bits."""
    prepare(spark)
    return simhash.drop_near_duplicates(docs, near=simhash.Near(words=4, distance=4))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels in place of personal data, plain or in disguise."""
    prepare(spark)
    return pii.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source near its share of words; a document as often as it is taken."""
    prepare(spark)
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences whose lengths are powers of two."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_documents),
    ("near-duplicates", single_documents),
    ("personal data", without_personal_data),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

# Tokens, fingerprints and a fitted classifier have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written out and read again for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
