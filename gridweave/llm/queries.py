"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridweave.llm import (
    infill,
    language,
    merkle,
    mixing,
    packing,
    pii,
    quality,
    rules,
    secret_scan,
    simhash,
    topk,
    vectors,
    warc,
)
from gridweave.llm.common import read_table
from gridweave.llm.oracles import ORACLES  # noqa: F401  the queries' SQL goes with them


def op1_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read_table(spark, sf_dir, "documents")).drop("rejected_by")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read_table(spark, sf_dir, "pages")).drop("payload")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.copies(docs, keep=["doc_id"]).select(
        "row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_components(read_table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), with_ids=False)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read_table(spark, sf_dir, "documents")).drop("n_spans")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.infill(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(), 256).alias("restored_sha256"),
    )


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_rules": op1_rules,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op5_secrets": op5_secrets,
    "op6_mixing": op6_mixing,
    "op7_vectors": op7_vectors,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
    "op11_infill": op11_infill,
    "op12_topk": op12_topk,
    "op13_merkle": op13_merkle,
}
