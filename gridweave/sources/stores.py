"""Stores: graph tables, text corpus, dictionary, word vectors."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridweave.functions.nodes import parse_node_id
from gridweave.operators.vocabulary import number_words
from gridweave.operators.skipgram import WordVectors
from gridweave.schemas import EDGE_SCHEMA, FIRST_WORD_ID, NODE_SCHEMA


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def write_graph(
    graph: Graph, path: str, count: DataFrame | None = None, in_order: bool = False
) -> None:
    """Node and edge tables under `path`, ordered by graph, so that the row-group
    statistics skip what a search by `gid` does not need.

    The range key goes down to the node, so one large graph spreads over files. With
    `in_order` the rows are written as they come, without a shuffle or a sort: for graphs of
    tables that lie in the order of `gid`, as `assign_gid` leaves them.
    `count` is the one-row frame of `graph_count`; it lands in the `numid.txt` folder.
    """
    for rows, name, keys in [
        (graph.nodes, "node", ["gid", "row", "col"]),
        (graph.edges, "edge", ["gid", "src", "dst"]),
    ]:
        placed = rows if in_order else rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        placed.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    if count is not None:
        write_graph_count(count, path)


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(
        spark.read.schema(NODE_SCHEMA).parquet(f"{path}/node.parquet"),
        spark.read.schema(EDGE_SCHEMA).parquet(f"{path}/edge.parquet"),
    )


def read_id_only_graph(spark: SparkSession, path: str) -> Graph:
    """A store whose nodes carry (id, type, text) and whose edges carry (src, dst, type).

    `search_graph_by_id` finds graphs in it; `node_positions` and `edge_positions` add what
    the other operators need.
    """
    nodes = spark.read.schema("id string, type string, text string").parquet(
        f"{path}/node.parquet"
    )
    edges = spark.read.schema("src string, dst string, type string").parquet(
        f"{path}/edge.parquet"
    )
    return Graph(
        nodes.select(parse_node_id(F.col("id")).alias("_at"), "*").select(
            "_at.gid", "_at.row", "_at.col", "id", "type", "text"
        ),
        edges.select(parse_node_id(F.col("src"))["gid"].alias("gid"), "src", "dst", "type"),
    )


def write_id_only_graph(graph: Graph, path: str, in_order: bool = False) -> None:
    """The store without numbers, (id, type, text) and (src, dst, type), sorted by id within
    its files, so that a search by prefix skips row groups.

    With `in_order` the rows are written as they come, as in `write_graph`. Neighbours by
    number mostly share a prefix, so that row groups are skipped as well."""
    for rows, name, keys in [
        (graph.nodes.select("id", "type", "text"), "node", ["id"]),
        (graph.edges.select("src", "dst", "type"), "edge", ["src", "dst"]),
    ]:
        placed = rows if in_order else rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        placed.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def write_graph_count(count: DataFrame, path: str) -> None:
    """`count` has one row with the column `num`."""
    line = count.select(F.col("num").cast("string").alias("value"))
    line.coalesce(1).write.mode("overwrite").text(f"{path}/numid.txt")


def read_graph_count(spark: SparkSession, path: str) -> DataFrame:
    """Works for a folder as written here and for a single file."""
    return spark.read.text(f"{path}/numid.txt").select(
        F.trim("value").cast("long").alias("num")
    )


def write_corpus(texts: DataFrame, path: str, format: str = "parquet") -> None:
    """The `text` column alone. CSV loses empty strings and splits texts at line
    breaks when read back; Parquet keeps both."""
    texts.select("text").write.mode("overwrite").format(format).save(path)


def read_corpus(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema("text string").format(format).load(path)


def read_corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every physical line of a text corpus, CSV quoting left in."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """Lines `word count`; special words are implied and not written."""
    dictionary.where(F.col("word_id") >= FIRST_WORD_ID).select(
        F.concat_ws(" ", "word", "cnt").alias("value")
    ).write.mode("overwrite").text(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Ids follow from the counts, so they do not depend on the order of the files."""
    parts = F.split("value", " ")
    return number_words(
        spark.read.text(path).select(
            parts[0].alias("word"), parts[1].cast("long").alias("cnt")
        )
    )


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Any word vectors, (word_id, word, vector), as a table; `count_vectors` gives such."""
    vectors.select("word_id", "word", "vector").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word_id long, word string, vector array<double>").parquet(path)


def write_word_vectors(model: WordVectors, path: str) -> None:
    """The vectors of a fit as a table (word, vector)."""
    model.getVectors().write.mode("overwrite").parquet(f"{path}/vectors")


def read_word_vectors(path: str) -> WordVectors:
    spark = SparkSession.getActiveSession()
    return WordVectors(spark.read.schema("word string, vector array<double>").parquet(f"{path}/vectors"))
