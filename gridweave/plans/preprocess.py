"""Record files -> graph store and corpus; corpus -> dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.operators.numbering import number_in_input_order
from gridweave.operators.tables import filter_table_size, graph_count, table_edges, table_nodes
from gridweave.operators.vocabulary import build_dictionary, word_counts
from gridweave.schemas import TABLE_SIZE_LIMIT
from gridweave.sources import interactions, stores


def numbered_tables(
    spark: SparkSession, path: str, limit: int = TABLE_SIZE_LIMIT, mode: str = "failfast"
) -> DataFrame:
    """Tables of the record files below the size limit, numbered in input order."""
    records = interactions.parse_interactions(interactions.read_lines(spark, path), mode)
    tables = filter_table_size(interactions.table_texts(records), limit)
    return number_in_input_order(tables)


def build_graph(tables: DataFrame, dangling: bool = True) -> stores.Graph:
    return stores.Graph(table_nodes(tables), table_edges(tables, dangling))


def build_stores(
    spark: SparkSession, records_path: str, out_path: str, corpus_format: str = "parquet"
) -> None:
    """Write node and edge tables, the text corpus and the number of tables."""
    tables = numbered_tables(spark, records_path)
    graph = build_graph(tables)
    stores.write_graph(graph, out_path, graph_count(tables))
    stores.write_corpus(graph.nodes, f"{out_path}/text", corpus_format)


def build_dictionary_file(
    spark: SparkSession, corpus_path: str, out_path: str, corpus_format: str = "parquet"
) -> None:
    counts = word_counts(stores.read_corpus(spark, corpus_path, corpus_format))
    stores.write_dictionary(build_dictionary(counts), out_path)
