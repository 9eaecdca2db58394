"""Registered queries against their SQL, and the plans they must have."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import gridweave as gw
from tests.conftest import SF_SMALL
from workload import fixtures as fx
from workload.catalog import QUERIES
from workload.check import connect, difference
from workload.oracles import ORACLES


@pytest.fixture(scope="module")
def connection():
    return connect(SF_SMALL)


def test_entry(spark):
    counts = {r.type: r.n for r in contract.entry(spark).collect()}
    assert counts["VH"] == counts["Caption"] == 1500 and counts["H"] == 6000
    assert counts["VE"] == 6000 and counts["Cell"] == 24000


def test_sql_belongs_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ORACLES)
def test_same_as_sql(spark, connection, name):
    assert difference(spark, connection, name, SF_SMALL) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_search_reaches_the_scan(spark):
    nodes, edges = gw.search_graph(*fx.order_graph(spark, SF_SMALL), gid=7)
    for frame in (nodes, edges):
        assert "GreaterThanOrEqual(gid,7), LessThanOrEqual(gid,7)" in plan(frame)


def test_building_and_channels_need_no_shuffle(spark):
    tables, graph = fx.order_tables(spark, SF_SMALL), fx.order_graph(spark, SF_SMALL)
    related = gw.edge_relations(*graph)
    masked = gw.masked_relations(related, fx.MASKING)
    for frame in (gw.table_nodes(tables), gw.table_edges(tables), gw.relation_channels(related), masked):
        assert "Exchange" not in plan(frame) and "Python" not in plan(frame)


def test_text_columns_alone_are_read(spark):
    scan = plan(gw.table_edges(fx.order_tables(spark, SF_SMALL)))
    assert "questions" not in scan.split("ReadSchema")[1]


def test_counts_are_summed_before_the_shuffle(spark):
    assert "partial_count" in plan(gw.word_counts(fx.documents(spark, SF_SMALL)))


def test_attention_shuffles_by_graph_only(spark):
    features = spark.range(100).select(
        (F.col("id") % 5).alias("gid"), "id", F.array(F.rand(1), F.rand(2)).alias("h")
    )
    related = features.select("gid", F.col("id").alias("src"), F.col("id").alias("dst"), F.array(F.lit(0)).alias("rels"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        heads, _ = gw.random_heads(1, 2, 2, 1)
        steps = plan(gw.attention_layer(features, related, heads)).split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = [line.split("hashpartitioning(")[1].split(",")[0:2] for line in steps if "Exchange" in line]
    assert keys and all(first.startswith("gid#") and second.strip().startswith("8)") for first, second in keys)
