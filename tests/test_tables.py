import pytest
from pyspark.sql import functions as F

import gridweave as gw
from gridweave.schemas import TABLE_SCHEMA

TABLES = {
    0: (["a", "b"], [["1", "2"], ["3"], ["4", "5", "6"]], ["q1", "q2"]),
    1: ([], [], []),
    2: (["a", "b", "c"], [], ["q"]),
    3: ([], [["x", "y"], []], []),
    11: (["a"], [["1"]], []),
}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(g, str(g), *t) for g, t in TABLES.items()]
    return spark.createDataFrame(rows, "gid long, " + TABLE_SCHEMA)


def expected_graph(gid, columns, rows, questions):
    nodes = {(0, 0): ("VH", "[VH]")} | {(0, c): ("H", t) for c, t in enumerate(columns, 1)}
    for r, cells in enumerate(rows, 1):
        nodes[r, 0] = ("VE", "[VE]")
        nodes |= {(r, c): ("Cell", t) for c, t in enumerate(cells, 1)}
    caption = (len(rows) + 1, 0)
    nodes[caption] = ("Caption", "[SEP]".join(questions))
    links = [((0, 0), (0, c), "VH", "H") for c in range(1, len(columns) + 1)]
    links += [((r, 0), (r, c), "VE", "Cell") for r, cells in enumerate(rows, 1) for c in range(1, len(cells) + 1)]
    links += [(caption, (0, 0), "Caption", "VH")]
    links += [(caption, (r, 0), "Caption", "VE") for r in range(1, len(rows) + 1)]
    links += [((0, c), (r, c), "H", "Cell") for c in range(1, len(columns) + 1) for r in range(1, len(rows) + 1)]
    name = lambda at: f"{gid}-{at[0]}-{at[1]}"
    edges = [(name(a), name(b), f"{x}-{y}") for a, b, x, y in links]
    edges += [(name(b), name(a), f"{y}-{x}") for a, b, x, y in links]
    return {(name(at), *v) for at, v in nodes.items()}, sorted(edges)


def test_nodes_and_edges(tables):
    nodes, edges = gw.table_nodes(tables).collect(), gw.table_edges(tables).collect()
    for gid, table in TABLES.items():
        want_nodes, want_edges = expected_graph(gid, *table)
        assert {(n.id, n.type, n.text) for n in nodes if n.gid == gid} == want_nodes
        assert sorted((e.src, e.dst, e.type) for e in edges if e.gid == gid) == want_edges


def test_positions_follow_rows_and_columns(tables):
    nodes, edges = gw.table_nodes(tables).collect(), gw.table_edges(tables).collect()
    for gid in TABLES:
        own = sorted((n for n in nodes if n.gid == gid), key=lambda n: (n.row, n.col))
        assert [n.pos for n in own] == list(range(len(own)))
    at = {n.id: n.pos for n in nodes}
    assert all((e.i, e.j) == (at.get(e.src), at.get(e.dst)) for e in edges)


def test_edges_without_node_can_be_left_out(tables):
    nodes, edges = gw.table_nodes(tables), gw.table_edges(tables)
    _, inner = gw.induced_subgraph(nodes, edges, F.lit(True))
    closed = gw.table_edges(tables, dangling=False)
    assert edges.count() - closed.count() == 2  # one missing cell in table 0
    assert inner.exceptAll(closed).isEmpty() and closed.exceptAll(inner).isEmpty()


def test_search_takes_no_neighbouring_number(tables):
    nodes, edges = gw.search_graph(gw.table_nodes(tables), gw.table_edges(tables), gid=1)
    assert {r.gid for r in nodes.collect()} == {1} and edges.count() == 2
    nodes, _ = gw.search_graph(gw.table_nodes(tables), gw.table_edges(tables), gid=1, batch=3)
    assert {r.gid for r in nodes.collect()} == {1, 2, 3}


@pytest.mark.parametrize("n_rows,n_cols,kept", [(30, 100, False), (2999, 1, True), (0, 5000, True), (5000, 0, True)])
def test_size_limit(spark, n_rows, n_cols, kept):
    frame = spark.range(1).select(
        F.array_repeat(F.lit("h"), n_cols).alias("columns"),
        F.array_repeat(F.array(F.lit("c")), n_rows).alias("rows"),
    )
    assert gw.filter_table_size(frame).count() == kept


def test_part_of_a_graph_is_numbered_anew(tables):
    nodes, edges = gw.induced_subgraph(
        gw.table_nodes(tables), gw.table_edges(tables), "type in ('VE', 'Cell')"
    )
    nodes = gw.node_positions(nodes)
    got = {(e.src, e.dst): (e.i, e.j) for e in gw.edge_positions(nodes, edges).collect()}
    at = {n.id: n.pos for n in nodes.collect()}
    assert sorted(p for i, p in at.items() if i.startswith("0-")) == list(range(9))
    assert got and all(got[s, d] == (at[s], at[d]) for s, d in got)


def test_blocks_hold_every_node_and_pair(tables):
    nodes, edges = gw.table_nodes(tables), gw.table_edges(tables, dangling=False)
    packed, adjacency = gw.graph_batch(nodes, edges.unionByName(edges), block=4)
    assert packed.agg(F.max(F.size("text"))).first()[0] == 4
    texts = {}
    for row in packed.orderBy("gid", "block").collect():
        texts.setdefault(row.gid, []).extend(row.text)
    want = {}
    for n in nodes.orderBy("gid", "pos").collect():
        want.setdefault(n.gid, []).append(n.text)
    assert texts == want
    pairs = [(r.gid, e.i, e.j) for r in adjacency.collect() for e in r.entries]
    assert sorted(pairs) == sorted((e.gid, e.i, e.j) for e in edges.collect())


def test_repeated_edges_become_one(tables):
    edges = gw.table_edges(tables)
    assert gw.distinct_edges(edges.unionByName(edges)).exceptAll(edges).isEmpty()


def test_numbers_are_dense_and_ordered(spark):
    frame = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("key"))
    rows = gw.dense_index(frame, [F.col("key").desc()], "n", start=4).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(4, 5004))
    assert [r.key for r in rows] == sorted((r.key for r in rows), reverse=True)


def test_epoch_order_is_a_repeatable_permutation(spark):
    gids = spark.range(500).select(F.col("id").alias("gid"))
    once, again, other = (
        {r.gid: r.step for r in gw.epoch_order(frame, seed).collect()}
        for frame, seed in [(gids, "a"), (gids.repartition(5), "a"), (gids, "b")]
    )
    assert sorted(once.values()) == list(range(500)) and once == again != other
