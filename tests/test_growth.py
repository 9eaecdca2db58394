"""Steps whose shuffles must grow no faster than their input."""

from pyspark.sql import functions as F

import gridweave as gw
from gridweave.operators import sampling
from gridweave.operators.contrast import BLOCKS, _blocks, _paired
from gridweave.operators.lookup import ranked_lookup
from gridweave.operators.subgraph import graph_batch, pack_adjacency, pack_channels
from tests.conftest import SF_SMALL
from tests.test_workload import plan
from workload import fixtures as fx


def test_order_graph_is_built_where_it_is_read(spark):
    for rows in fx.order_graph(spark, SF_SMALL):
        assert "Generate" in plan(rows) and "Exchange" not in plan(rows)


def test_gathered_graph_shuffles_tables_alone(spark):
    _, adjacency = graph_batch(*fx.gathered_graph(spark, SF_SMALL))
    steps = plan(adjacency)
    assert steps.count("Exchange") == 1 and steps.index("Generate") < steps.index("Exchange")


def test_served_rows_stay_out_of_the_shuffle(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "a")], "id long, word string")
    table = spark.createDataFrame([("a", 7), ("b", 8)], "word string, word_id long")
    found = ranked_lookup(left, table, "word", F.col("word") == "a", twice=True)
    assert {(r.id, r.word_id) for r in found.collect()} == {(1, 7), (2, 8), (3, None), (4, None), (5, 7)}


def test_positions_over_several_ranges(spark):
    rows = [(1, r, c) for r in (None, 0, 5, 1023, 1024, 5000) for c in (0, 1)] + [(2, 7000, 0)]
    nodes = spark.createDataFrame([(*r, 0) for r in rows], "gid long, row int, col int, pos int")
    numbered = gw.node_positions(nodes)
    assert "rangepartitioning(gid" not in plan(numbered)
    assert [r.pos for r in numbered.orderBy("gid", "row", "col").collect()] == [*range(12), 0]


def test_blocks_of_a_large_graph(spark):
    nodes = spark.range(200).select(
        F.lit(1).alias("gid"), F.col("id").cast("int").alias("pos"), F.array(F.sin("id"), F.cos("id")).alias("h")
    )
    assert _blocks(_paired(nodes, nodes), 4).agg(F.max("n_blocks")).first()[0] == BLOCKS
    cut, whole = (gw.contrastive_loss(nodes, nodes, b).first().loss for b in (4, 512))
    assert abs(cut - whole) < 1e-9
    best = gw.retrieval_top1(nodes, nodes, 4).select("pos", "best")
    assert sorted(best.collect()) == sorted(gw.retrieval_top1(nodes, nodes).select("pos", "best").collect())


def test_texts_are_tokenized_once(spark):
    """The look-up goes over the words twice: for those the head serves, and for the rest."""
    rows = spark.createDataFrame([(1, "a b (c), b"), (2, None), (3, "")], "id long, text string")
    dictionary = spark.createDataFrame([("a", 3, 4), ("b", 2, 5), ("c" * 70, 1, 6)], "word string, cnt long, word_id long")
    words = gw.tokenize(F.col("text"))
    for found in (gw.tokens_to_ids(rows, ["id"], words, dictionary), gw.kept_words(rows, ["id"], words, dictionary, 1e9, "s")):
        assert "split(" not in found._jdf.queryExecution().executedPlan().toString()
    ids = gw.tokens_to_ids(rows, ["id"], words, dictionary)
    assert {r.id: r.ids for r in ids.collect()} == {1: [4, 5, 0, 0, 0, 5], 2: [0], 3: []}


def test_edges_are_made_in_compiled_steps(spark):
    """Each place is worked out once, and what there is per link is compiled."""
    rows = [(0, ["a", "b"], [["1", "2"], ["3"], ["4", "5", "6"], []], ["why"]), (1, [], [], [])]
    tables = spark.createDataFrame(rows, "gid long, columns array<string>, rows array<array<string>>, questions array<string>")
    for dangling in (True, False):
        edges = gw.table_edges(tables, dangling)
        steps = edges._jdf.queryExecution().executedPlan().toString().splitlines()
        generators = [s for s in steps if "Generate" in s]
        assert len(generators) == 3 and all("*(" in s for s in generators)
        assert not any("transform" in s for s in steps if "Filter" in s)
        assert edges.where("j is null or i is null").count() == (6 if dangling else 0)


def _tables(spark, n):
    rows = [(g, ["a", "b"], [[str(g + r), "x y"] for r in range(g % 4)], ["why"] if g % 3 else []) for g in range(n)]
    schema = "gid long, columns array<string>, rows array<array<string>>, questions array<string>"
    return spark.createDataFrame(rows, schema)


def _model(spark, nodes):
    dictionary = gw.materialize(gw.build_dictionary(gw.word_counts(nodes), more_than=0), "words")
    vectors = dictionary.where("word_id % 3 <> 0").select("word_id", F.array(F.sin("word_id"), F.cos("word_id")).alias("vector"))
    return dictionary, gw.materialize(vectors, "vectors"), gw.random_heads(8, 2, 3, 6)


def test_gathered_graphs_are_not_shuffled_again(spark):
    """No node's vector and no pair is moved if nodes and pairs lie by graph."""
    graph = gw.build_graph(_tables(spark, 40).repartition(5, "gid"), dangling=False)
    dictionary, vectors, (heads, out_head) = _model(spark, graph.nodes)
    features = gw.node_features(graph.nodes, dictionary, vectors, 2)
    by_position = features.select("gid", F.col("pos").alias("id"), "h")
    pairs = gw.edge_relations(*graph).select("gid", F.col("i").alias("src"), F.col("j").alias("dst"), "rels")
    out = gw.relational_attention(by_position, pairs, heads, out_head)
    losses = gw.pretraining_loss(*graph, dictionary, vectors, 2, heads, out_head, gw.Masking("t", rate=0.3))
    for frame in (out, losses):
        steps = [s for s in plan(frame).splitlines() if " Exchange" in s or "-Exchange" in s or "- Exchange" in s]
        assert steps and all("hashpartitioning(gid" in s and "REPARTITION_BY_NUM" in s for s in steps), steps
    spread = [f.repartition(3) for f in graph]
    want = gw.pretraining_loss(*spread, dictionary, vectors, 2, heads, out_head, gw.Masking("t", rate=0.3))
    rows = lambda f: sorted((r.gid, r.n, round(r.loss, 9)) for r in f.collect())
    assert len(rows(losses)) == 40 and rows(losses) == rows(want)


def test_loss_of_ordinary_and_large_graphs(spark, monkeypatch):
    """Graphs over the bound on nodes go by node and have the loss they have whole."""
    from gridweave.plans import pretraining

    graph = gw.build_graph(_tables(spark, 12).repartition(3, "gid"), dangling=False)
    dictionary, vectors, (heads, out_head) = _model(spark, graph.nodes)

    def losses():
        found = gw.pretraining_loss(*graph, dictionary, vectors, 2, heads, out_head, gw.Masking("t", rate=0.3))
        return {r.gid: (r.n, round(r.loss, 9)) for r in found.collect()}

    whole = losses()
    for bound in (8, 0):
        monkeypatch.setattr(pretraining, "LOSS_NODES", bound)
        assert losses() == whole and len(whole) == 12
    monkeypatch.setattr(pretraining, "HEAD_BYTES", 0)
    assert losses() == whole


def test_repeated_texts_are_tokenized_once(spark):
    rows = [("a b, a",), ("a b, a",), (None,), ("-",), ("",), (None,)]
    nodes = spark.createDataFrame(rows, "text string")
    texts = gw.distinct_texts(nodes)
    assert {(r.text, r.cnt) for r in texts.collect()} == {("a b, a", 2), ("-", 3), ("", 1)}
    assert sorted(gw.word_counts(texts, "cnt").collect()) == sorted(gw.word_counts(nodes).collect())


def test_long_steps_are_compiled(spark):
    """Methods of over 8,000 bytes, as that of 64 columns of features, are never compiled by HotSpot."""
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def order_folder(spark, path) -> str:
    """Orders that come twice, have no key or too many line items; line items and turns without an order."""
    orders = [(1,), (2,), (2,), (None,), (3,), (4,)]
    lines = [(1, 7, 8, 2, 5.0, "A"), (1, 9, 8, 1, None, None), (None, 1, 1, 1, 1.0, "N"), (9, 1, 1, 1, 1.0, "N")]
    lines += [(2, None, 3, None, 4.0, "R"), (2, 6, 3, 1, 4.0, "R"), *((3, k, 0, 1, 1.0, "N") for k in range(750))]
    turns = [(1, 2, "user", "why"), (1, 1, "user", None), (1, 0, "bot", "no"), (None, 1, "user", "lost"), (4, 1, "user", "x")]
    for name, rows, schema in [
        ("orders", orders, "o_orderkey long"),
        ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"),
        ("conversations", turns, "conv_id long, turn long, role string, text string"),
    ]:
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_tables_of_odd_orders(spark, tmp_path):
    sf = order_folder(spark, tmp_path)
    first, second = ["1", "9", None, None], ["2", "7", "5", "A"]
    twice = [[None, None, "4", "R"], ["1", "6", "4", "R"]]
    expected = [
        (None, [], []), (1, [first, second], [None, "why"]), (2, twice, []), (2, twice, []), (4, [], ["x"])
    ]
    key = lambda r: (r[0] is not None, r[0])
    found = [(r.o_orderkey, r.rows, r.questions) for r in fx.order_records(spark, sf).collect()]
    assert sorted(found, key=key) == expected
    tables = fx.order_tables(spark, sf).orderBy("gid").collect()
    assert [(r.o_orderkey, r.rows, r.questions) for r in tables] == expected
    assert [r.gid for r in tables] == [0, 1, 2, 3, 4] and all(r.columns == fx.COLUMNS for r in tables)


def test_tables_take_one_shuffle(spark):
    steps = plan(fx.order_records(spark, SF_SMALL))
    assert steps.count("Exchange") == 1 and "Join" not in steps


def test_draws_are_not_shuffled(spark, monkeypatch):
    weights = spark.createDataFrame([(4 + k, 1 + k % 7) for k in range(3000)], "word_id long, weight long")
    table = gw.materialize(gw.alias_table(weights), "alias")
    rows = spark.range(2000).select("id", (F.col("id") % 3000 + 4).alias("center"))
    drawn = gw.negative_samples(rows, ["id"], "center", table)
    assert "hashpartitioning(slot" not in plan(drawn) and "BroadcastHashJoin" in plan(drawn)
    monkeypatch.setattr(sampling, "SENT_SLOTS", 0)
    joined = gw.negative_samples(rows, ["id"], "center", table)
    assert sorted(joined.collect()) == sorted(drawn.collect())


def test_channels_are_listed_after_the_gathering(spark):
    """A pair is gathered once, however many channels it has."""
    rows = [(0, 1, 0, [0, 5]), (0, 0, 1, [2]), (0, 0, 1, [2]), (0, 1500, 3, [0, 1, 2, 3, 4, 5]), (0, 2, 2, []), (0, 2, 3, None), (1, 0, 0, [3])]
    related = spark.createDataFrame(rows, "gid long, i int, j int, rels array<int>")
    apart = related.select("gid", F.explode("rels").alias("rel"), "i", "j")
    keys = ["gid", "row_block", "col_block"]
    found, expected = (df.select(*keys, "entries").orderBy(*keys).collect() for df in (pack_channels(related, 6), pack_adjacency(apart, ["rel"])))
    assert [tuple(r) for r in found] == [tuple(r) for r in expected] and len(found) == 3
    assert "Generate" not in plan(pack_channels(related, 6))


def test_edges_are_built_from_shapes(spark, tmp_path):
    """No text of a cell is moved for the edges, and large graphs are found without moving tables."""
    sf = order_folder(spark, tmp_path)
    nodes, edges = fx.gathered_graph(spark, sf)
    assert sorted(edges.collect()) == sorted(fx.order_graph(spark, sf).edges.collect())
    key = lambda r: (r.gid, r.pos)
    assert sorted(nodes.collect(), key=key) == sorted(fx.order_graph(spark, sf).nodes.collect(), key=key)
    moved = [plan(rows).split("Exchange")[-1] for rows in (edges, nodes)]  # steps before the shuffle
    assert "transform(rows" in moved[0] and "transform(rows" not in moved[1]
    for rows in fx.counted_graph(spark, sf):
        assert rows.columns == ["gid"] and "Exchange" not in plan(rows)


def test_blocks_of_a_large_vocabulary():
    """A basis is sent once for each block of words, so blocks must not get more with the words."""
    from gridweave.operators.cooccurrence import BLOCK_WORDS, BLOCKS, LARGEST_BLOCK, block_words

    assert block_words(10) == block_words(BLOCK_WORDS * BLOCKS) == BLOCK_WORDS
    assert -(-1_055_170 // block_words(1_055_170)) == BLOCKS and block_words(10**9) == LARGEST_BLOCK
