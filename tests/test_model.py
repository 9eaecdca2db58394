"""Channels, masking, features, attention and objective against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridweave as gw
from gridweave.operators.attention import _large_graphs
from gridweave.operators.lookup import ranked_lookup
from gridweave.schemas import NODE_TYPES, RELATIONS, TABLE_SCHEMA

MASKING = gw.Masking("t", rate=0.3)


@pytest.fixture(scope="module")
def graph(spark):
    rows = [
        (0, "0", ["a", "b"], [["1", "2"], ["3"], ["4", "5", "6"]], ["why", "how"]),
        (1, "1", [], [], []),
        (2, "2", ["x"], [["y"], ["z"]], ["w"]),
    ]
    tables = spark.createDataFrame(rows, "gid long, " + TABLE_SCHEMA)
    return gw.materialize(gw.table_nodes(tables), "t"), gw.materialize(gw.table_edges(tables), "t")


def dense(graph):
    """gid -> (types, six channel matrices) built from whole matrices."""
    nodes, edges = (frame.collect() for frame in graph)
    out = {}
    for gid in sorted({n.gid for n in nodes}):
        own = sorted((n for n in nodes if n.gid == gid), key=lambda n: n.pos)
        at = {n.id: k for k, n in enumerate(own)}
        adjacency = np.eye(len(own))
        for e in edges:
            if e.src in at and e.dst in at:
                adjacency[at[e.src], at[e.dst]] = 1
        channels = []
        for pair in RELATIONS:
            member = np.array([n.type in pair for n in own])
            channels.append(adjacency * (member[:, None] | member[None, :]))
        out[gid] = ([n for n in own], np.array(channels))
    return out


def test_channels(graph):
    got = {(r.gid, r.rel, r.src, r.dst) for r in gw.relation_channels(gw.edge_relations(*graph)).collect()}
    want = {
        (gid, rel, own[i].id, own[j].id)
        for gid, (own, channels) in dense(graph).items()
        for rel, i, j in np.argwhere(channels > 0)
    }
    assert got == want


def test_channels_can_ask_for_both_ends(graph):
    related = gw.edge_relations(*graph, match="both").where("src <> dst")
    got = {(r.src, r.dst): r.rels for r in related.collect()}
    assert got["0-0-0", "0-0-1"] == [0] and got["0-1-1", "0-0-1"] == [5]


def test_multiplicity(graph):
    got = {(r.gid, r.src, r.dst): r.n for r in gw.relation_multiplicity(gw.edge_relations(*graph)).collect()}
    want = {}
    for gid, (own, channels) in dense(graph).items():
        for i, j in np.argwhere(channels.sum(axis=0) > 0):
            want[gid, own[i].id, own[j].id] = channels.sum(axis=0)[i, j]
    assert got == want


def test_masks(graph):
    rows = gw.mask_nodes(graph[0], MASKING).collect()
    assert 0 < sum(r.replaced for r in rows) < len(rows)
    for r in rows:
        assert r.type_code == (-1 if r.replaced else NODE_TYPES.index(r.type))
        assert r.label in (-1, r.pos) and (r.label == r.pos or not r.replaced)


def test_mask_rates(spark):
    ids = spark.range(40000).select(
        F.col("id").cast("string").alias("id"), F.lit("H").alias("type"), F.lit(7).alias("pos"),
        F.array(F.lit(5), F.lit(2)).alias("ids"),
    )
    rows = gw.mask_nodes(ids, gw.Masking("rates"))
    n, replaced = rows.where("label = 7").count(), rows.where("replaced").count()
    assert abs(n / 40000 - 0.1) < 0.01 and abs(replaced / n - 0.8) < 0.03
    assert {tuple(r.ids) for r in rows.where("replaced").collect()} == {(1, 1)}
    assert {tuple(r.ids) for r in rows.where("not replaced").collect()} == {(5, 2)}
    assert gw.mask_nodes(ids, gw.Masking("all", 1.0, 1.0)).where("not replaced").isEmpty()


def test_masked_channels(graph):
    related = gw.edge_relations(*graph)
    got = gw.relation_channels(gw.masked_relations(related, MASKING))
    hidden = graph[0].where(MASKING.replaced(F.col("id"))).select("gid", "id")
    joined = gw.relation_channels(gw.relations_touching(related, hidden))
    replaced = {r.id for r in hidden.collect()}
    want = set()
    for gid, (own, channels) in dense(graph).items():
        touched = np.array([n.id in replaced for n in own])
        kept = (channels.sum(axis=0) > 0) & (touched[:, None] | touched[None, :])
        want |= {(gid, rel, own[i].id, own[j].id) for i, j in np.argwhere(kept) for rel in range(6)}
    for frame in (got, joined):
        assert {(r.gid, r.rel, r.src, r.dst) for r in frame.collect()} == want


def dense_layer(x, channel, head, activate):
    """Attention of one head with whole matrices; sources without neighbours see all nodes."""
    h = x @ head.weight
    left, right = h @ head.attn[: head.size], h @ head.attn[head.size :]
    score = left[:, None] + right[None, :]
    score = np.where(score > 0, score, 0.1 * score)
    score = np.where(channel > 0, score, -1e12)
    p = np.exp(score - score.max(axis=1, keepdims=True))
    out = (p / p.sum(axis=1, keepdims=True)) @ h
    return np.where(out > 0, out, np.expm1(np.minimum(out, 0))) if activate else out


def dense_model(x, channels, heads, out_head):
    hidden = [dense_layer(x, c, h, True) for c, h in zip(channels, heads)]
    return dense_layer(np.concatenate(hidden, axis=1), channels.sum(axis=0), out_head, False)


@pytest.mark.parametrize("colocated_pairs", [10**6, 20, 0])
@pytest.mark.parametrize("masked", [False, True])
@pytest.mark.parametrize("batch_rows", ["10000", "3"])
def test_attention(spark, graph, colocated_pairs, masked, batch_rows):
    """Graphs kept together, spread by node, and cut over Arrow batches."""
    related = gw.edge_relations(*graph)
    if masked:
        related = gw.masked_relations(related, MASKING)
    heads, out_head = gw.random_heads(3, 5, 4, 6)
    x = {n.id: np.random.default_rng(abs(hash(n.id)) % 1000).normal(size=5) * 3 for n in graph[0].collect()}
    features = spark.createDataFrame(
        [(n.gid, n.id, n.pos, x[n.id].tolist()) for n in graph[0].collect()],
        "gid long, id string, pos int, h array<double>",
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        out = gw.relational_attention(
            features, related, heads, out_head, colocated_pairs=colocated_pairs
        )
        got = {r.id: np.array(r.h) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    pairs = {(r.src, r.dst): r.rels for r in related.collect()}
    for own, channels in dense(graph).values():
        ids = [n.id for n in own]
        mine = np.array(
            [[[rel in pairs.get((a, b), []) for b in ids] for a in ids] for rel in range(6)], float
        )
        if not masked:
            assert (mine == channels).all()
        want = dense_model(np.array([x[i] for i in ids]), mine, heads, out_head)
        assert np.allclose([got[i] for i in ids], want, atol=1e-9)


def test_attention_with_far_apart_scores(spark):
    """Weights of scores that exp() alone cannot hold."""
    features = spark.createDataFrame(
        [(0, i, [float(v)]) for i, v in enumerate([-3000, -2990, 5000, 4990])],
        "gid long, id int, h array<double>",
    )
    pairs = [(0, a, b, [0]) for a, b in [(0, 0), (0, 1), (1, 0), (2, 3), (2, 2), (3, 0)]]
    related = spark.createDataFrame(pairs, "gid long, src int, dst int, rels array<int>")
    head = gw.Head(np.eye(1), np.array([0.0, 1.0]))
    channel = np.zeros((4, 4))
    for _, a, b, _ in pairs:
        channel[a, b] = 1
    x = np.array([[-3000.0], [-2990.0], [5000.0], [4990.0]])
    for limit in (10, 0):
        out = gw.attention_layer(features, related, [head], activate=False, colocated_pairs=limit)
        got = [r.h for r in out.orderBy("id").collect()]
        assert np.allclose(got, dense_layer(x, channel, head, False))


def test_many_nodes_with_few_pairs_are_spread(spark):
    """A graph over the bound on nodes goes by node, with a few pairs or none; others stay whole."""
    sizes = {0: 3, 1: 30, 2: 25}
    draw = np.random.default_rng(8)
    x = {g: draw.normal(size=(n, 2)) for g, n in sizes.items()}
    features = spark.createDataFrame(
        [(g, i, row.tolist()) for g, rows in x.items() for i, row in enumerate(rows)],
        "gid long, id int, h array<double>",
    )
    pairs = [(0, 0, 1, [0]), (1, 4, 5, [0]), (1, 5, 5, [0])]
    related = spark.createDataFrame(pairs, "gid long, src int, dst int, rels array<int>")
    large = _large_graphs(features, related, pairs=1, nodes=25)
    assert sorted(r.gid for r in large.collect()) == [1]
    assert sorted(r.gid for r in _large_graphs(features, related, 10, 24).collect()) == [1, 2]
    head = gw.Head(draw.normal(size=(2, 3)), draw.normal(size=6))
    out = gw.attention_layer(features, related, [head], colocated_nodes=24)
    got = {(r.gid, r.id): r.h for r in out.collect()}
    for gid, rows in x.items():
        channel = np.zeros((len(rows), len(rows)))
        for g, a, b, _ in pairs:
            if g == gid:
                channel[a, b] = 1
        want = dense_layer(rows, channel, head, True)
        assert np.allclose([got[gid, i] for i in range(len(rows))], want)


def test_edge_softmax_sums_to_one(spark):
    rows = [(0, "a", float(s)) for s in (1, 900, 901)] + [(0, "b", -1000.0)]
    got = gw.edge_softmax(spark.createDataFrame(rows, "gid long, src string, score double"), ["gid", "src"])
    sums = {r.src: r.s for r in got.groupBy("src").agg(F.sum("weight").alias("s")).collect()}
    assert sums == pytest.approx({"a": 1.0, "b": 1.0})


@pytest.mark.parametrize("block", [512, 7, 1])
def test_objective_in_blocks(spark, block):
    draw = np.random.default_rng(5)
    views = {g: (draw.normal(size=(n, 4)) * 4, draw.normal(size=(n, 4))) for g, n in [(0, 40), (1, 1), (2, 9)]}
    views[2][0][3] = views[2][0][1]  # two equal nodes: the lower one wins
    frames = [
        spark.createDataFrame(
            [(g, i, v[side][i].tolist()) for g, v in views.items() for i in range(len(v[side]))],
            "gid long, pos int, h array<double>",
        )
        for side in (0, 1)
    ]
    losses = {r.gid: (r.n, r.loss) for r in gw.contrastive_loss(*frames, block=block).collect()}
    best = {(r.gid, r.pos): (r.best, r.log_p) for r in gw.retrieval_top1(*frames, block=block).collect()}
    for g, (plain, masked) in views.items():
        s = plain @ masked.T
        top = s.max(axis=1, keepdims=True)
        log_p = s - top - np.log(np.exp(s - top).sum(axis=1, keepdims=True))
        assert losses[g] == (len(s), pytest.approx(-np.diag(log_p).mean()))
        for j in range(len(s)):
            near = np.flatnonzero(log_p[:, j] >= log_p[:, j].max() - 1e-12)
            assert best[g, j][0] == near[0] or len(near) > 1 and best[g, j][0] in near
            assert best[g, j][1] == pytest.approx(log_p[:, j].max())


def test_skipgram_scores(spark):
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0])], "word_id long, vector array<double>")
    pairs = spark.createDataFrame([(0, 1), (1, 1)], "center long, context long")
    got = {(r.center, r.context): r.score for r in gw.skipgram_scores(pairs, vectors, vectors).collect()}
    assert got == {(0, 1): 1.0, (1, 1): 10.0}


@pytest.mark.parametrize("head", [0, 2, 100])
def test_lookup_finds_frequent_and_rare_rows(spark, head):
    """A third of the rows share one key, wherever its entry lies."""
    table = spark.createDataFrame([(f"w{i}", i) for i in range(10)], "word string, word_id long")
    rows = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "w5")
        .when(F.col("id") % 3 == 1, F.concat(F.lit("w"), F.col("id") % 10))
        .when(F.col("id") % 5 == 0, None)
        .otherwise("unknown")
        .alias("word"),
    )
    got = ranked_lookup(rows, table, "word", F.col("word_id") < head)
    want = rows.join(table, "word", "left").select("id", "word", "word_id")
    assert got.count() == 3000 and got.exceptAll(want).isEmpty()


def test_features_are_means_of_known_vectors(spark):
    vectors = spark.createDataFrame([(4, [1.0, 0.0]), (5, [3.0, 2.0]), (3, [0.0, 9.0])], "word_id long, vector array<double>")
    rows = spark.createDataFrame([(0, [4, 5, 5, 2]), (1, [0, 2]), (2, [4, 3, 2, 2])], "id int, ids array<int>")
    got = {r.id: r.h for r in gw.embed_text(rows, ["id"], vectors, 2).collect()}
    assert got == {0: pytest.approx([7 / 3, 4 / 3]), 1: [0.0, 0.0], 2: [0.5, 4.5]}


def test_examples_and_loss(spark, graph):
    nodes, edges = graph
    dictionary = gw.build_dictionary(gw.word_counts(nodes), more_than=0)
    examples = gw.training_examples(nodes, edges, dictionary, length=6, block=5)
    ids = {r.word: r.word_id for r in dictionary.collect()}
    tokens = {}
    for row in examples.nodes.collect():
        for k, (t, code) in enumerate(zip(row.tokens, row.type_codes)):
            tokens[row.gid, row.block * 5 + k] = (t, code)
    for n in nodes.collect():
        words = n.text.replace("[SEP]", " ").split()
        want = ([ids[w] for w in words] + [3] + [2] * 6)[:6]
        assert tokens[n.gid, n.pos] == (want, NODE_TYPES.index(n.type))
    entries = {(r.gid, e.rel, e.i, e.j) for r in examples.adjacency.collect() for e in r.entries}
    channels = {
        (gid, *map(int, at)) for gid, (_, c) in dense(graph).items() for at in np.argwhere(c > 0)
    }
    assert entries == channels

    draw = np.random.default_rng(2)
    table = {i: draw.normal(size=5) for i in list(ids.values()) if i != 0}
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in table.items()], "word_id long, vector array<double>")
    heads, out_head = gw.random_heads(8, 5, 4, 6)
    losses = gw.pretraining_loss(nodes, edges, dictionary, vectors, 5, heads, out_head, MASKING, length=6)
    replaced = {r.id for r in nodes.where(MASKING.replaced(F.col("id"))).collect()}
    got = {r.gid: r.loss for r in losses.collect()}
    for gid, (own, channels) in dense(graph).items():
        x = np.array([np.mean([table[t] for t in tokens[gid, n.pos][0] if t != 2], axis=0) for n in own])
        hit = np.array([n.id in replaced for n in own])
        kept = (channels.sum(axis=0) > 0) & (hit[:, None] | hit[None, :])
        plain = dense_model(x, channels, heads, out_head)
        masked = dense_model(np.where(hit[:, None], table[1], x), np.array([kept] * 6, float), heads, out_head)
        s = plain @ masked.T
        log_p = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
        assert got[gid] == pytest.approx(-np.diag(log_p).mean())
