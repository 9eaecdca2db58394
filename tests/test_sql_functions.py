"""Functions in SQL against the same functions in Python."""

import random

import pytest
from pyspark.sql import functions as F

import gridweave as gw

PIECES = ["(", ")", '"', "'", "\\", '\\"', "[SEP]", " ", "\t", "　", " ", "a", "É", "b.", "…", "!", ":", ",", "𝒳", "-"]
TABLES = [
    (0, ["a", "b"], [["1", "2"], ["3", "4"]], ["why?", "how?"]),
    (1, ["a", "b", "c"], [["1"], [], ["2", "3", "4", "5"]], []),
    (2, [], [], ["q"]),
    (3, [], [["x"]], []),
    (4, ["", "a"], [["", None]], ["", ""]),
]


@pytest.fixture(scope="module")
def session(spark):
    gw.register_functions(spark)
    gw.register_functions(spark)
    draw = random.Random(5)
    texts = ["".join(draw.choices(PIECES, k=draw.randrange(12))) for _ in range(800)]
    spark.createDataFrame([(t,) for t in [None, "", *texts]], "text string").createOrReplaceTempView("some_texts")
    spark.createDataFrame(
        TABLES, "gid long, columns array<string>, rows array<array<string>>, questions array<string>"
    ).createOrReplaceTempView("some_tables")
    return spark


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_tokenize(session):
    found = session.sql("SELECT text, tokenize(text) AS words FROM some_texts")
    assert "Python" not in plan(found)
    wrong = found.where(~F.col("words").eqNullSafe(gw.tokenize(F.col("text"))))
    assert wrong.collect() == [] and found.count() == 802


def test_tokenize_in_other_places(session):
    rows = session.sql(
        "SELECT size(tokenize(text)) AS n, count(*) AS c FROM some_texts WHERE array_contains(tokenize(text), 'a') GROUP BY 1"
    ).collect()
    words = session.table("some_texts").select(gw.tokenize(F.col("text")).alias("w")).where("array_contains(w, 'a')")
    assert sorted(rows) == sorted(words.groupBy(F.size("w").alias("n")).count().collect())


def test_text_words(session):
    found = session.sql("SELECT text, w.* FROM some_texts, LATERAL text_words(text) w")
    want = session.table("some_texts").select("text", F.posexplode(gw.tokenize(F.col("text"))))
    assert found.exceptAll(want).count() == want.exceptAll(found).count() == 0
    assert "Join" not in plan(found) and "Exchange" not in plan(found)


@pytest.mark.parametrize("dangling", [True, False])
def test_graph_of_a_table(session, dangling):
    tables = session.table("some_tables")
    nodes = session.sql("SELECT n.* FROM some_tables t, LATERAL table_nodes(t.gid, t.columns, t.rows, t.questions) n")
    more = "" if dangling else ", false"
    edges = session.sql(
        f"SELECT e.* FROM some_tables t, LATERAL table_edges(t.gid, t.columns, t.rows, t.questions{more}) e"
    )
    want = gw.table_nodes(tables), gw.table_edges(tables, dangling).select("gid", "src", "dst", "type")
    for found, wanted in zip((nodes, edges), want):
        assert found.columns == wanted.columns
        assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))
        steps = plan(found)
        assert not any(word in steps for word in ("Join", "Exchange", "Python"))
