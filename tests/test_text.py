import random

import pytest
from pyspark.sql import functions as F

import gridweave as gw
from tests.conftest import SF_SMALL

CASES = {
    None: ["-"],
    "": [],
    "  \t ": [],
    "(": ["(", "-"],
    "ab.)": ["ab.", ")"],
    ".": ["."],
    "..": [".", "."],
    "a[SEP]b c.": ["a", "b", "c", "."],
    'x\\"y': ["x", "y"],
    "((x).)": ["(", "(x).", ")"],
    '"(x': ["(x"],
    "a　b c d": ["a", "b", "c", "d"],
    "“q”": ["“q”"],
    "\\": ["-"],
    "don't": ["don't"],
    "'\"ab\"'": ["ab"],
    "(end;": ["(", "end", ";"],
}


def expected_words(text):
    """The rules once more, written as a scan from the ends of each piece."""
    if text is None:
        return ["-"]
    words = []
    for piece in text.replace("[SEP]", " ").replace('\\"', " ").split():
        first, last = 0, len(piece)
        if piece[0] == "(":
            words.append("(")
            first = 1
        while first < last and piece[first] in "\"\\'":
            first += 1
        while last > first and piece[last - 1] in "\"\\'":
            last -= 1
        body = piece[first:last] or "-"
        cut = len(body) - (len(body) > 1 and body[-1] in ",.!?):;")
        words += [part for part in (body[:cut], body[cut:]) if part]
    return words


def words_of(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.w for r in rows.select("i", gw.tokenize(F.col("text")).alias("w")).orderBy("i").collect()]


def test_word_rules(spark):
    assert words_of(spark, list(CASES)) == list(CASES.values())


def test_random_strings(spark):
    draw = random.Random(1)
    alphabet = "ab(),.!?:;\"'\\ \t\n  é[SEP]"
    texts = ["".join(draw.choices(alphabet, k=draw.randrange(12))) for _ in range(3000)]
    assert words_of(spark, texts) == [expected_words(t) for t in texts]


@pytest.mark.parametrize("table,column", [("documents", "text"), ("pages", "html")])
def test_whole_texts(spark, table, column):
    texts = [r[0] for r in spark.read.parquet(f"{SF_SMALL}/{table}.parquet").select(column).collect()]
    assert words_of(spark, texts) == [expected_words(t) for t in texts]


def test_quotes_can_be_straightened(spark):
    rows = spark.createDataFrame([("“q” ‘r’",)], "text string")
    words = rows.select(gw.tokenize(F.col("text"), straighten_quotes=True)).first()[0]
    assert words == ["q", "r"]


@pytest.mark.parametrize("length", [0, 1, 126, 127, 128, 129, 300])
def test_padding(spark, length):
    ids = F.array_repeat(F.lit(9), length)
    padded, mask = (
        spark.range(1)
        .select(gw.pad_or_truncate(ids).alias("p"))
        .select("p", gw.pad_mask(F.col("p")))
        .first()
    )
    assert padded == ([9] * length + [3] + [2] * 128)[:128]
    assert mask == [i <= length for i in range(128)]


def test_sentences_need_two_words(spark):
    rows = spark.createDataFrame([(1, "a b[SEP]c[SEP][SEP]d.")], "id int, text string")
    got = gw.skipgram_sentences(rows, ["id"]).orderBy("sentence").collect()
    assert [(r.sentence, r.words) for r in got] == [(0, ["a", "b"]), (3, ["d", "."])]
