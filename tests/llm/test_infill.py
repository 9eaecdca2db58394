"""Cuts found by Fenwick descent against plain slicing, and texts rebuilt from outputs."""

import random
import re

import numpy as np
import pytest
from tests.llm.test_edges import LONG, ROWS, none, odd  # noqa: F401

from gridweave.llm import infill


def plain_cut(text, a, b, form):
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == "psm":
        return f"<P>{prefix}<S>{suffix}<M>{middle}"
    return f"<S>{suffix}<P>{prefix}<M>{middle}"


@pytest.mark.parametrize("blocks", [0, 1, 2, 3, 7, 8, 9, 100])
def test_fenwick_descent(blocks):
    rng = np.random.default_rng(blocks)
    counts = rng.integers(0, 5, (2, blocks))
    tree = infill.Fenwick(counts)
    sums = np.concatenate([[0], counts[0].cumsum()])
    for target in range(int(sums[-1]) + 2):
        at, found = tree.descend(target)
        assert at == np.flatnonzero(sums <= target)[-1]
        assert found.tolist() == counts[:, :at].sum(1).tolist()


@pytest.mark.parametrize("block", [1, 2, 3, 16, 4096])
def test_units_are_code_points(block):
    rng = random.Random(block)
    for _ in range(40):
        text = "".join(rng.choices("a é\U0001f600नि\n\0", k=rng.randrange(60)))
        units = infill.Units(text.encode(), None, block)
        assert units.count == units.length == len(text)
        for n in range(len(text) + 1):
            byte, points = units.cut(n)
            assert (byte, points) == (len(text[:n].encode()), n)


@pytest.mark.parametrize("block", [1, 5, 64])
def test_units_of_a_pattern(block):
    text = "  añb cc,  d\nee \U0001f600 f "
    units = infill.Units(text.encode(), re.compile(rb"[^ ,\n]+"), block)
    starts = [m.start() for m in re.finditer(r"[^ ,\n]+", text)]
    assert units.count == len(starts)
    for n in range(len(starts) + 2):
        want = 0 if n == 0 else len(text) if n >= len(starts) else starts[n]
        assert units.cut(n) == (len(text[:want].encode()), want)
    assert infill.Units(b"   ", re.compile(rb"[^ ]+")).cut(0) == (0, 0)


def test_infill_of_odd_rows(odd, none):  # noqa: F811
    from pyspark.sql import functions as F

    got = infill.infill(odd).withColumn("restored", infill.restored()).collect()
    texts = sorted((r, t or "") for r, t, *_ in ((i if i is not None else -1, t) for i, t, *_ in ROWS))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["restored"]) for r in got) == texts
    for r in got:
        assert r["n"] == len(r["restored"])
        if r["form"] == "plain":
            assert r["output"] == r["restored"] and r["prefix_chars"] is None and r["middle_chars"] is None
        else:
            a = r["prefix_chars"]
            assert r["output"] == plain_cut(r["restored"], a, a + r["middle_chars"], r["form"])
    assert infill.infill(none).collect() == []
    long = next(r for r in got if r["doc_id"] == 6)
    assert long["n"] == len(LONG)
    # the same rows again, however they are dealt
    again = infill.infill(odd.repartition(1)).select(F.bit_xor(F.xxhash64("doc_id", "output")).alias("x")).first()
    assert again == infill.infill(odd).select(F.bit_xor(F.xxhash64("doc_id", "output")).alias("x")).first()


def test_marks_and_chance(spark):
    rows = [(i, t) for i in range(300) for t in ("x < P> <S", "a<P>", "<S>", "q<M>b", "<<", "ab")]
    got = infill.infill(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("back", infill.restored()).collect()
    assert sorted((r["doc_id"], r["back"]) for r in got) == sorted(rows)
    forms = {r["doc_id"]: r["form"] for r in got if r["back"] == "<<"}
    assert all(r["form"] == "plain" for r in got if re.search("<[PSM]>", r["back"]))
    assert all(forms[r["doc_id"]] == r["form"] for r in got if r["back"] in ("ab", "x < P> <S"))
    share = {f: sum(x == f for x in forms.values()) / len(forms) for f in ("plain", "psm", "spm")}
    assert 0.05 < share["plain"] < 0.16 and 0.12 < share["spm"] < 0.25


def test_words_as_units(spark):
    text = "one two  three\nfour " * 50
    got = infill.infill(spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string"), pattern=r"[^\s]+")
    for r in got.withColumn("back", infill.restored()).collect():
        assert r["n"] == 200 and r["back"] == text
        if r["form"] == "psm":
            prefix = r["output"][3 : r["output"].index("<S>")]
            assert prefix == text[: r["prefix_chars"]] and (not prefix or prefix[-1] in " \n")
