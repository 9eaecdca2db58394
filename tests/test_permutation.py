"""The epoch permutation: one to one for every n, invertible, without a shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridweave as gw
from gridweave.operators.permutation import Permutation, steps_of
from tests.conftest import SF_SMALL
from workload import fixtures as fx


@pytest.mark.parametrize("n", [*range(1, 70), 255, 256, 257, 1000, 4096, 5000, 100_003])
def test_bijection(n):
    order = Permutation(n, "e")
    got = order.at(np.arange(n))
    assert np.array_equal(np.sort(got), np.arange(n))
    assert np.array_equal(order.step_of(got), np.arange(n))


def test_large_numbers_and_seeds():
    for n in (1 << 40, (1 << 62) - 57):
        order = Permutation(n, "big")
        steps = np.array([0, 1, 2, n // 2, n - 1])
        values = order.at(steps)
        assert values.min() >= 0 and values.max() < n and np.array_equal(order.step_of(values), steps)
    a, b = (Permutation(1000, s).at(np.arange(1000)) for s in ("x", "y"))
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.15
    with pytest.raises(ValueError):
        Permutation(5, "x").at(np.array([5]))


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_order_without_a_shuffle(spark):
    whole = gw.epoch_permutation(spark, 5000, "e")
    assert "Exchange" not in plan(whole) and "Sort" not in plan(whole)
    rows = {r["step"]: r["gid"] for r in whole.collect()}
    assert sorted(rows) == sorted(rows.values()) == list(range(5000))
    part = gw.epoch_permutation(spark, 5000, "e", 100, 120).collect()
    assert {r["step"]: r["gid"] for r in part} == {s: rows[s] for s in range(100, 120)}
    back = steps_of(whole.select("gid"), 5000, "e").collect()
    assert all(rows[r["step"]] == r["gid"] for r in back)
    assert gw.epoch_permutation(spark, 0, "e").collect() == []
    none = spark.createDataFrame([(None,), (3,)], "gid long")
    assert [r["step"] is None for r in steps_of(none, 5000, "e").orderBy(F.asc_nulls_first("gid")).collect()] == [True, False]


@pytest.mark.parametrize("listed", [1000, 3])
def test_graphs_of_a_step_range(spark, monkeypatch, listed):
    from gridweave.operators import permutation

    monkeypatch.setattr(permutation, "LISTED", listed)
    nodes, edges = fx.order_graph(spark, SF_SMALL)
    n = nodes.select("gid").distinct().count()
    some, links = gw.graphs_at_steps(nodes, edges, n, "e", 10, 18)
    want = {int(g): s for s, g in zip(range(10, 18), Permutation(n, "e").at(np.arange(10, 18)), strict=True)}
    assert {(r["gid"], r["step"]) for r in some.select("gid", "step").distinct().collect()} == set(want.items())
    assert some.count() == nodes.where(F.col("gid").isin(list(want))).count()
    assert links.count() == edges.where(F.col("gid").isin(list(want))).count() > 0
    if listed == 1000:
        assert "In(gid" in plan(some)
    assert gw.graphs_at_steps(nodes, edges, n, "e", n, n + 5)[0].collect() == []
