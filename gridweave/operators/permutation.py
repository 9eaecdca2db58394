"""Epoch order without a sort: a keyed permutation of 0 .. n - 1 that is worked out by place.

A Feistel network permutes numbers of an even number of bits. Where it leads out of range, it is
walked on until it leads back in, which keeps the mapping one to one and each way invertible.
Any range of steps names its graphs, and any graph its step, without a table of the order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

ROUNDS = 6
# Multipliers of the round function, odd numbers of 32 bits.
FACTORS = (2654435761, 2246822519)
WORD = 1 << 32
# Graphs of a step range that a search lists in the filters that reach the scans.
LISTED = 1000
AT_ONCE = 1 << 16


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0 .. n - 1 that `seed` chooses; n is at most 2 ** 62."""

    n: int
    seed: str

    @property
    def half(self) -> int:
        """Bits of either half of the network's numbers, 1 at least."""
        return max(1, -(-max(self.n - 1, 0).bit_length() // 2))

    def keys(self) -> list[int]:
        return [int(hashlib.md5(f"{self.seed}|{r}".encode()).hexdigest()[:8], 16) for r in range(ROUNDS)]

    def _mixed(self, x: np.ndarray, key: int) -> np.ndarray:
        """The round function: from half a number to as many bits."""
        a = (x % WORD * FACTORS[0] + key) % WORD
        a = (a ^ (a >> np.uint64(15))) * FACTORS[1] % WORD
        return (a ^ (a >> np.uint64(13))) % np.uint64(1 << self.half)

    def _once(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        low = np.uint64((1 << self.half) - 1)
        left, right = x >> np.uint64(self.half), x & low
        for key in reversed(keys) if back else keys:
            if back:
                left, right = right ^ self._mixed(left, key), left
            else:
                left, right = right, left ^ self._mixed(right, key)
        return (left << np.uint64(self.half)) | right

    def _walked(self, x: np.ndarray, back: bool) -> np.ndarray:
        keys, out = self.keys(), np.asarray(x, np.uint64).copy()
        if len(out) and int(out.max()) >= self.n:
            raise ValueError(f"numbers from 0 to {self.n - 1} are permuted")
        waiting = np.arange(len(out))
        while len(waiting):
            out[waiting] = self._once(out[waiting], keys, back)
            waiting = waiting[out[waiting] >= self.n]
        return out.astype(np.int64)

    def at(self, steps: np.ndarray) -> np.ndarray:
        """What comes at each of the steps."""
        return self._walked(steps, False)

    def step_of(self, values: np.ndarray) -> np.ndarray:
        """The step at which each of the values comes."""
        return self._walked(values, True)


def epoch_permutation(
    spark: SparkSession, n: int, seed: str, first: int = 0, last: int | None = None
) -> DataFrame:
    """(step, gid) for the steps from `first` to before `last`, all of `n` by default.

    Steps are a range that Spark cuts in partitions; each number is permuted by itself, so
    nothing is sorted or shuffled, and a part of an epoch costs as much as its steps.
    """
    order = Permutation(n, seed)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(order.at(batch.column(0).to_numpy()))], ["step", "gid"])

    steps = spark.range(first, n if last is None else min(last, n)).withColumnRenamed("id", "step")
    return steps.mapInArrow(over, "step long, gid long")


def steps_of(graphs: DataFrame, n: int, seed: str) -> DataFrame:
    """`graphs` with `step`, the place of their `gid` in the epoch; a null gid has none."""
    order = Permutation(n, seed)

    @F.arrow_udf("long")
    def place(gid: pa.Array) -> pa.Array:
        known = gid.is_valid().to_numpy(zero_copy_only=False)
        found = order.step_of(gid.fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array(found, mask=~known)

    return graphs.withColumn("step", place(F.col("gid")))


def graphs_at_steps(
    nodes: DataFrame, edges: DataFrame, n: int, seed: str, first: int, last: int
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the graphs that come from step `first` to before `last`, each with
    its `step`.

    Of up to LISTED steps the graphs are named in a filter that reaches the scans, whose
    statistics skip row groups without any of them; more are joined as a table of steps.
    """
    last = min(last, n)
    steps = epoch_permutation(nodes.sparkSession, n, seed, first, last)
    if last - first > LISTED:
        return nodes.join(steps, "gid"), edges.join(steps, "gid")
    wanted = Permutation(n, seed).at(np.arange(first, max(first, last))).tolist()
    return tuple(steps_of(t.where(F.col("gid").isin(wanted)), n, seed) for t in (nodes, edges))
