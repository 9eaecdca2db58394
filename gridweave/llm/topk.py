"""Exact top-k search by inner product: postings by term, scores in dense arrays.

Vectors are made of whole numbers. Rows are dealt to blocks of bounded size; each block is
turned into postings, for each term (component) the rows that have it and their weights.
Every query goes to every block. There its terms are taken one after another, each adding
its weighted postings to an array with a score for each row of the block; the best of the
array are picked by partition selection, and the picks of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridweave.session import materialize

K = 20
SCALE = 64
# Rows of a block, and queries whose scores a task holds at a time: together 2 MB of scores.
BLOCK = 8192
QUERIES_AT_ONCE = 32
# Share of a block's rows from which on a posting list is kept as a column with zeros.
FULL = 0.5


def scaled(x: np.ndarray, scale: int) -> np.ndarray | None:
    """floor(scale * x) as whole numbers; None if a component is not finite."""
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(scale * x)
    if not np.isfinite(x).all():
        return None
    if len(whole) and np.abs(whole).max() >= 1 << 62:
        raise OverflowError("a component times the scale does not fit in a long")
    return whole.astype(np.int64)


def whole_vectors(
    vectors: DataFrame, scale: int = SCALE, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(vec_id, weights, part, row): the vectors that take part, as whole numbers.

    Null vectors and those with a component that is null or not finite are left out.
    `part` and `row` tell rows apart: the task and the place in it.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if v is not None and None not in v:
                    weights = scaled(np.array(v, np.float64), scale)
                    if weights is not None:
                        ids.append(i)
                        out.append(weights.astype("<i8").tobytes())
            if ids:
                yield pa.record_batch(
                    [
                        pa.array(ids, pa.int64()), pa.array(out, pa.binary()),
                        pa.array([part] * len(ids), pa.int32()), pa.array(range(row, row + len(ids)), pa.int64()),
                    ],
                    ["vec_id", "weights", "part", "row"],
                )
                row += len(ids)

    slim = vectors.select(
        F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")
    )
    return slim.mapInArrow(over, "vec_id long, weights binary, part int, row long")


def matrix(weights: list[bytes]) -> np.ndarray:
    """Rows of whole numbers; shorter ones end in zeros."""
    rows = [np.frombuffer(w, "<i8") for w in weights]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for place, row in zip(out, rows, strict=True):
        place[: len(row)] = row
    return out


class Postings:
    """The rows of a block by term, rows in order of id (none last), so that the place in
    the block decides between equal scores."""

    def __init__(self, ids: list[int | None], weights: list[bytes]):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids = [ids[i] for i in order]
        x = matrix([weights[i] for i in order])
        self.rows = len(ids)
        self.most = int(np.abs(x).max(initial=0))
        self.lists: list[tuple[np.ndarray | None, np.ndarray]] = []
        for column in x.T:
            found = np.flatnonzero(column)
            if len(found) > FULL * self.rows:
                self.lists.append((None, column.copy()))
            else:
                self.lists.append((found, column[found]))
        self.first = {}
        for at, i in enumerate(self.ids):
            low, high = self.first.get(i, (at, at))
            self.first[i] = (low, at + 1) if i is not None else (0, 0)

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of queries with all rows, term at a time."""
        bound = int(np.abs(queries).max(initial=0)) * self.most * max(1, min(queries.shape[1], len(self.lists)))
        if bound >= 1 << 63:
            raise OverflowError("a score may not fit in a long")
        kind = np.int32 if bound < 1 << 31 else np.int64
        total = np.zeros((len(queries), self.rows), kind)
        queries = queries.astype(kind)
        product = np.empty_like(total)
        for weights, (rows, posted) in zip(queries.T, self.lists, strict=False):
            asking = np.flatnonzero(weights)
            if not len(asking) or not len(posted):
                continue
            posted = posted.astype(kind)
            if rows is None and len(asking) == len(queries):
                total += np.multiply.outer(weights, posted, out=product)
            elif rows is None:
                total[asking] += np.multiply.outer(weights[asking], posted)
            else:
                total[np.ix_(asking, rows)] += np.multiply.outer(weights[asking], posted)
        return total

    def best(self, ids: list[int | None], queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and scores of its `k` best rows, in no order; a row
        with the query's own id is not one of them."""
        every = np.arange(self.rows)
        for i, score in zip(ids, self.scores(queries), strict=True):
            places, (low, high) = every, self.first.get(i, (0, 0))
            if low < high:
                places, score = np.delete(places, slice(low, high)), np.delete(score, slice(low, high))
            if len(score) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                above = np.flatnonzero(score > least)
                level = np.flatnonzero(score == least)[: k - len(above)]
                chosen = np.concatenate([above, level])
                places, score = places[chosen], score[chosen]
            yield places, score


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, the rows to search before the queries: the best of each block."""
    block, ids, weights, postings = None, [], [], None
    for batch in batches:
        blocks, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
        for at, until in zip([0, *edges], [*edges, len(blocks)], strict=True):
            some = batch.slice(at, until - at)
            if not some.num_rows:
                continue
            if blocks[at] != block:
                block, ids, weights, postings = blocks[at], [], [], None
            if not asks[at]:
                ids += some.column("vec_id").to_pylist()
                weights += some.column("weights").to_pylist()
                continue
            if postings is None:
                postings, ids, weights = Postings(ids, weights), [], []
            for start in range(0, some.num_rows, QUERIES_AT_ONCE):
                few = some.slice(start, QUERIES_AT_ONCE)
                yield _picked(few, postings, k)


def _picked(few: pa.RecordBatch, postings: Postings, k: int) -> pa.RecordBatch:
    ids, keys = few.column("vec_id").to_pylist(), few.column("query").to_pylist()
    found = list(postings.best(ids, matrix(few.column("weights").to_pylist()), k))
    counts = [len(p) for p, _ in found]
    places = np.concatenate([p for p, _ in found])
    repeated = np.repeat(np.arange(few.num_rows), counts)
    return pa.record_batch(
        [
            pa.array([keys[i] for i in repeated], pa.string()),
            pa.array([ids[i] for i in repeated], pa.int64()),
            pa.array([postings.ids[p] for p in places], pa.int64()),
            pa.array(np.concatenate([s for _, s in found]).astype(np.int64)),
        ],
        ["query", "query_id", "vec_id", "score"],
    )


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    scale: int = SCALE,
    id: str = "vec_id",
    vector: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the `k` rows of highest score.

    The score is the inner product of floor(scale * x); the shorter of two vectors counts
    as ended by zeros. Queries are the rows of `vectors` that meet `is_query`, a condition
    on `vec_id`, the id as a long; they are searched against all rows but those with
    their own id. Equal scores go to the smaller id, a null id last. Rows that repeat an
    id are searched each for itself; as queries, rows with the same id and vector are one
    query, and those with another vector are ranked apart. Rows without an id are found but
    never ask, unless `is_query` says so. Null vectors, and vectors with a component that is
    null or not finite, take no part; an empty vector scores zero everywhere. A score that
    may not fit in a long raises an error. No rows, no answers.

    Rows are dealt to blocks one by one, so copies of a vector do not gather in a block. A
    task holds a block and streams the queries past it; it returns no more than `k` rows for
    a query and block, cut to `k` for a query before they are shuffled.
    """
    spark = vectors.sparkSession
    stored = materialize(whole_vectors(vectors, scale, id, vector), "whole-vectors")
    rows = stored.count()
    # a block for each core at least; what a block holds does not change what is found
    blocks = max(1, -(-rows // block), min(spark.sparkContext.defaultParallelism, -(-rows // 512)))
    own = F.pmod(F.xxhash64("part", "row"), F.lit(blocks)).cast("int")
    key = F.concat(F.coalesce(F.col("vec_id").cast("string"), F.lit("-")), F.lit(":"), F.sha2("weights", 256))
    members = stored.select(
        own.alias("block"), F.lit(False).alias("asks"), F.lit(None).cast("string").alias("query"), "vec_id", "weights"
    )
    asking = stored.where(is_query).groupBy("vec_id", "weights").agg(F.count("*").alias("rows"))
    queries = asking.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.lit(True).alias("asks"), key.alias("query"), "vec_id", "weights",
    )
    picked = (
        members.unionByName(queries)
        .repartitionById(blocks, F.col("block"))
        .sortWithinPartitions("block", "asks")
        .mapInArrow(lambda batches: _searched(batches, k), "query string, query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        picked.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
