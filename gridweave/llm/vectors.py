"""Near-duplicate vectors: inverted lists, product-quantised residuals, exact rerank."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridweave.llm.common import map_arrow
from gridweave.llm.components import connected_components
from gridweave.session import materialize

COSINE = 0.98
# The model is trained on at most this many vectors for each inverted list, at least
# LEAST_TRAINED in all, and on no more than MOST_LISTS lists ask for.
TRAINED_PER_LIST = 16
LEAST_TRAINED = 8192
# Vectors of one list, about; and the most lists.
LIST_VECTORS = 1000
MOST_LISTS = 4096
SUBSPACES = 8
CODES = 64
ROUNDS = 6
# Vectors of either side that one task compares at a time.
PART = 4096
QUERIES_AT_ONCE = 64
# Vectors compared with all centroids at a time.
ROWS_AT_ONCE = 1024
# A part of pairs above which products of whole blocks are cheaper than of single pairs.
DENSE = 0.05
SLACK = 1e-6


@dataclass
class Model:
    """Unit centroids of the inverted lists, and code books for residuals by subspace."""

    centroids: np.ndarray  # lists x width
    books: np.ndarray  # subspaces x codes x width / subspaces

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    @cached_property
    def apart(self) -> np.ndarray:
        """Distances between centroids, worked out once in each worker."""
        return np.sqrt(np.maximum(0, 2 - 2 * self.centroids @ self.centroids.T))


def _closest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The list of each unit vector; memory does not grow with vectors times lists."""
    parts = [(x[at : at + ROWS_AT_ONCE] @ centroids.T).argmax(1) for at in range(0, len(x), ROWS_AT_ONCE)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x @ book.T - (book * book).sum(1) / 2).argmax(1)


def _means(x: np.ndarray, of: np.ndarray, old: np.ndarray) -> np.ndarray:
    counts = np.bincount(of, minlength=len(old))
    sums = np.zeros_like(old)
    np.add.at(sums, of, x)
    return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], old)


def train(sample: np.ndarray, lists: int, seed: int = 0) -> Model:
    """k-means on the sphere for the lists, then k-means of residuals in each subspace."""
    rng = np.random.default_rng(seed)
    width = -(-sample.shape[1] // SUBSPACES) * SUBSPACES
    x = padded(sample, width)
    centroids = x[rng.permutation(len(x))[: max(1, min(lists, len(x)))]].copy()
    for _ in range(ROUNDS):
        centroids = _means(x, _closest(x, centroids), centroids)
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    residual = (x - centroids[_closest(x, centroids)]).reshape(len(x), SUBSPACES, -1)
    books = []
    for s in range(SUBSPACES):
        part = residual[:, s]
        book = part[rng.permutation(len(part))[:CODES]].copy()
        for _ in range(ROUNDS):
            book = _means(part, _nearest(part, book), book)
        books.append(np.vstack([book, np.zeros((CODES - len(book), book.shape[1]))]))
    return Model(centroids, np.stack(books))


def padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def encode(model: Model, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List, residual code and distance from the decoded vector, for each unit vector."""
    cell = _closest(unit, model.centroids)
    residual = (unit - model.centroids[cell]).reshape(len(unit), SUBSPACES, -1)
    code = np.stack([_nearest(residual[:, s], model.books[s]) for s in range(SUBSPACES)], 1)
    decoded = np.stack([model.books[s][code[:, s]] for s in range(SUBSPACES)], 1)
    return cell, code.astype(np.uint8), np.sqrt(((residual - decoded) ** 2).sum((1, 2)))


def probes(model: Model, unit: np.ndarray, radius: float) -> list[np.ndarray]:
    """For each vector, all lists that may hold a vector within `radius` of it.

    A vector of list j is at least as near to centroid j as to the centroid b that is
    nearest to the query, so the query's products with b and j differ by no more than
    radius * |b - j|.
    """
    out = []
    for at in range(0, len(unit), ROWS_AT_ONCE):
        products = unit[at : at + ROWS_AT_ONCE] @ model.centroids.T
        best = products.argmax(1)
        gap = products[np.arange(len(best)), best][:, None] - products
        out += [np.flatnonzero(row) for row in gap <= radius * model.apart[best] + SLACK]
    return out


def asked_lists(cell: np.ndarray, possible: list[np.ndarray]) -> list[np.ndarray]:
    """Of the possible lists, each vector's own and those that it is the one to ask.

    Both vectors of a link find each other's list possible, so one of them is enough. Of two
    lists, the lower number asks if both are odd or both even, else the higher, so every
    list asks about half of the others.
    """
    return [p[(p == c) | ((c < p) == ((c + p) % 2 == 0))] for c, p in zip(cell, possible, strict=True)]


def table_distances(model: Model, cell: int, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Distances of queries to decoded vectors of a list: for each query a table of squared
    distances of its residual to every code word, summed up along the codes."""
    residual = (queries - model.centroids[cell]).reshape(len(queries), SUBSPACES, -1)
    total = np.zeros((len(queries), len(codes)), np.float32)
    for s in range(SUBSPACES):
        book = model.books[s]
        table = ((residual[:, s, None] - book) ** 2).sum(2).astype(np.float32)
        total += table[:, codes[:, s]]
    return np.sqrt(total)


def block_links(model: Model, cell: int, q: dict, m: dict, cosine: float) -> np.ndarray:
    """Which queries (rows) link to which members (columns) of a list."""
    radius = sqrt(2 - 2 * cosine)
    linked = np.zeros((len(q["id"]), len(m["id"])), bool)
    for at in range(0, len(q["id"]), QUERIES_AT_ONCE):
        part = slice(at, at + QUERIES_AT_ONCE)
        near = table_distances(model, cell, q["unit"][part], m["code"]) - m["error"] <= radius + 1e-4
        rows, columns = np.nonzero(near)
        if len(rows) > DENSE * near.size:
            linked[part] = near & (q["unit"][part] @ m["unit"].T >= cosine)
        else:
            exact = np.einsum("ij,ij->i", q["unit"][part][rows], m["unit"][columns])
            linked[part][rows, columns] = exact >= cosine
    return linked


def _stars(q_id: np.ndarray, m_id: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what `linked` connects: each node of a connected part with one."""
    out: list[tuple[int, int]] = []
    free = linked.any(1)
    while free.any():
        first = int(free.argmax())
        rows = np.zeros(len(q_id), bool)
        rows[first] = True
        columns = np.zeros(len(m_id), bool)
        fresh = rows
        while fresh.any():
            reached = linked[fresh].any(0) & ~columns
            columns |= reached
            fresh = linked[:, reached].any(1) & ~rows
            rows |= fresh
        root = int(q_id[first])
        out += [(int(x), root) for x in np.concatenate([q_id[rows], m_id[columns]]) if x != root]
        free &= ~rows
    return out


def unit_vectors(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(vec_id, label, vector, usable) for every row: `vector` as doubles of length 1.

    Rows with a null id or label, with a null, empty or zero vector, or with a component
    that is null or not finite, are not usable, and their vector is null.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i, group, v in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "vector")), strict=True):
            x = None
            if i is not None and group is not None and v and None not in v:
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                x = x / top if np.isfinite(top) and top > 0 else None
            out.append(None if x is None else x / np.linalg.norm(x))
        return pa.record_batch(
            [batch.column("vec_id"), batch.column("label"), pa.array(out, pa.list_(pa.float64()))],
            ["vec_id", "label", "vector"],
        )

    slim = vectors.select(
        F.col(id).cast("long").alias("vec_id"),
        F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    return map_arrow(slim, rows, "vec_id long, label string, vector array<double>")


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def links(classes: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """For distinct vectors (node, label, vector, copies): (node, n), how many other vectors
    each links to, counting copies; and (a, b), links that connect what these connect.

    Vectors of one label and length meet in inverted lists. Each vector is a member of one
    list. It asks that list, and of the others that can hold a link of it those that do
    not ask its own; such a link counts at both ends. Lists of codes are looked up in tables, and what the error of the code leaves possible is compared exactly. A list is
    cut in parts of bounded size; each part of its queries meets each part of its members
    in a group of its own, so a list that holds a third of all vectors is many groups.
    Groups return sums and spanning links, never pairs.
    """
    spark = classes.sparkSession
    n, width = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        none = spark.createDataFrame([], "node long, n long")
        return none, spark.createDataFrame([], "a long, b long")
    lists = min(MOST_LISTS, max(1, n // LIST_VECTORS))
    sample = (
        classes.orderBy(F.xxhash64("node"), "node").select("vector").limit(max(LEAST_TRAINED, TRAINED_PER_LIST * lists)).toPandas()
    )
    model = train(_matrix(sample["vector"], width), lists)
    shared = spark.sparkContext.broadcast(model)
    radius = sqrt(2 - 2 * cosine)

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        unit = _matrix(batch.column("vector").to_pylist(), shared.value.width)
        cell, code, error = encode(shared.value, unit)
        asked = [row.tolist() for row in asked_lists(cell, probes(shared.value, unit, radius))]
        return pa.record_batch(
            [
                *(batch.column(c) for c in ("node", "label", "vector", "copies")),
                pa.array(cell, pa.int32()),
                pa.array([c.tobytes() for c in code], pa.binary()),
                pa.array(error),
                pa.array(asked, pa.list_(pa.int32())),
            ],
            ["node", "label", "vector", "copies", "cell", "code", "error", "asked"],
        )

    placed = materialize(
        map_arrow(
            classes.select("node", "label", "vector", "copies"),
            assign,
            "node long, label string, vector array<double>, copies long, cell int, code binary, error double, asked array<int>",
        ),
        "vector-lists",
    ).withColumn("width", F.size("vector"))
    key = ["label", "width", "cell"]
    members = placed.select(*key, "node", "vector", "copies", "code", "error", F.lit(False).alias("asks"), F.lit(True).alias("at_home"))
    queries = placed.select(
        "label", "width", F.col("cell").alias("home"), F.explode("asked").alias("cell"), "node", "vector", "copies", "code", "error"
    ).select(*key, "node", "vector", "copies", "code", "error", F.lit(True).alias("asks"), (F.col("home") == F.col("cell")).alias("at_home"))
    # one row per list and side: as many as there are lists, not vectors
    counts = materialize(
        members.select(*key, "asks").unionByName(queries.select(*key, "asks")).groupBy(*key).agg(
            F.ceil(F.count_if("asks") / PART).cast("int").alias("query_parts"),
            F.ceil(F.count_if(~F.col("asks")) / PART).cast("int").alias("member_parts"),
        ).where("member_parts > 0"),
        "list-sizes",
    )
    own = F.pmod(F.xxhash64("node"), F.when(F.col("asks"), F.col("query_parts")).otherwise(F.col("member_parts")))
    against = F.when(F.col("asks"), F.col("member_parts")).otherwise(F.col("query_parts"))
    groups = (
        members.unionByName(queries)
        .join(counts, key)
        .select("*", own.cast("int").alias("own"), F.explode(F.sequence(F.lit(0), against - 1)).alias("other"))
        .select(
            *key, "node", "vector", "copies", "code", "error", "asks", "at_home",
            F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("q"),
            F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("m"),
        )
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for side in (group[group["asks"]], group[~group["asks"]]):
            sides.append(
                {
                    "id": side["node"].to_numpy(),
                    "copies": side["copies"].to_numpy(),
                    "at_home": side["at_home"].to_numpy(bool),
                    "unit": _matrix(side["vector"], shared.value.width),
                    "error": side["error"].to_numpy(np.float32),
                    "code": np.frombuffer(b"".join(side["code"]), np.uint8).reshape(-1, SUBSPACES),
                }
            )
        q, m = sides
        if not len(q["id"]) or not len(m["id"]):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        linked = block_links(shared.value, int(group["cell"].iloc[0]), q, m, cosine)
        linked &= q["id"][:, None] != m["id"]
        # links within a list are found from both ends, others from one
        abroad = ~q["at_home"]
        ids = np.concatenate([q["id"], m["id"]])
        n = np.concatenate([linked @ m["copies"], q["copies"][abroad] @ linked[abroad]])
        some = n > 0
        counted = pd.DataFrame({"a": ids[some], "b": None, "n": n[some]})
        stars = pd.DataFrame(_stars(q["id"], m["id"], linked), columns=["a", "b"])
        return pd.concat([counted, stars.assign(n=None)]).astype({"a": "int64", "b": "Int64", "n": "Int64"})

    found = materialize(groups.groupBy(*key, "q", "m").applyInPandas(compare, "a long, b long, n long"), "vector-links")
    sums = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    return sums, found.where("b is not null").select("a", "b").distinct()


def vector_components(
    vectors: DataFrame,
    cosine: float = COSINE,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors`.

    Two rows link if their labels are equal and the cosine of their vectors, of one
    length, is at least `cosine`. Rows with the same label and direction are one node
    with a number of copies, named by the smallest id, before lists are built. A row that
    is not usable (see `unit_vectors`) links with nothing: no links, its own component. A
    row without an id has no component and is kept. Rows that repeat an id count as rows
    in `n_links` and share their component. No rows, no answers.
    """
    rows = materialize(unit_vectors(vectors, id, vector, label), "unit-vectors")
    usable = rows.where(F.col("vector").isNotNull())
    classes = materialize(
        usable.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "vector-classes"
    )
    sums, stars = links(classes, cosine)
    several = usable.join(classes, ["label", "vector"]).where(F.col("vec_id") != F.col("node"))
    repeated = rows.where("vec_id is not null").groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        ties = several.select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
        stars = stars.unionByName(ties.distinct())
    roots = connected_components(stars)
    named = (
        classes.join(roots, "node", "left")
        .join(sums, "node", "left")
        .select(
            "label", "vector", F.coalesce("root", "node").alias("root"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
        )
    )
    return rows.join(named, ["label", "vector"], "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id"),
        (F.col("vec_id").isNull() | (F.coalesce("root", "vec_id") == F.col("vec_id"))).alias("kept"),
    )
