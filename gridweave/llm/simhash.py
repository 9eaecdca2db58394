"""SimHash near-duplicates: fingerprints, block joins, components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gridweave.llm.common import map_arrow, texts
from gridweave.llm.components import connected_components
from gridweave.session import materialize

BITS = 64
SHINGLES_AT_ONCE = 1 << 16
# Distinct fingerprints that evenly spread ones would put under one key.
EVEN_GROUP = 64
# Fingerprints compared with each other in one step; a larger group is cut in parts.
PART = 4096
SMALL_GROUP = 256


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """The SimHash of a text as an unsigned 64-bit number.

    Features are the hashes of all shingles of `words` words, repeats included, of the
    text with A-Z in lower case; a shorter text is one shingle; no word, zero. A bit is
    set if more than half of the hashes have it.
    """
    found = text.lower().split() if text else []
    if not found:
        return 0
    count = max(1, len(found) - words + 1)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[: count - 1])).tolist()
    stops = (ends[len(found) - count :] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, count, SHINGLES_AT_ONCE):
        some = slice(at, at + SHINGLES_AT_ONCE)
        hashes = np.array(
            [digest(joined[i:j], seed) for i, j in zip(starts[some], stops[some], strict=True)], "<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), 1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp) for every row; `fp` has the 64 bits as a signed long."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, words) for t in texts(batch)], "<u8").view("<i8")
        return pa.record_batch([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    return map_arrow(
        docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")),
        rows,
        "doc_id long, fp long",
    )


def block_count(fingerprints: int, distance: int) -> int:
    """Blocks to cut the bits in, so that the blocks a close pair must share spread
    `fingerprints` values in groups of about EVEN_GROUP."""
    need = log2(max(2, fingerprints / EVEN_GROUP))
    return next(
        b for b in range(distance + 1, 2 * BITS) if b >= BITS or BITS * (b - distance) // b >= need
    )


def block_masks(blocks: int, distance: int) -> list[int]:
    """A bit mask for each set of `blocks - distance` blocks. Fingerprints that differ in
    at most `distance` bits touch at most that many blocks, so they are equal under at
    least one mask."""
    cuts = [round(BITS * i / blocks) for i in range(blocks + 1)]
    part = [((1 << j) - 1) ^ ((1 << i) - 1) for i, j in zip(cuts, cuts[1:], strict=False)]
    return [sum(p) for p in combinations(part, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def block_keys(fp: Column, masks: list[int]) -> Column:
    """An array of keys of a fingerprint: for each mask, what lies under it."""
    listed = F.array([F.struct(F.lit(i).alias("i"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(masks)])
    return F.transform(listed, lambda x: F.xxhash64(x["i"], fp.bitwiseAND(x["m"])))


def near_links(prints: DataFrame, keys: Column, distance: int, part: int = PART) -> DataFrame:
    """(a, b): links that connect the same nodes as all pairs that share a key and differ
    in at most `distance` bits.

    `prints` is (node, fp) with distinct fp. A fingerprint goes to a group for each of its
    keys. Within a group all fingerprints are compared, in a task that streams groups from
    sorted rows; out comes a star for each connected part of a group, so never more rows
    than members. A group of over `part` members is cut in parts by hash and each two parts
    meet in a group of their own, which keeps memory bounded and no pair unseen.
    """
    keyed = prints.select("node", "fp", F.explode(keys).alias("key"))
    large = materialize(
        keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > part), "large-groups"
    ).select("key", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.col("other")
    pair = F.when(F.col("parts").isNull(), F.col("key")).otherwise(
        F.xxhash64("key", F.least(own, other), F.greatest(own, other))
    )
    groups = (
        keyed.join(large, "key", "left")
        .select("*", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("other"))
        .select("node", "fp", pair.alias("key"))
    )
    tasks = prints.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return (
        groups.repartition(int(tasks), "key")
        .sortWithinPartitions("key")
        .mapInArrow(lambda batches: _stars(batches, distance), "a long, b long")
        .distinct()
    )


def _stars(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    held: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        got = tuple(batch.column(c).to_numpy() for c in ("key", "node", "fp"))
        if held is not None:
            got = tuple(np.concatenate(x) for x in zip(held, got, strict=True))
        last = np.searchsorted(got[0], got[0][-1])  # the last group may go on
        held = tuple(x[last:] for x in got)
        yield from _compared(*(x[:last] for x in got), distance)
    if held is not None:
        yield from _compared(*held, distance)


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _compared(key, node, fp, distance: int) -> Iterator[pa.RecordBatch]:
    if not len(key):
        return
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    twos = starts[sizes == 2]
    near = twos[_differing(fp[twos], fp[twos + 1]) <= distance]
    a, b = [node[near]], [node[near + 1]]
    for i, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        child, root = _group_stars(node[i : i + n], fp[i : i + n], distance)
        a.append(child)
        b.append(root)
    yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _group_stars(node, fp, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Child and root for each member of a connected part, by search from unseen members."""
    empty = np.zeros(0, node.dtype)
    if len(fp) <= SMALL_GROUP:  # mostly nothing is close
        if (_differing(fp[:, None], fp) <= distance).sum() == len(fp):
            return empty, empty
    unseen = np.arange(len(fp))
    child, root = [], []
    while len(unseen) > 1:
        start, unseen = unseen[0], unseen[1:]
        edge = [start]
        while edge and len(unseen):
            close = _differing(fp[unseen], fp[edge.pop()]) <= distance
            if close.any():
                found = unseen[close]
                unseen = unseen[~close]
                edge.extend(found)
                child.append(node[found])
                root.append(np.full(len(found), node[start]))
    return np.concatenate([empty, *child]), np.concatenate([empty, *root])


@dataclass(frozen=True)
class Near:
    """Fingerprints of shingles of `words` words that differ in at most `distance` bits, every
    pair of them: by the pigeonhole rule such a pair shares the blocks under a mask."""

    words: int = 4
    distance: int = 4

    def keys(self, fp: Column, count: int) -> Column:
        return block_keys(fp, block_masks(block_count(count, self.distance), self.distance))


def simhash_components(
    docs: DataFrame, id: str = "doc_id", text: str = "text", near: Near = Near()
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs`; `near` says what links.

    Rows with equal fingerprints become one node, named by its smallest id, before
    anything is compared; a group of copies of any size is one row. `component_id` is
    the smallest id that links reach. Rows with equal ids are one document. A row
    without an id takes no part in linking and has no component. Null and blank texts
    have fingerprint zero and link like any other. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, id, text, near.words), "fingerprints")
    nodes = materialize(
        prints.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node")),
        "distinct-fingerprints",
    )
    same_id = (
        prints.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("fp").alias("fp"), F.max("fp").alias("last"))
        .where(F.col("fp") != F.col("last"))
    )
    links = near_links(nodes, near.keys(F.col("fp"), nodes.count()), near.distance)
    if not same_id.isEmpty():  # an id that stands for several texts ties them together
        links = links.unionByName(_ties(prints, nodes))
    roots = connected_components(links)
    placed = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("_root"))
    placed = materialize(placed, "fingerprint-roots")
    return prints.join(placed, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("_root")).alias("component_id")
    )


def _ties(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    of = prints.where(F.col("doc_id").isNotNull()).join(nodes, "fp").select("doc_id", "node")
    return of.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()


def as_hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def drop_near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", near: Near = Near()
) -> DataFrame:
    """The rows of `docs` whose document is the smallest of its component, all columns.

    Of rows with the same id one stays. Rows without an id stay. Only the ids of documents
    that go are joined to `docs`, as a column that bears no name of its own.
    """
    found = simhash_components(docs, id, text, near)
    ids = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("component_id").alias("component_id")
    )
    gone = materialize(
        ids.where((F.col("n") > 1) | (F.col("doc_id") != F.col("component_id"))), "near-duplicates"
    )
    left = _held_against(docs, id, gone, "left_anti")
    again = gone.where(F.col("doc_id") == F.col("component_id"))
    if again.isEmpty():
        return left
    return left.unionByName(_held_against(docs, id, again, "left_semi").dropDuplicates([id]))


def _held_against(docs: DataFrame, id: str, others: DataFrame, how: str) -> DataFrame:
    fresh = "_" * (1 + max(map(len, docs.columns)))  # longer than any name of docs
    return docs.join(others.select(F.col("doc_id").alias(fresh)), F.col(id).cast("long") == F.col(fresh), how)
