"""Merkle manifest: a hash tree over each group of rows, one over the groups, and proofs.

A node's label is its tree, its level and the interval [lo, hi) of ranks of the leaves it
covers. Levels are taken in bands of SPAN. A bucket is a node at the upper edge of a band
with the nodes of the band below it, at most 2 ** SPAN at the lower edge; it is one row, so a
tree of any size is many. Going up, the nodes at the lower edge of a bucket are hashed to its
root, which is a node at the lower edge of the next band. Going down, what lies above a
bucket is attached to it by a join on containment, tree by tree and band by band. Within a
bucket, the sibling of a node is what remains of its parent's interval without its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridweave.llm.common import map_arrow
from gridweave.operators.numbering import dense_index
from gridweave.session import materialize

# Levels of a band.
SPAN = 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# A step of a proof is a byte that tells where the sibling lies, and its digest.
ALONE, LEFT, RIGHT = 0, 1, 2
STEP = 33


def field(value: Column) -> Column:
    """A value in the input of a leaf's digest: its length in bytes and its text, or `-`."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    """SHA-256 of the fields of a row, in lowercase hex digits."""
    return F.sha2(F.concat(*map(field, values)), 256)


def hashed(children: bytes) -> bytes:
    """The digest of a node from the hex digits of its children, as hex digits."""
    return hashlib.sha256(children).hexdigest().encode()


def cover(level: int, place: int, count: int) -> tuple[int, int]:
    """The interval of ranks under the node at `place` of `level`, over `count` leaves."""
    return min(place << level, count), min((place + 1) << level, count)


def levels_of(digests: list[bytes], levels: int | None) -> list[list[bytes]]:
    """All levels over a row of nodes: `levels` of them, or until one node remains."""
    out = [digests]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        below = out[-1]
        out.append([hashed(b"".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return out


def steps_of(levels: list[list[bytes]]) -> list[bytes]:
    """For each node of the lowest level its steps up to the highest, lowest first."""
    count = len(levels[0])
    steps = [b""]
    for level in range(len(levels) - 2, -1, -1):
        nodes, below = levels[level], []
        for place in range(len(nodes)):
            lo, hi = cover(level, place, count)
            first, last = cover(level + 1, place >> 1, count)
            if first < lo:  # what the parent covers before the node
                step = bytes([LEFT]) + bytes.fromhex(nodes[first >> level].decode())
            elif hi < last:  # and after it
                step = bytes([RIGHT]) + bytes.fromhex(nodes[hi >> level].decode())
            else:
                step = bytes(STEP)
            below.append(step + steps[place >> 1])
        steps = below
    return steps


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its proof lead to; digests as hex digits."""
    digits = proof.hex().encode()
    for at in range(0, 2 * len(proof), 2 * STEP):
        side, sibling = proof[at // 2], digits[at + 2 : at + 2 * STEP]
        leaf = hashed(sibling + leaf if side == LEFT else leaf + sibling if side == RIGHT else leaf)
    return leaf


def siblings(proof: bytes) -> bytes:
    """The hex digits of the siblings of a proof, one after the other."""
    return b"".join(
        proof[at + 1 : at + STEP].hex().encode() for at in range(0, len(proof), STEP) if proof[at] != ALONE
    )


def _reach(band: int, span: int) -> int:
    """Leaves that a bucket of a band can cover."""
    return 1 << span * (band + 1)


def _levels(band: int, n: int, span: int) -> int | None:
    return span if n > _reach(band, span) else None


def raised(nodes: DataFrame, carry: list[str], span: int = SPAN) -> tuple[list[DataFrame], DataFrame]:
    """Buckets by band, and (tree, digest) of the roots, over leaves (tree, lo, n, digest).

    `n` is the number of leaves of the tree. A bucket is (tree, bucket, lo, hi, n, digests, kept):
    the digests at its lower edge in order, and for leaves the columns `carry`. Its
    members are at most 2 ** `span` rows, gathered by (tree, bucket).
    """
    most = nodes.agg(F.max("n")).first()[0] or 1
    buckets: list[DataFrame] = []
    roots: list[DataFrame] = []
    while not buckets or _reach(len(buckets) - 1, span) < most:
        band = len(buckets)
        kept = F.struct(*(["lo", *carry] if not band else ["lo"]))
        gathered = (
            nodes.groupBy("tree", F.shiftright("lo", span * (band + 1)).alias("bucket"))
            .agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("lo", "digest", kept.alias("kept")))).alias("of"))
            .select(
                "tree", "bucket", (F.col("bucket") * _reach(band, span)).alias("lo"),
                F.least((F.col("bucket") + 1) * _reach(band, span), "n").alias("hi"), "n",
                F.col("of.digest").alias("digests"), F.col("of.kept").alias("kept"),
            )
        )
        buckets.append(materialize(gathered, "merkle-buckets"))
        tops = materialize(_bucket_roots(buckets[-1], band, span), "merkle-nodes")
        roots.append(tops.where(F.col("n") <= _reach(band, span)))
        nodes = tops.where(F.col("n") > _reach(band, span))
    return buckets, reduce(DataFrame.unionByName, roots).select("tree", "digest")


def _bucket_roots(buckets: DataFrame, band: int, span: int) -> DataFrame:
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, members = batch.column("n").to_pylist(), batch.column("digests").to_pylist()
        top = [
            bytes.fromhex(levels_of([d.hex().encode() for d in digests], _levels(band, n, span))[-1][0].decode())
            for n, digests in zip(counts, members, strict=True)
        ]
        names = ["tree", "lo", "n"]
        return pa.record_batch([*map(batch.column, names), pa.array(top, pa.binary())], [*names, "digest"])

    slim = buckets.select("tree", "lo", "n", "digests")
    return map_arrow(slim, rows, "tree long, lo long, n long, digest binary")


def lowered(buckets: list[DataFrame], tops: DataFrame, span: int = SPAN) -> DataFrame:
    """(tree, lo, kept, proof, subroot, root) for every leaf: its steps to the root of its
    tree, then those of `tops` (tree, proof, subroot, root)."""
    ends = ["subroot", "root"]
    above = None
    for band in range(len(buckets) - 1, -1, -1):
        part = buckets[band]
        # trees that end in this band; the others have a node above each of their buckets
        begun = part.where(F.col("n") <= _reach(band, span)).join(tops, "tree")
        if above is not None:
            node = above.select(
                "tree", F.col("lo").alias("from"), F.least(F.col("lo") + _reach(band, span), "n").alias("until"),
                F.shiftright("lo", span * (band + 1)).alias("bucket"), "proof", *ends,
            )
            inside = (F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("until"))
            begun = begun.unionByName(
                part.join(node, ["tree", "bucket"]).where(inside).select(*begun.columns)
            )
        above = _member_paths(begun, band, span)
        if band:
            above = materialize(above, "merkle-paths")
    return above


def _member_paths(buckets: DataFrame, band: int, span: int) -> DataFrame:
    kept = buckets.schema["kept"].dataType.elementType

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i] for c in batch.schema.names}
                digests = [d.hex().encode() for d in one["digests"].as_py()]
                paths = steps_of(levels_of(digests, _levels(band, one["n"].as_py(), span)))
                rest = one["proof"].as_py()
                same = (pa.array([one[c].as_py()] * len(paths), batch.schema.field(c).type) for c in ("tree", "n", "subroot", "root"))
                members = one["kept"].values
                yield pa.record_batch(
                    [
                        *same, members.field("lo"), members,
                        pa.array([d.as_py() for d in one["digests"].values], pa.binary()),
                        pa.array([p + rest for p in paths], pa.binary()),
                    ],
                    ["tree", "n", "subroot", "root", "lo", "kept", "digest", "proof"],
                )

    slim = buckets.select("tree", "n", "digests", "kept", "proof", "subroot", "root")
    schema = f"tree long, n long, subroot binary, root binary, lo long, kept {kept.simpleString()}, digest binary, proof binary"
    return slim.mapInArrow(over, schema)


def manifest(
    leaves: DataFrame, id: str, group: str, leaf: str, carry: list[str] | None = None, span: int = SPAN
) -> DataFrame:
    """One row for every row of `leaves`: (id, group, leaf, *carry, tree, lo, subroot, root, proof).

    `leaf` holds digests in hex digits. Rows of equal `group` are the leaves of a tree, in
    order of id, null first, and equal ids in order of their digests. Every two nodes in
    a row become one, a last one alone too, until one remains: the `subroot`. Subroots in
    order of group, null first, by UTF-8 bytes, make `root` in the same way. `tree` and `lo`
    are the places of the group and of the leaf. `proof` has the steps from the leaf to the
    root for `fold` and `siblings`. Rows that repeat are leaves each. No rows, no manifest.

    Leaves are ranked by one range shuffle, in which repeated rows are told apart by
    their place, so neither a group nor an id that many rows share is one task. Whatever
    is gathered is a bucket of at most 2 ** `span` nodes.
    """
    carry = carry or []
    slim = leaves.select(
        F.col(id).alias("id"), F.col(group).alias("group"), F.unhex(leaf).alias("digest"),
        F.struct(F.lit(0).alias("_"), *carry).alias("carried"), F.monotonically_increasing_id().alias("place"),
    )
    stored = materialize(slim, "merkle-leaves")
    order = [F.asc_nulls_first("group"), F.asc_nulls_first("id"), F.col("digest"), F.col("place")]
    ranked = dense_index(stored, order, "at")
    groups = ranked.groupBy("group").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    trees = materialize(dense_index(groups, [F.asc_nulls_first("group")], "tree"), "merkle-trees")
    named = trees.withColumnRenamed("group", "named")
    placed = ranked.join(named, F.col("group").eqNullSafe(F.col("named"))).select(
        "tree", (F.col("at") - F.col("first")).alias("lo"), "n", "digest", "id", "group", "carried"
    )
    buckets, subroots = raised(placed, ["id", "group", "carried"], span)
    count = trees.count()
    upper, root = raised(
        subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("lo"), F.lit(count).cast("long").alias("n"), "digest"),
        [],
        span,
    )
    start = root.select("tree", F.lit(b"").alias("proof"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    tops = materialize(
        lowered(upper, start, span).select(F.col("lo").alias("tree"), "proof", F.col("digest").alias("subroot"), "root"),
        "merkle-trees",
    )
    text = {c: F.lower(F.hex(c)) for c in ("digest", "subroot", "root")}
    return lowered(buckets, tops, span).select(
        F.col("kept.id").alias(id), F.col("kept.group").alias(group), text["digest"].alias(leaf),
        *(F.col(f"kept.carried.{c}").alias(c) for c in carry),
        "tree", "lo", text["subroot"].alias("subroot"), text["root"].alias("root"), "proof",
    )


def checked(proofs: DataFrame, claimed: str) -> DataFrame:
    """Add `folded_root`, what the digest `claimed` leads to by the row's proof, `proof_sha256`,
    the hash of the proof's siblings, and `verified`, whether the folded root is the root."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        steps = batch.column("proof").to_pylist()
        leaves = batch.column("_claimed").to_pylist()
        folded = [None if x is None else fold(x.encode(), p).decode() for x, p in zip(leaves, steps, strict=True)]
        others = [hashed(siblings(p)).decode() for p in steps]
        kept = [c for c in batch.schema.names if c != "_claimed"]
        return pa.record_batch(
            [*map(batch.column, kept), pa.array(folded, pa.string()), pa.array(others, pa.string())],
            [*kept, "folded_root", "proof_sha256"],
        )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema)
    return map_arrow(
        proofs.withColumn("_claimed", F.col(claimed)), rows, f"{schema}, folded_root string, proof_sha256 string"
    ).withColumn("verified", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False)))


def tampered_manifest(docs: DataFrame, every: int = 7, span: int = SPAN) -> DataFrame:
    """The manifest of `docs` by language, held against leaves of which some are tampered with.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row. A
    leaf is the digest of the columns COLUMNS. Where `every` divides the crc32 of the id,
    one is added to `n_chars` before the claimed leaf is worked out; a null stays, and a null id
    is never tampered with.
    """
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    values = {c: F.col(c) for c in COLUMNS}
    wrong = values | {"n_chars": F.col("n_chars") + 1}
    leaves = docs.select(
        "doc_id", "lang", row_digest(*values.values()).alias("leaf"),
        F.when(chosen, F.unhex(row_digest(*wrong.values()))).alias("tampered"),
    )
    found = manifest(leaves, "doc_id", "lang", "leaf", ["tampered"], span)
    claimed = found.withColumn("claimed", F.coalesce(F.lower(F.hex("tampered")), "leaf")).drop("tampered")
    return checked(claimed, "claimed").select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )
