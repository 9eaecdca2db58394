"""Node ids, node types and edge labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from gridweave.schemas import NODE_TYPES, RELATIONS


def node_id(gid: Column, row: Column, col: Column) -> Column:
    return F.concat_ws("-", gid, row, col)


def parse_node_id(id: Column) -> Column:
    """`gid-row-col` as struct<gid: long, row: int, col: int>."""
    parts = F.split(id, "-")
    return F.struct(
        parts[0].cast("long").alias("gid"),
        parts[1].cast("int").alias("row"),
        parts[2].cast("int").alias("col"),
    )


def node_type_code(type: Column) -> Column:
    pairs = ((F.lit(name), F.lit(code)) for code, name in enumerate(NODE_TYPES))
    return F.create_map(*chain.from_iterable(pairs))[type]


def relations_between(first: str, second: str, match: str = "either") -> list[int]:
    """Channels of a connected pair of nodes of these types.

    `either` asks for one type in the channel's pair of types, `both` for the two of them.
    """
    if match not in ("either", "both"):
        raise ValueError("match is 'either' or 'both'")
    enough = any if match == "either" else all
    return [n for n, pair in enumerate(RELATIONS) if enough(t in pair for t in (first, second))]


def _rel_lookup(entries: dict[str, list[int]], key: Column) -> Column:
    pairs = ((F.lit(k), F.array(*map(F.lit, v)).cast("array<int>")) for k, v in entries.items())
    return F.create_map(*chain.from_iterable(pairs))[key]


def edge_relations_of(label: Column, match: str = "either") -> Column:
    """Channels of an edge labelled `A-B`, as array<int>."""
    return _rel_lookup(
        {f"{a}-{b}": relations_between(a, b, match) for a in NODE_TYPES for b in NODE_TYPES}, label
    )


def loop_relations_of(type: Column, match: str = "either") -> Column:
    """Channels of a node's loop to itself, as array<int>."""
    return _rel_lookup({t: relations_between(t, t, match) for t in NODE_TYPES}, type)
