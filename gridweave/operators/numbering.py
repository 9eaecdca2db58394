"""Contiguous numbers over a total order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridweave.functions.chance import shuffle_key
from gridweave.session import materialize

# Rows of a graph that `node_positions` ranks in one piece.
ROWS_RANKED = 1024

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row in these, the partition above


def dense_index(
    df: DataFrame, order: list[Column], name: str, start: int = 0, partitions: int | None = None
) -> DataFrame:
    """Add `name`: start, start + 1, ... in the order of `order`, which must be unique.

    One range shuffle sorts the rows; each partition numbers its own, and the
    partition sizes (one row per partition) give the offsets. The sorted rows are
    written out once, so both passes see the same partitions. `partitions` fixes their
    number, which is otherwise left to adaptive execution.
    """
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *order)
    stored = materialize(
        ranged.sortWithinPartitions(*order).withColumn("_slot", F.monotonically_increasing_id()),
        "dense-index",
    )
    part = F.shiftright("_slot", _LOCAL_BITS)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    )
    local = F.col("_slot").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local + F.lit(start))
        .drop("_part", "_slot", "_offset")
    )


def assign_gid(tables: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """Number the tables from 0 in the order of the columns `order`."""
    return dense_index(tables, [F.col(c) for c in order], "gid", partitions=partitions)


def number_in_input_order(
    tables: DataFrame, name: str = "gid", split: tuple[str, ...] = ("file_path", "block_start")
) -> DataFrame:
    """Number the rows of a file scan from 0 by file and by place in the file.

    `tables` comes from the scan by steps without a shuffle (parsing, filtering), so the
    rows of an input split are consecutive in one task. Only the list of splits, one
    row each, is summed up in order; the tables themselves are neither sorted nor parsed
    a second time.
    """
    stored = materialize(
        tables.withColumn("_slot", F.monotonically_increasing_id()), "numbered-input"
    )
    earlier = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        stored.groupBy(*split)
        .agg(F.min("_slot").alias("_first"), F.count("*").alias("_size"))
        .select(
            *split,
            (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        )
    )
    return (
        stored.join(shifts, list(split))
        .withColumn(name, F.col("_slot") + F.col("_shift"))
        .drop("_slot", "_shift")
    )


def node_positions(nodes: DataFrame) -> DataFrame:
    """Replace `pos` by the place of each node among the given nodes of its graph.

    For node sets that lost some of a graph's nodes; a stored graph has `pos` already.
    """
    # Ranks are taken within ranges of rows, so that a large graph spreads.
    placed = nodes.drop("pos").withColumn("_range", F.coalesce(F.floor(F.col("row") / ROWS_RANKED), F.lit(-(1 << 62))))
    earlier = Window.partitionBy("gid").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("gid", "_range")
        .agg(F.count("*").alias("_size"))
        .select("gid", "_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    )
    local = F.row_number().over(Window.partitionBy("gid", "_range").orderBy("row", "col"))
    return (
        placed.withColumn("_local", local)
        .join(offsets, ["gid", "_range"])
        .withColumn("pos", (F.col("_offset") + F.col("_local") - 1).cast("int"))
        .select(*[c for c in nodes.columns if c != "pos"], "pos")
    )


def epoch_order(gids: DataFrame, seed: str) -> DataFrame:
    """A repeatable permutation of the distinct `gid` values: (gid, step)."""
    keyed = gids.select("gid", shuffle_key(seed, F.col("gid")).alias("_key"))
    return dense_index(keyed, [F.col("_key"), F.col("gid")], "step").select("gid", "step")
