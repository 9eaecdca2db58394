"""From tables to typed graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridweave.functions.nodes import node_id
from gridweave.schemas import EDGE_KINDS, SEPARATOR, TABLE_SIZE_LIMIT


def fits_size_limit(rows: Column, columns: Column, limit: int = TABLE_SIZE_LIMIT) -> Column:
    return rows.cast("long") * columns < limit


def filter_table_size(tables: DataFrame, limit: int = TABLE_SIZE_LIMIT) -> DataFrame:
    """Tables with rows x columns below `limit`; a table without rows or columns stays."""
    return tables.where(fits_size_limit(F.size("rows"), F.size("columns"), limit))


def graph_count(tables: DataFrame) -> DataFrame:
    """The number of tables, as the one-row column `num`."""
    return tables.agg(F.count("*").alias("num"))


def _node(row, col, type, text) -> Column:
    return F.struct(
        F.lit(row).cast("int").alias("row"),
        F.lit(col).cast("int").alias("col"),
        F.lit(type).alias("type"),
        F.lit(text).alias("text"),
    )


def table_nodes(tables: DataFrame) -> DataFrame:
    """Nodes (gid, row, col, pos, id, type, text) of tables (gid, columns, rows, questions).

    Row 0 holds the header hub and the header cells, row r a row hub and its
    cells, the row after the last one the caption. One pass over the tables.
    """
    header = F.transform("columns", lambda text, c: _node(0, c + 1, "H", text))
    body = F.transform(
        "rows",
        lambda cells, r: F.concat(
            F.array(_node(r + 1, 0, "VE", "[VE]")),
            F.transform(cells, lambda text, c: _node(r + 1, c + 1, "Cell", text)),
        ),
    )
    caption = _node(F.size("rows") + 1, 0, "Caption", F.array_join("questions", SEPARATOR))
    whole = F.concat(
        F.array(_node(0, 0, "VH", "[VH]")), header, F.flatten(body), F.array(caption)
    )
    at = F.col("node")
    return tables.select("gid", F.posexplode(whole).alias("pos", "node")).select(
        "gid",
        at["row"].alias("row"),
        at["col"].alias("col"),
        "pos",
        node_id(F.col("gid"), at["row"], at["col"]).alias("id"),
        at["type"].alias("type"),
        at["text"].alias("text"),
    )


_VH_H, _VE_CELL, _CAPTION_VH, _CAPTION_VE, _H_CELL = range(len(EDGE_KINDS))
_COL_BITS = 32  # of a place; the row is above them


def table_edges(tables: DataFrame, dangling: bool = True) -> DataFrame:
    """Edges (gid, src, dst, type, i, j), both directions, of the same tables.

    Every node names its links to the hubs above it, so the positions `i` and `j` of
    both ends follow from the node's own place, without a join. A header cell is also
    linked with its place in rows too short to have a cell there; such an edge ends at no
    node and has a null position. `dangling=False` leaves those edges out.
    """
    n_cols, n_rows = F.size("columns"), F.size("rows")

    # A place is one number, the row above the column, and a row's places are one sequence; those
    # of header cells without a cell come behind the nodes.
    def places(row, first, last) -> Column:
        start = F.shiftleft(F.lit(row).cast("long"), _COL_BITS)
        return F.sequence(start + first, start + last)

    body = F.transform("rows", lambda cells, r: places(r + 1, 0, F.size(cells)))
    missing = F.transform(
        "rows",
        lambda cells, r: F.when(
            F.size(cells) < n_cols, places(r + 1, F.size(cells) + 1, n_cols)
        ).otherwise(F.array().cast("array<long>")),
    )
    all_nodes = F.concat(places(0, 0, n_cols), F.flatten(body), places(n_rows + 1, 0, 0))
    lone_places = F.flatten(missing) if dangling else F.array().cast("array<long>")
    # The outer generators leave out a test of the arrays, which would be made a second time for it.
    nodes = (
        tables.select("gid", n_cols.alias("n_cols"), n_rows.alias("n_rows"), all_nodes.alias("nodes"), lone_places.alias("lone"))
        .select("gid", "n_cols", "n_rows", F.size("nodes").alias("n"), F.concat("nodes", "lone").alias("places"))
        .select("gid", "n_cols", "n_rows", "n", F.posexplode_outer("places").alias("pos", "place"))
        .where(F.col("place").isNotNull())
        .withColumn("row", F.shiftright("place", _COL_BITS).cast("int"))
        .withColumn("col", F.col("place").bitwiseAND(F.lit((1 << _COL_BITS) - 1)).cast("int"))
    )
    row, col, pos, slot = (F.col(c) for c in ("row", "col", "pos", "slot"))
    lone = pos >= F.col("n")
    slots = (
        F.when(lone, F.array(F.lit(_H_CELL)))
        .when(pos == 0, F.array().cast("array<int>"))
        .when(row == 0, F.array(F.lit(_VH_H)))
        .when(row > F.col("n_rows"), F.array(F.lit(_CAPTION_VH)))
        .when(col == 0, F.array(F.lit(_CAPTION_VE)))
        .when(col <= F.col("n_cols"), F.array(F.lit(_VE_CELL), F.lit(_H_CELL)))
        .otherwise(F.array(F.lit(_VE_CELL)))
    )
    to_caption, to_hub = slot == _CAPTION_VE, slot == _CAPTION_VH
    a_row = F.when(to_caption, F.col("n_rows") + 1).when(slot.isin(_VE_CELL, _CAPTION_VH), row).otherwise(0)
    a_col = F.when(slot == _H_CELL, col).otherwise(0)
    a_pos = (
        F.when(to_caption, F.col("n") - 1)
        .when(slot == _VE_CELL, pos - col)
        .when(to_hub, pos)
        .otherwise(a_col)
    )
    b_row, b_col = F.when(to_hub, 0).otherwise(row), F.when(to_hub, 0).otherwise(col)
    b_pos = F.when(lone, None).when(to_hub, 0).otherwise(pos)
    # Ends are worked out behind the generators, where they are compiled, and text only where
    # it is asked for.
    ends = nodes.select("*", F.explode_outer(slots).alias("slot")).where(slot.isNotNull()).select(
        "gid",
        slot.alias("kind"),
        node_id(F.col("gid"), a_row, a_col).alias("a"),
        node_id(F.col("gid"), b_row, b_col).alias("b"),
        a_pos.cast("int").alias("a_pos"),
        b_pos.cast("int").alias("b_pos"),
    )

    def either(forth: Column, back: Column) -> Column:
        return F.when(F.col("back"), back).otherwise(forth)

    def label(names: list[str]) -> Column:
        return F.array(*[F.lit(name) for name in names])[F.col("kind")]

    a, b = F.col("a"), F.col("b")
    directed = ends.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    return directed.select(
        "gid",
        either(a, b).alias("src"),
        either(b, a).alias("dst"),
        either(label([f"{x}-{y}" for x, y in EDGE_KINDS]), label([f"{y}-{x}" for x, y in EDGE_KINDS])).alias("type"),
        either(F.col("a_pos"), F.col("b_pos")).alias("i"),
        either(F.col("b_pos"), F.col("a_pos")).alias("j"),
    )
