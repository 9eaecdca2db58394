"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridweave.session import discard, scratch_path


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of `links`, the smallest node it can reach.

    Each round links every node to the smallest node near it (large star, then small
    star) until the table is a set of stars around roots. A round is two minimum
    aggregations, which combine before the shuffle, and two joins on one key, which
    adaptive execution can split, so a node with very many links is no single task. The
    round's table is written to the shared folder; earlier ones are removed. Roots
    themselves are not listed. Null ends and self-links are ignored; no links, no rows.
    """
    stars, path = _stored(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    while not _is_flat(stars):
        earlier = path
        stars, path = _stored(_small_star(_large_star(stars)))
        discard(links.sparkSession, earlier)
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _stored(stars: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_path(stars.sparkSession, "stars")
    stars.write.parquet(path)
    return stars.sparkSession.read.schema(stars.schema).parquet(path), path


def _is_flat(stars: DataFrame) -> bool:
    """Whether each node has one parent, and no parent has a parent."""
    many = stars.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1").select("hi")
    deep = stars.select(F.col("lo").alias("hi")).join(stars.select("hi"), "hi", "left_semi")
    return many.unionByName(deep).isEmpty()


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        stars.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("hi"), F.least("m", "u").alias("lo"))
        .distinct()
    )


def _small_star(stars: DataFrame) -> DataFrame:
    least = stars.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = stars.join(least, "hi").where(F.col("lo") > F.col("m"))
    return (
        moved.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        .unionByName(least.select("hi", F.col("m").alias("lo")))
        .distinct()
    )
