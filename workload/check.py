"""Compare the registered queries with their SQL: python -m workload.check [folder] [names...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from workload.catalog import QUERIES
from workload.oracles import ORACLES

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def difference(spark: SparkSession, connection, name: str, sf: str) -> str | None:
    """None if the query and its SQL give the same rows, else what differs."""
    ours = ordered(QUERIES[name](spark, sf).toPandas())
    theirs = ordered(connection.execute(ORACLES[name]).df())
    if list(ours.columns) != list(theirs.columns):
        return f"columns {list(ours.columns)} / {list(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} / {len(theirs)} rows"
    for column in ours.columns:
        a, b = ours[column], theirs[column]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = (~same).idxmax()
            return f"{(~same).sum()} values of {column}, first {a[at]!r:.300} / {b[at]!r:.300}"
        if pd.api.types.is_float_dtype(a) != pd.api.types.is_float_dtype(b):
            return f"type of {column}: {a.dtype} / {b.dtype}"
    return None


def main(sf: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, failures = connect(sf), 0
    for name in names or ORACLES:
        start = time.time()
        try:
            problem = difference(spark, connection, name, sf)
        except Exception as error:  # report and go on with the other queries
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failures += problem is not None
        print(f"{name:30s} {time.time() - start:6.1f}s  {problem or 'same'}", flush=True)
    return failures


if __name__ == "__main__":
    arguments = sys.argv[1:] or ["/root/testdata/sf0.01"]
    sys.exit(main(arguments[0], arguments[1:]))
