"""Words, Arrow batches and the training fold, shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridweave.session import at_least_parallel, ship

# A word is a run of anything but these six characters, the ones bytes.split() cuts at.
WORD = r"[^\x20\x09-\x0D]+"

# Rows in an Arrow batch of texts: what one call of a Python function holds at a time.
TEXTS_PER_BATCH = 500


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table, spread over the cores if it is one small file."""
    prepare(spark)
    return at_least_parallel(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def prepare(spark: SparkSession) -> SparkSession:
    """Send the package to the workers; keep batches of texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_PER_BATCH)
    return ship(spark)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def map_arrow(
    df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """Apply `rows` to each Arrow batch of each partition."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield rows(batch)

    return df.mapInArrow(over, schema)


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5. Remainder 0 is held out; so is a null id."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5, F.lit(0))


def is_held_out(doc_id: Column | str = "doc_id") -> Column:
    return fold(doc_id) == 0
