"""Word counts without the rare words, which a counting filter keeps out of the shuffle.

Most distinct words of a large corpus are too rare for a dictionary, yet each of them
crosses the network to be counted. Here a first pass counts hashed words in a fixed
number of cells; a word whose cell stays low cannot pass, and the second pass drops it
before the shuffle. Words that share a cell may let a rare one through, never the
opposite, and the second pass counts exactly, so the size of the filter has no say in
the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridweave.functions.text import tokenize
from gridweave.schemas import MIN_WORD_COUNT
from gridweave.session import materialize

# Cells of the filter, a power of two: one or four bytes each while a task counts, one
# bit each in what every task of the second pass holds (8 MB).
CELLS = 1 << 26
# Cells that travel in one row.
BLOCK_CELLS = 1 << 16


def _cell(word: str, cells: int) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(cells - 1))


def _ceiling(more_than: int) -> tuple[int, type]:
    """The count at which cells stop, and the type that holds it."""
    top = more_than + 1
    if not 1 <= top <= np.iinfo(np.uint32).max:
        raise ValueError(f"no counter for counts above {more_than}")
    return top, np.uint8 if top <= 255 else np.uint32


def cell_counts(hashed: DataFrame, cells: int = CELLS, more_than: int = MIN_WORD_COUNT) -> DataFrame:
    """(block, at, counts) of each partition of (cell): the cells in use and their counts.

    `at` are places in the block as 16-bit numbers; counts stop at `more_than` + 1. A
    partition gives a word a few bytes, whatever its length and number.
    """
    top, kind = _ceiling(more_than)
    size = min(cells, BLOCK_CELLS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = np.zeros(cells, kind)
        for batch in batches:
            found, n = np.unique(batch.column(0).to_numpy(), return_counts=True)
            counter[found] = np.minimum(counter[found] + n, top)
        for block in range(cells // size):
            part = counter[block * size : (block + 1) * size]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.record_batch(
                    [
                        pa.array([block], pa.int32()),
                        pa.array([at.astype(np.uint16).tobytes()], pa.binary()),
                        pa.array([part[at].tobytes()], pa.binary()),
                    ],
                    ["block", "at", "counts"],
                )

    return hashed.mapInArrow(count, "block int, at binary, counts binary")


def passing_cells(counted: DataFrame, cells: int = CELLS, more_than: int = MIN_WORD_COUNT) -> DataFrame:
    """(block, words array<long>): for each block a bit for each cell counted more than
    `more_than` times over all partitions.

    Rows come sorted by block and are added up as they come, so a task holds one block,
    however many partitions there are. Blocks are cut by hash and hold alike.
    """
    top, kind = _ceiling(more_than)
    size = min(cells, BLOCK_CELLS)

    def bits(block: int, total: np.ndarray) -> pa.RecordBatch:
        words = np.packbits(total >= top, bitorder="little").view("<i8")
        return pa.record_batch(
            [pa.array([block], pa.int32()), pa.array([words], pa.list_(pa.int64()))], ["block", "words"]
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, None
        for batch in batches:
            for block, at, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != current:
                    if current is not None:
                        yield bits(current, total)
                    current, total = block, np.zeros(size, np.int64)
                places = np.frombuffer(at, np.uint16)
                total[places] = np.minimum(total[places] + np.frombuffer(counts, kind), top)
        if current is not None:
            yield bits(current, total)

    return counted.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, words array<long>")


def frequent_word_counts(
    corpus: DataFrame, more_than: int = MIN_WORD_COUNT, cells: int = CELLS
) -> DataFrame:
    """(word, cnt) of the words of `text` found more than `more_than` times: the rows that
    `word_counts` gives above that count.

    Reads the corpus twice. `cells` is a power of two of at least 64; with fewer cells than
    words, more rare words reach the shuffle and are dropped behind it. Null texts count
    as the tokenizer says; an empty corpus gives no rows.
    """
    if cells < 64 or cells & (cells - 1):
        raise ValueError("cells must be a power of two of at least 64")
    words = corpus.select(F.explode(tokenize(F.col("text"))).alias("word"))
    counted = cell_counts(words.select(_cell("word", cells).alias("cell")), cells, more_than)
    blocks = materialize(passing_cells(counted, cells, more_than), "word-filter")
    # One row of cells / 8 bytes, blocks without a passing cell filled in.
    size = min(cells, BLOCK_CELLS)
    every = corpus.sparkSession.range(cells // size).select(F.col("id").cast("int").alias("block"))
    none = F.array_repeat(F.lit(0).cast("long"), size // 64)
    listed = every.join(blocks, "block", "left").select(F.struct("block", F.coalesce("words", none).alias("words")).alias("b"))
    filter_row = listed.agg(F.flatten(F.array_sort(F.collect_list("b"))["words"]).alias("bits"))
    cell = _cell("word", cells)
    word_of_cell = F.get("bits", F.shiftright(cell, 6).cast("int"))
    passes = F.getbit(word_of_cell, cell.bitwiseAND(F.lit(63)).cast("int")) == 1
    left = words.join(F.broadcast(filter_row), passes).select("word")
    return left.groupBy("word").agg(F.count("*").alias("cnt")).where(F.col("cnt") > more_than)
