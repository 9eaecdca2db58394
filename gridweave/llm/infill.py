"""Fill-in-the-middle: texts cut in prefix, middle and suffix, and put in another order.

Cut places are given in units. A text is divided in blocks of a fixed number of bytes, and
a Fenwick tree over the blocks holds how many units and how many code points start in
each. Descending the tree by powers of two finds the block in which a unit starts, and the
number of code points before that block; only this block is then looked at byte by byte.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridweave.llm.common import map_arrow, texts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = re.compile(b"<[PSM]>")
# Of 100 texts, those that are rearranged, and of 100 of these, those with the suffix first.
REARRANGED = 90
SUFFIX_FIRST = 20
# Bytes of a block of text.
BLOCK = 4096


class Fenwick:
    """Sums of the first blocks, kept as sums over ranges whose lengths are powers of two."""

    def __init__(self, counts: np.ndarray):
        """`counts` has a row for each quantity and a column for each block."""
        self.blocks = counts.shape[1]
        sums = np.zeros((counts.shape[0], self.blocks + 1), np.int64)
        np.cumsum(counts, axis=1, out=sums[:, 1:])
        at = np.arange(1, self.blocks + 1)
        self.tree = np.zeros_like(sums)
        self.tree[:, 1:] = sums[:, 1:] - sums[:, at - (at & -at)]

    def descend(self, target: int, by: int = 0) -> tuple[int, np.ndarray]:
        """The largest number of leading blocks that hold at most `target` of quantity `by`,
        and the sums of all quantities over them."""
        at, sums = 0, np.zeros(len(self.tree), np.int64)
        step = 1 << (self.blocks.bit_length() - 1) if self.blocks else 0
        while step:
            if at + step <= self.blocks:
                more = sums + self.tree[:, at + step]
                if more[by] <= target:
                    at, sums = at + step, more
            step >>= 1
        return at, sums


class Units:
    """A text as a row of units: its code points, or matches of a pattern.

    With a pattern, a unit starts where a match starts, matches taken left to right, and
    lasts until the next one; what comes before the first match belongs to the first unit.
    A text without a match has no units and can only be cut at its ends.
    """

    def __init__(self, text: bytes, pattern: re.Pattern[bytes] | None = None, block: int = BLOCK):
        self.text, self.block = np.frombuffer(text, np.uint8), block
        points = (self.text & 0xC0) != 0x80
        if pattern is None:
            self.starts = points
        else:
            self.starts = np.zeros(len(text), bool)
            self.starts[[m.start() for m in pattern.finditer(text) if m.end() > m.start()]] = True
        if len(text):
            edges = np.arange(0, len(text), block)
            counts = np.stack([np.add.reduceat(x, edges, dtype=np.int64) for x in (self.starts, points)])
        else:
            counts = np.zeros((2, 0), np.int64)
        self.points = points
        self.fenwick = Fenwick(counts)
        self.count, self.length = (int(x) for x in counts.sum(1))

    def cut(self, units: int) -> tuple[int, int]:
        """Byte and code point at which the first `units` units end."""
        if units <= 0:
            return 0, 0
        if units >= self.count:
            return len(self.text), self.length
        # the unit of number `units`, from 0, starts in the block after those that hold at most so many
        blocks, (before, points) = self.fenwick.descend(units)
        at = blocks * self.block
        local = np.flatnonzero(self.starts[at : at + self.block])
        byte = at + int(local[units - int(before)])
        return byte, int(points) + int(np.count_nonzero(self.points[at:byte]))


def draws(key: str) -> list[int]:
    """Four unsigned numbers of 32 bits from a key: the first digits of its hash."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(
    text: bytes, key: str, pattern: re.Pattern[bytes] | None = None, block: int = BLOCK
) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of a text.

    The form is "plain", with the text as output, if the text is empty or holds a mark, or
    by chance; else "psm" or "spm" after the order of the parts.
    """
    h1, h2, h3, h4 = draws(key)
    units = Units(text, pattern, block)
    n = units.count
    if not text or MARKS.search(text) or h3 % 100 >= REARRANGED:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    (i, before), (j, until) = units.cut(first), units.cut(second)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h4 % 100 < SUFFIX_FIRST:
        form, output = "spm", SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    else:
        form, output = "psm", PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return n, form, before, until - before, output


def infill(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    pattern: str | None = None,
    seed: str = "1",
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of `docs`.

    `n` counts the units, which are code points or matches of `pattern`, a regular
    expression over UTF-8 bytes. Cuts and forms follow from `seed` and the id alone, so
    rows with the same id and text give the same output, and a task that runs again too.
    A null id counts as an empty one. A null text is empty; empty texts are plain. Texts
    are whole, of any length; a task holds an Arrow batch of them, and beside one text
    an array of two bytes for each of its bytes. No rows, no output.
    """
    units = re.compile(pattern.encode()) if pattern else None

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        out = [
            rearranged(t or b"", f"{seed}:{'' if i is None else i}", units, block)
            for i, t in zip(ids, texts(batch), strict=True)
        ]
        n, form, prefix, middle, output = zip(*out, strict=True)
        return pa.record_batch(
            [
                batch.column(0), pa.array(n, pa.int64()), pa.array(form),
                pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                pa.array(output, pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    return map_arrow(
        docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")),
        rows,
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string",
    )


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output of `infill` was made of.

    A rearranged text holds no mark of its own, so its output has exactly three: what
    follows them are the parts, in the order that the form names.
    """
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    part = F.split(output, MARKS.pattern.decode(), -1)
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )
