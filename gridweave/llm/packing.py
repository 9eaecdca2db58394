"""Packing by powers of two: no sequence crosses documents, none needs padding."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from gridweave.llm.common import texts
from gridweave.session import materialize

LENGTH = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
# Words, and words without case and punctuation, whose ids a worker remembers in each of two
# generations. Longer ones are not remembered.
REMEMBERED = 100_000
REMEMBERED_UNITS = 200_000
REMEMBERED_BYTES = 40
# Documents whose ids a task holds at a time.
DOCS_AT_ONCE = 100
# What may end a word: signs that the tokenizer takes apart from letters.
SIGNS = b".,:;!?*#$%&|"
# Letters that normalising leaves single letters. Others may come apart into a letter and a
# mark, and the mark would join the signs that follow.
LETTERS = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself if it is printable, else one of those
    from U+0100 on, in order. Such is the alphabet of tokenizers that work on bytes."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTES = _byte_characters()


class Recent(dict):
    """Values of the keys asked for lately, worked out when missing.

    When `room` keys are held they become the older generation, and the one before is
    dropped; a key found among the older ones comes back. So keys that are asked for often
    are never worked out again, and no more than twice `room` are held.
    """

    def __init__(self, make: Callable[[bytes], bytes], room: int):
        self.make, self.room = make, room
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, key: bytes) -> bytes:
        if len(key) > REMEMBERED_BYTES:
            return self.make(key)
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordIds:
    """Ids of words as little-endian 32-bit numbers.

    The tokenizer drops white space and never joins across it, so the ids of a text are
    those of its words, one after the other. It ignores case and takes letters apart from
    signs, so a word of LETTERS with SIGNS at its end is two units, each looked up by
    itself. A unit is what the tokenizer's model sees, but for the characters that stand
    for its bytes, so it goes to the model; other words go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.units = Recent(self._unit, REMEMBERED_UNITS)
        self.words = Recent(self._word, REMEMBERED)

    def __call__(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))

    def _word(self, word: bytes) -> bytes:
        core = word.lower().rstrip(SIGNS)
        if not core.isalpha():
            letters = core.decode()
            if not LETTERS.fullmatch(letters):
                return self._encoded(word)
            core = letters.lower().encode()
        signs = len(word) - len(word.rstrip(SIGNS))
        return self.units[core] + self.units[word[-signs:]] if signs else self.units[core]

    def _unit(self, unit: bytes) -> bytes:
        seen = unit.decode() if unit.isalpha() else unit.decode("latin-1").translate(BYTES)
        return _packed([t.id for t in self.model.tokenize(seen)])

    def _encoded(self, word: bytes) -> bytes:
        return _packed(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut(tokens: int, length: int = LENGTH) -> list[int]:
    """Lengths of the pieces of a document: as many of `length`, a power of two, as fit,
    then one for each binary digit of the rest, largest first."""
    full, rest = divmod(tokens, length)
    return [length] * full + [1 << i for i in reversed(range(length.bit_length() - 1)) if rest >> i & 1]


def pieces(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    length: int = LENGTH,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, rank, ids): each document's ids and
    `end_id`, cut in pieces whose lengths are powers of two up to `length`.

    `ids` holds the piece's ids as little-endian unsigned 32-bit numbers, null if they are
    not asked for. `part` is the task, `rank` the piece's place among the task's pieces of
    its length. A null or blank text is `end_id` alone.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    end = end_id.to_bytes(4, "little")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = word_ids(path), TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in (b.slice(i, DOCS_AT_ONCE) for b in batches for i in range(0, b.num_rows, DOCS_AT_ONCE)):
            out = []
            for doc, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                ids = table(t or b"") + end
                total, start = len(ids) // 4, 0
                for n in cut(total, length):
                    piece = ids[4 * start : 4 * (start + n)]
                    out.append((doc, start, n, zlib.crc32(piece), total, part, seen[n], piece if with_ids else None))
                    seen[n] += 1
                    start += n
            if out:
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)], list(NAMES)
                )
                pa.default_memory_pool().release_unused()

    slim = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(
        over,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long, ids binary",
    )


NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank", "ids")
KINDS = (*[pa.int64()] * 5, pa.int32(), pa.int64(), pa.binary())


def pack(cut_docs: DataFrame) -> DataFrame:
    """Put pieces into sequences: add `sequence_id` and `offset`.

    A piece is a sequence of its own, as long as a power of two, so nothing is padded and
    no sequence holds two documents. Sequences of one length have consecutive numbers,
    the longest first, so a reader takes equal lengths together by a range of numbers.
    Pieces are stored once, in the tasks that cut them. Only the number of pieces by task and
    length is summed up, so that a piece's number is its rank and those before it.
    """
    stored = materialize(cut_docs, "pieces")
    counts = stored.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = (Window.unboundedPreceding, -1)
    longer = counts.groupBy("length").agg(F.sum("n").alias("n")).select(  # a row for each power of two
        "length", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("length")).rowsBetween(*earlier)), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("length").orderBy("part").rowsBetween(*earlier)
    firsts = materialize(
        counts.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(longer, "length")
        .select("length", "part", (F.col("base") + F.col("before")).alias("first")),
        "piece-counts",
    )
    return (
        stored.join(firsts, ["length", "part"])
        .withColumn("sequence_id", F.col("first") + F.col("rank"))
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("part", "rank", "first")
    )


def pack_documents(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    length: int = LENGTH,
    with_ids: bool = True,
) -> DataFrame:
    """(doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset) for every piece.

    Repeated rows and rows that share an id are packed each for itself, null ids too; a
    very long text is cut like any other; an empty table gives no pieces. Further columns are
    ignored.
    """
    packed = pack(pieces(docs, id, text, tokenizer, length, with_ids=with_ids))
    return packed if with_ids else packed.drop("ids")
