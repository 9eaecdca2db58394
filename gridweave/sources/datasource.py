"""Record files as a data source, for batch and streaming reads.

    register_interactions(spark)
    spark.read.format("interactions").load("records/")
    spark.readStream.format("interactions").option("log", "shared/seen").load("records/")

Rows are those of `parse_interactions` on the lines: (file_path, block_start, record, error).
All folders below the path are read; names that begin with a dot or an underscore are left out.
Plain files are cut in splits of `splitBytes`; files that end in `.gz` are one split each.
Options: `mode` as in `parse_interactions`, `splitBytes`, and for streams `log`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gridweave.schemas import INTERACTION_SCHEMA
from gridweave.session import ship
from gridweave.sources.interactions import BATCH_CHARS, _completed, _record_of

SPLIT_BYTES = 32 << 20
_CHUNK = 1 << 20
_LINE_END = re.compile(rb"\r\n|\n|\r")
_BYTE_ORDER_MARK = b"\xef\xbb\xbf"

SCHEMA = StructType(
    [
        StructField("file_path", StringType()),
        StructField("block_start", LongType()),
        StructField("record", INTERACTION_SCHEMA),
        StructField("error", StringType()),
    ]
)


@dataclass
class Split(InputPartition):
    """The lines of `path` that begin from byte `start` up to before byte `end`; without
    an `end`, all lines of a compressed file."""

    path: str
    start: int
    end: int | None

    def lines(self) -> Iterator[bytes]:
        files, name = fs.FileSystem.from_uri(self.path)
        if self.end is None:
            with files.open_input_stream(name, compression="gzip") as stream:
                yield from split_lines(stream.read, 0, None)
        else:
            with files.open_input_file(name) as stream:
                stream.seek(max(self.start - 1, 0))
                yield from split_lines(stream.read, self.start, self.end)


def split_lines(read, start: int, end: int | None) -> Iterator[bytes]:
    """The lines that begin in [start, end). `read` gives the bytes from the one before
    `start` on, as that one tells whether a line begins at `start`."""
    place, held, partial = max(start - 1, 0), b"", start > 0
    while True:
        chunk = read(max(_CHUNK, len(held)))
        data, at = held + chunk, 0
        for mark in _LINE_END.finditer(data, max(len(held) - 1, 0)):
            if chunk and mark.end() == len(data) and mark[0] == b"\r":
                break  # a line feed may follow
            if not partial:
                if end is not None and place + at >= end:
                    return
                line = data[at : mark.start()]
                yield line.removeprefix(_BYTE_ORDER_MARK) if place + at == 0 else line
            partial, at = False, mark.end()
        held, place = data[at:], place + at
        inside = not partial and (end is None or place < end)
        if not chunk:
            if held and inside:
                yield held.removeprefix(_BYTE_ORDER_MARK) if place == 0 else held
            return
        if not partial and not inside:
            return


def _rows(split: Split, failfast: bool) -> Iterator[tuple[int, dict | None, str | None]]:
    from google.protobuf.text_format import ParseError

    for line in split.lines():
        text = line.decode("utf-8", "replace")
        try:
            yield len(text), _completed("Interaction", _record_of(text)), None
        except ParseError as problem:
            if failfast:
                raise
            yield len(text), None, str(problem)


class _Records:
    """What batch and streaming readers share."""

    def __init__(self, options):
        self.path = options["path"]
        self.failfast = {"failfast": True, "permissive": False}[options.get("mode", "failfast")]
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))

    def files(self) -> list[tuple[str, int]]:
        """(path, size) of the record files, hidden ones left out, in order of path."""
        files, root = fs.FileSystem.from_uri(self.path)
        prefix = self.path[: -len(root)] if self.path.endswith(root) else ""
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(
            fs.FileSelector(root, recursive=True)
        )
        hidden = re.compile(r"(^|/)[._]")
        return sorted(
            (prefix + f.path, f.size)
            for f in found
            if f.type == fs.FileType.File and not hidden.search(f.path.removeprefix(root))
        )

    def splits(self, files: list[tuple[str, int]]) -> list[Split]:
        cut: list[Split] = []
        for path, size in files:
            if path.endswith(".gz"):
                cut.append(Split(path, 0, None))
            else:
                starts = range(0, size, self.split_bytes)
                cut += [Split(path, start, min(start + self.split_bytes, size)) for start in starts]
        return cut

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, held, size = to_arrow_schema(SCHEMA), [], 0
        for length, record, error in _rows(split, self.failfast):
            held.append(
                {"file_path": split.path, "block_start": split.start, "record": record, "error": error}
            )
            size += length
            if size >= BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class InteractionReader(_Records, DataSourceReader):
    def partitions(self) -> list[Split]:
        return self.splits(self.files())


class InteractionStreamReader(_Records, DataSourceStreamReader):
    """Each file once, as long as it was when it was first seen.

    `log` is a folder of the query's own that outlives it, beside its checkpoint. Entry n of
    it names the files that trigger n found new, so an offset is the number of an entry and a
    batch that is run again has the same splits.
    """

    def __init__(self, options):
        super().__init__(options)
        if "log" not in options:
            raise ValueError("a stream of records needs the option 'log', a folder of its own")
        self.log = options["log"].rstrip("/")
        self._entries: list[list[tuple[str, int]]] | None = None

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        entries = self._logged()
        seen = {path for entry in entries for path, _ in entry}
        if fresh := [(path, size) for path, size in self.files() if path not in seen]:
            self._write(len(entries) + 1, fresh)
            entries.append(fresh)
        return {"entry": len(entries)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        entries = self._logged()[start["entry"] : end["entry"]]
        return self.splits([file for entry in entries for file in entry])

    def _logged(self) -> list[list[tuple[str, int]]]:
        if self._entries is None:
            files, root = fs.FileSystem.from_uri(self.log)
            files.create_dir(root, recursive=True)
            names = sorted(
                f.path for f in files.get_file_info(fs.FileSelector(root)) if f.path.endswith(".json")
            )
            self._entries = []
            for name in names:
                with files.open_input_stream(name) as entry:
                    self._entries.append([tuple(file) for file in json.loads(entry.read())])
        return self._entries

    def _write(self, number: int, fresh: list[tuple[str, int]]) -> None:
        files, root = fs.FileSystem.from_uri(self.log)
        name = f"{root}/{number:09d}"
        with files.open_output_stream(f"{name}.tmp") as entry:
            entry.write(json.dumps(fresh).encode())
        files.move(f"{name}.tmp", f"{name}.json")


class InteractionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "interactions"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return InteractionReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return InteractionStreamReader(self.options)


def register_interactions(spark: SparkSession) -> None:
    """Make the format `interactions` known to the session."""
    ship(spark).dataSource.register(InteractionSource)
