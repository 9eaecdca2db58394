"""WARC archives: writing, normalising one-stream gzip files, reading by offset index."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import NAMESPACE_URL, uuid4, uuid5

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridweave.session import materialize, scratch_path

LEVEL = 3
CHUNK = 1 << 20
# Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 128 << 20
ROWS_AT_ONCE = 256
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
GZIP = 31  # zlib's window for gzip members


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes = field(repr=False)

    def to_bytes(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.headers.items())
        return f"WARC/1.1\r\n{head}Content-Length: {len(self.block)}\r\n\r\n".encode() + self.block + b"\r\n\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def page_record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_response: bool
) -> Record:
    """A response with the page, or a revisit that points to the response with its payload."""
    digest = sha1_base32(payload)
    headers = {
        "WARC-Type": "response" if is_response else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join(c if c.isprintable() and c != " " else "%20" for c in url or f"urn:page:{page_id}"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "X-Payload-Length": str(len(payload)),
    }
    if page_id is not None:
        headers["X-Page-ID"] = str(page_id)
    head = HTTP_HEAD % len(payload)
    if is_response:
        return Record(headers, head + payload)
    headers["WARC-Profile"] = PROFILE
    if refers_to is not None:
        headers["WARC-Refers-To"] = record_id(refers_to, digest)
        headers["X-Refers-To-Page-ID"] = str(refers_to)
    return Record(headers, head)


def parse_record(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {raw[:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines)
    return Record(headers, rest[: int(headers.pop("Content-Length"))])


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a stream of uncompressed archive bytes, one at a time."""
    held = bytearray()
    need = -1
    for chunk in chunks:
        held += chunk
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = bytes(held[:end]).lower()
                length = next(int(x[15:]) for x in head.split(b"\r\n") if x.startswith(b"content-length:"))
                need = end + 4 + length + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if held:
        raise ValueError(f"the archive ends within a record, {len(held)} bytes after the last whole one")


def inflated(source) -> Iterator[bytes]:
    """What a gzip file holds, whether it is one stream or many members, in bounded parts.
    A file that ends within a stream is an error, wherever its records end."""
    inflate, begun = zlib.decompressobj(GZIP), False
    while chunk := source.read(CHUNK):
        while chunk:
            begun = True
            yield inflate.decompress(chunk, CHUNK)
            chunk = inflate.unconsumed_tail
            if inflate.eof:
                chunk, inflate, begun = inflate.unused_data, zlib.decompressobj(GZIP), False
    yield inflate.flush()
    if begun and not inflate.eof:
        raise ValueError("the archive is cut off: its gzip stream has no end")


def deflated(raw: bytes) -> bytes:
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return deflate.compress(raw) + deflate.flush()


def classified(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, is_response, refers_to) for every row of `pages`.

    Of rows with equal payloads of at least `least_bytes` bytes, those with the largest
    page_id are responses and the others refer to it; a missing id is below all others.
    Only digests are grouped. The payloads are joined with the groups of two or more,
    which Spark sends to all workers if they are few, and shuffles if not.
    """
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    keyed = slim.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("bytes", F.octet_length("payload"))
    groups = materialize(
        keyed.where(F.col("bytes") >= least_bytes)
        .groupBy("digest", "bytes")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("last"))
        .where("n > 1 and last is not null")
        .select("digest", "bytes", "last"),
        "equal-payloads",
    )
    first = F.col("last").isNull() | F.col("page_id").eqNullSafe(F.col("last"))
    return keyed.join(groups, ["digest", "bytes"], "left").select(
        "page_id", "url", "payload", first.alias("is_response"), F.when(~first, F.col("last")).alias("refers_to")
    )


def write_archives(
    records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write `classified` rows as gzip files of one stream each; return (path, records).

    Each task writes files of its own under new names, and the table of names is stored
    as rows of finished tasks, so a file that a lost task left behind is in no table.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out, deflate, count, size, name = None, None, 0, 0, ""

        def finish() -> pa.RecordBatch:
            out.write(deflate.flush())
            out.close()
            return pa.record_batch([[f"{folder}/{name}"], [count]], ["path", "records"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "is_response")]
            for row in zip(*columns, strict=True):
                if out is None:
                    name = f"{uuid4().hex}.warc.gz"
                    out, count, size = files.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                raw = page_record(*row).to_bytes()
                out.write(deflate.compress(raw))
                count, size = count + 1, size + len(raw)
                if size >= archive_bytes:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return materialize(records.mapInArrow(over, "path string, records long"), "archives")


def normalize_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with every record as a gzip member of its own.

    The one stream of a file is inflated once, from beginning to end; nothing but the
    record at hand is held. Beside `x.warc.gz` the index `x.idx` has a line `offset length
    type id` for each record. Returns (path, index, records). Where `archives` tells how many
    `records` a file has, another number is an error, as is a file that is cut off.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                yield _normalize(path, folder, records)

    records = F.col("records") if "records" in archives.columns else F.lit(None)
    spread = archives.select("path", records.cast("long").alias("records")).repartition(_parts(archives), "path")
    return materialize(spread.mapInArrow(over, "path string, index string, records long"), "normalized-archives")


def _parts(archives: DataFrame) -> int:
    conf = archives.sparkSession.conf
    return max(2 * archives.sparkSession.sparkContext.defaultParallelism, int(conf.get("spark.sql.shuffle.partitions")))


def _normalize(path: str, folder: str, records: int | None = None) -> pa.RecordBatch:
    files, source = fs.FileSystem.from_uri(path)
    target, root = fs.FileSystem.from_uri(folder)
    target.create_dir(root, recursive=True)
    name, at, count = uuid4().hex, 0, 0
    with (
        files.open_input_stream(source, compression=None) as stream,
        target.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as out,
        target.open_output_stream(f"{root}/{name}.idx", compression=None) as index,
    ):
        for raw in split_records(inflated(stream)):
            member, headers = deflated(raw), parse_record(raw).headers
            out.write(member)
            index.write(f"{at} {len(member)} {headers['WARC-Type']} {headers['WARC-Record-ID']}\n".encode())
            at, count = at + len(member), count + 1
    if records is not None and count != records:
        raise ValueError(f"{path} holds {count} records, not the {records} that were written")
    return pa.record_batch([[f"{folder}/{name}.warc.gz"], [f"{folder}/{name}.idx"], [count]], ["path", "index", "records"])


def read_member(files: fs.FileSystem, path: str, offset: int, length: int) -> Record:
    """One record of a normalised archive, by its place in the index."""
    with files.open_input_file(path) as f:
        return parse_record(zlib.decompress(f.read_at(length, offset), GZIP))


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of each
    record, read member by member along the index. The payload of a response is held
    against its digest and length; that of a revisit is in the record it refers to, so
    it is null here."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                yield from _read(path, index)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return archives.repartition(_parts(archives), "path").mapInArrow(over, schema)


def _read(path: str, index: str) -> Iterator[pa.RecordBatch]:
    files, source = fs.FileSystem.from_uri(path)
    listed, names = fs.FileSystem.from_uri(index)
    with listed.open_input_stream(names, compression=None) as f:
        places = [tuple(map(int, line.split()[:2])) for line in f.read().decode().splitlines()]
    with files.open_input_file(source) as archive:
        for i in range(0, len(places), ROWS_AT_ONCE):
            rows = [
                _row(parse_record(zlib.decompress(archive.read_at(length, offset), GZIP)))
                for offset, length in places[i : i + ROWS_AT_ONCE]
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
            )


def _row(record: Record) -> tuple:
    h = record.headers
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    length = int(h["X-Payload-Length"])
    payload = None
    if h["WARC-Type"] == "response":
        payload = record.block.partition(b"\r\n\r\n")[2]
        if len(payload) != length or sha1_base32(payload) != digest:
            raise ValueError(f"{h['WARC-Record-ID']} does not hold the payload it names")
    number = lambda key: int(h[key]) if key in h else None
    return number("X-Page-ID"), length, digest, h["WARC-Type"], number("X-Refers-To-Page-ID"), payload


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, which workers would otherwise take to be the local one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().toString()


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write `pages` to archives, normalise these, and give the rows read back from them.

    Null html is an empty payload; a null url gets a URN; null ids come back null, and
    are responses unless an equal payload has an id. Rows that repeat an id and its
    payload are alike. Further columns are ignored; no rows, no archives.
    """
    folder = folder or _qualified(pages.sparkSession, scratch_path(pages.sparkSession, "warc"))
    written = write_archives(classified(pages, least_bytes), f"{folder}/streams")
    return read_archives(normalize_archives(written, f"{folder}/members"))
