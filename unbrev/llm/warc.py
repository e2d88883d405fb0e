"""WARC archives: writing records, normalising whole-file gzip, reading back.

A monolithic archive is one gzip stream around all its records, so no record can be
read without inflating everything before it.  The normaliser inflates such a stream
once, rewrites every record as a gzip member of its own, and notes where each member
lies in a sidecar index; readers then seek to single records.

Archives are rows ``(archive, data)`` of a Parquet table in the shared folder: Spark
can read and write those on any store, and a lost executor's archive is made again.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unbrev.session import shared_folder

#: An archive is closed once its records hold this many bytes.
ARCHIVE_BYTES = 8 << 20
_GZIP = 31
_BLANK = b"\r\n\r\n"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")

ARCHIVE = "archive string, data binary"
NORMALISED = (
    "archive string, data binary, "
    "members array<struct<record_id:string,kind:string,offset:bigint,length:bigint>>"
)
RECORD = (
    "record_id string, record_type string, url string, refers_to string, "
    "payload_digest string, payload_bytes bigint, stored_bytes bigint, stored_sha1 string"
)


class Record(NamedTuple):
    """One record: its header fields (names in lower case), block, and raw bytes."""

    fields: dict[str, str]
    block: bytes
    raw: bytes


def base32_sha1(digest_hex: str) -> str:
    """Upper-case base32 of a SHA-1 given in hex."""
    return base64.b32encode(bytes.fromhex(digest_hex)).decode()


def make_record(
    record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None
) -> bytes:
    """A response record, or with ``refers_to`` a revisit that has no payload.

    Both keep the HTTP header, whose length field is that of the full payload.
    White space and control characters of a URL are percent-encoded; a null URL has
    no header line.
    """
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to:
        lines.append(f"WARC-Refers-To: <{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    block = http if refers_to else http + payload
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + _BLANK + block + _BLANK


def inflate(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The content of a gzip file, in pieces, read once from its start.

    A file of several members is read through.  A stream that ends early raises.
    """
    view = memoryview(data)
    while len(view):
        stream, at = zlib.decompressobj(_GZIP), 0
        while not stream.eof and at < len(view):
            yield stream.decompress(view[at : at + step])
            at += step
        if not stream.eof:
            raise ValueError("gzip stream ends early")
        view = view[min(at, len(view)) - len(stream.unused_data) :]


def records(pieces: Iterator[bytes]) -> Iterator[Record]:
    """The records of an uncompressed WARC stream that arrives in pieces."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while True:
            head = held.find(_BLANK)
            if head < 0:
                break
            fields = _fields(bytes(held[:head]))
            size = int(fields["content-length"])
            end = head + 4 + size + 4
            if len(held) < end:
                break
            raw = bytes(held[:end])
            if raw[-4:] != _BLANK:
                raise ValueError("record does not end where its length says")
            del held[:end]
            yield Record(fields, raw[head + 4 : -4], raw)
    if held:
        raise ValueError("archive ends inside a record")


def _fields(head: bytes) -> dict[str, str]:
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    pairs = (line.split(":", 1) for line in lines)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def member(raw: bytes) -> bytes:
    """One record as a gzip member of its own."""
    gz = zlib.compressobj(4, zlib.DEFLATED, _GZIP)
    return gz.compress(raw) + gz.flush()


# -- Spark jobs ------------------------------------------------------------


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, sha1, refers_to`` of every row.

    Among rows of one payload (null: empty) those with the largest ``page_id`` are
    responses, the others refer to that id.  The largest id of a payload is summed
    up before the shuffle, and the join has one right row per payload, so a payload
    that much of the table shares is no burden.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    last = rows.groupBy("sha1").agg(F.max("page_id").alias("last"))
    is_last = F.col("page_id").eqNullSafe(F.col("last"))
    # Both sides grow with the table, so the plan is the same at every size.
    return rows.join(last.hint("merge"), "sha1").select(
        "page_id", "url", "html", "sha1", F.when(~is_last, F.col("last")).alias("refers_to")
    )


def _record_id(page: int | None) -> str:
    return f"urn:page:{page}" if page is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '')}"


def write_monolithic(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``(archive, data)``: the rows of :func:`with_revisits` as whole-file gzip."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        gz, parts, size = None, [], 0

        def close() -> pa.RecordBatch:
            parts.append(gz.flush())
            name = f"pages-{task:06d}-{number:06d}.warc.gz"
            return pa.RecordBatch.from_pydict({"archive": [name], "data": [b"".join(parts)]})

        for batch in batches:
            for row in range(batch.num_rows):
                page, url, html, sha1, refers = (c[row].as_py() for c in batch.columns)
                raw = make_record(
                    _record_id(page),
                    url,
                    html.encode(),
                    base32_sha1(sha1),
                    None if refers is None else _record_id(refers),
                )
                if gz is None:
                    gz, parts, size = zlib.compressobj(1, zlib.DEFLATED, _GZIP), [], 0
                parts.append(gz.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    yield close()
                    gz, number = None, number + 1
        if gz is not None:
            yield close()

    return rows.select("page_id", "url", "html", "sha1", "refers_to").mapInArrow(write, ARCHIVE)


def normalise(archives: DataFrame) -> DataFrame:
    """``(archive, data, members)``: each archive with one gzip member per record.

    ``members`` has the id, kind, offset and length of every record in ``data``.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                out, members = bytearray(), []
                for record in records(inflate(batch.column("data")[row].as_buffer())):
                    packed = member(record.raw)
                    members.append(
                        {
                            "record_id": record.fields["warc-record-id"].strip("<>"),
                            "kind": record.fields["warc-type"],
                            "offset": len(out),
                            "length": len(packed),
                        }
                    )
                    out += packed
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("archive").slice(row, 1),
                        pa.array([bytes(out)], pa.binary()),
                        pa.array(
                            [members],
                            pa.list_(
                                pa.struct(
                                    [
                                        ("record_id", pa.string()),
                                        ("kind", pa.string()),
                                        ("offset", pa.int64()),
                                        ("length", pa.int64()),
                                    ]
                                )
                            ),
                        ),
                    ],
                    ["archive", "data", "members"],
                )

    return archives.select("archive", "data").mapInArrow(rewrite, NORMALISED)


def read_members(archives: DataFrame) -> DataFrame:
    """All records, each inflated alone from where the index says it lies.

    The index lies beside the data, as a column of the same row, so nothing is
    shuffled to bring them together.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = [part.split()[0] for part in RECORD.split(", ")]
        for batch in batches:
            for data, members in zip(batch.column("data"), batch.column("members")):
                view, rows = memoryview(data.as_buffer()), {name: [] for name in names}
                for place in members.as_py():
                    start = place["offset"]
                    piece = view[start : start + place["length"]]
                    (record,) = records(inflate(piece))
                    fields = record.fields
                    head, _, body = record.block.partition(_BLANK)
                    size = int(re.search(rb"(?mi)^content-length: (\d+)\r?$", head)[1])
                    refers = fields.get("warc-refers-to")
                    values = (
                        fields["warc-record-id"].strip("<>"),
                        fields["warc-type"],
                        fields.get("warc-target-uri"),
                        refers and refers.strip("<>"),
                        fields["warc-payload-digest"].removeprefix("sha1:"),
                        size,
                        len(body),
                        hashlib.sha1(body).hexdigest(),
                    )
                    for name, value in zip(names, values):
                        rows[name].append(value)
                yield pa.RecordBatch.from_pydict(rows, pa.schema(_record_fields()))

    return archives.select("data", "members").mapInArrow(read, RECORD)


def _record_fields() -> list[tuple[str, pa.DataType]]:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    return [(part.split()[0], kinds[part.split()[1]]) for part in RECORD.split(", ")]


def archive_pages(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write pages to archives and normalise them; the archives and their index.

    Under ``folder`` (a new one in the shared folder by default) come the tables
    ``monolithic``, ``normalised`` and ``index``.

    Null ``html`` is an empty payload, null ``url`` a record without target.  Rows
    that repeat, or tie for the largest ``page_id`` of a payload, are all responses.
    A null ``page_id`` comes back as null; it is a revisit unless its payload has
    null ids only.  Other columns of ``pages`` are ignored.  An empty table gives
    empty archive tables.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_monolithic(with_revisits(pages)).write.parquet(f"{folder}/monolithic")
    made = normalise(spark.read.schema(ARCHIVE).parquet(f"{folder}/monolithic"))
    made.write.parquet(f"{folder}/normalised")
    normal = spark.read.schema(NORMALISED).parquet(f"{folder}/normalised")
    sidecar = normal.select("archive", F.inline("members"))
    sidecar.write.parquet(f"{folder}/index")
    return normal, spark.read.schema(sidecar.schema).parquet(f"{folder}/index")


def page_number(record_id: Column) -> Column:
    """The page id in a record id, null if it has none."""
    return F.regexp_extract(record_id, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
