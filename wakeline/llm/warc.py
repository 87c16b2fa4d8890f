"""Web archives with a dictionary: writer and reader of ``.warc.zst`` files.

A writing task fills archives of about ``archive_bytes``. Of each it builds a zstandard dictionary from the
archive's records, stores it in a leading skippable frame (magic 0x184D2A5D) and compresses every record
as a frame of its own. Equal payloads are written once: the record with the largest page_id is a response,
the others are revisits that refer to it.

An archive gets a new name in every attempt of a task, and the list of archives is committed by Spark with
the tasks that succeeded, so a lost executor leaves a file nobody reads, and no gap. Archives go to a
folder all executors share, through pyarrow's file systems (local paths, s3, gs, hdfs). Memory: one archive,
or one longer record, in a writing task; one record in a reading task.

Defined results: null html is an empty payload; a null url an empty target; control characters of a url
are percent-encoded. Rows that tie for the largest page_id of a payload are all responses. A null page_id
is smaller than any; revisits of a payload that only such rows have don't exist (all are responses).
Other columns are ignored, whatever their names. An empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from wakeline.session import saved, scratch_path

#: Fixed values of the format.
_SKIPPABLE = 0x184D2A5D
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archiving:
    archive_bytes: int = 16 << 20
    dictionary_bytes: int = 32 << 10
    #: The dictionary is built from an archive's first records of this size in all.
    sample_bytes: int = 2 << 20
    level: int = 3
    date: str = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _clean(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def page_record(page_id: int | None, url: str | None, payload: bytes, response_id: int | None, p: Archiving) -> bytes:
    """A response record, or a revisit of the page ``response_id``."""
    digest = payload_digest(payload)
    revisit = response_id is not None and page_id != response_id
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", p.date),
               ("WARC-Target-URI", _clean(url)), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
               ("X-Page-Id", page_id), ("X-Payload-Length", len(payload))]
    if revisit:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(response_id, digest)), ("X-Refers-To-Page-Id", response_id)]
    return _record(headers, head if revisit else head + payload)


def pack(records: list[bytes], p: Archiving) -> bytes:
    """An archive: the dictionary in a skippable frame, then a frame for each record."""
    sample, size = [], 0
    for record in records:
        if size >= p.sample_bytes:
            break
        sample.append(record)
        size += len(record)
    out, data = [], None
    try:
        data = zstandard.train_dictionary(p.dictionary_bytes, sample, level=p.level)
    except zstandard.ZstdError:
        pass  # too few records to learn from: an archive without dictionary
    if data:
        raw = data.as_bytes()
        out.append(struct.pack("<II", _SKIPPABLE, len(raw)) + raw)
    compressor = zstandard.ZstdCompressor(level=p.level, dict_data=data) if data else zstandard.ZstdCompressor(level=p.level)
    return b"".join(out + [compressor.compress(r) for r in records])


def records(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an archive."""
    head, data = archive.read(8), None
    if len(head) == 8 and struct.unpack("<II", head)[0] == _SKIPPABLE:
        raw = archive.read(struct.unpack("<II", head)[1])
        raw = zstandard.decompress(raw) if raw[:4] == zstandard.FRAME_HEADER else raw
        data = zstandard.ZstdCompressionDict(raw)
    else:
        archive.seek(0)
    decompressor = zstandard.ZstdDecompressor(dict_data=data) if data else zstandard.ZstdDecompressor()
    with io.BufferedReader(decompressor.stream_reader(archive, read_across_frames=True), 1 << 20) as stream:
        while line := stream.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"not the start of a record: {line[:40]!r}")
            headers = {}
            while (line := stream.readline().rstrip(b"\r\n")):
                name, _, value = line.decode().partition(": ")
                headers[name.lower()] = value
            size = int(headers["content-length"])
            block = stream.read(size)
            if len(block) != size or stream.read(4) != b"\r\n\r\n":
                raise ValueError("a record is cut short")
            yield headers, block


def write_archives(pages: DataFrame, folder: str, p: Archiving = Archiving()) -> DataFrame:
    """Archives ``pages(page_id, url, html)`` and returns path, n_records and n_bytes of every archive (a written table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def write(held: list[bytes]) -> pa.RecordBatch:
            name, body = f"{uuid.uuid4().hex}.warc.zst", pack(held, p)
            with store.open_output_stream(f"{root}/{name}", compression=None) as file:
                file.write(body)
            return pa.record_batch({"path": [f"{folder.rstrip('/')}/{name}"], "n_records": [len(held)], "n_bytes": [len(body)]})

        def begin() -> list[bytes]:
            fields = b"software: archive writer\r\nformat: WARC File Format 1.1\r\n"
            return [_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", p.date), ("Content-Type", "application/warc-fields")], fields)]

        held, size = begin(), 0
        for batch in batches:
            for page_id, url, html, response_id in zip(*(c.to_pylist() for c in batch.columns)):
                record = page_record(page_id, url, html.encode(), response_id, p)
                if len(held) > 1 and size + len(record) > p.archive_bytes:
                    yield write(held)
                    held, size = begin(), 0
                held.append(record)
                size += len(record)
        if len(held) > 1:
            yield write(held)

    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    slim = slim.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    first = slim.groupBy("sha", "size").agg(F.max("page_id").alias("response_id"))
    planned = slim.join(first, ["sha", "size"]).select("page_id", "url", "html", "response_id")
    return saved(planned.mapInArrow(run, "path string, n_records long, n_bytes long"), "archives")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The page records of ``archives(path)``; lengths and digests of responses come from the payloads read.

    ``payload`` is null for revisits, and for all records without ``payloads``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())

        def rows(path: str) -> Iterator[tuple]:
            store, place = fs.FileSystem.from_uri(path)
            with store.open_input_file(place) as file:
                for h, block in records(file):
                    if h["warc-type"] == "warcinfo":
                        continue
                    number = lambda name: int(h[name]) if name in h else None
                    digest, size, payload = h["warc-payload-digest"].removeprefix("sha1:"), number("x-payload-length"), None
                    if h["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if payload_digest(payload) != digest:
                            raise ValueError(f"{path}: a payload doesn't match its digest")
                        size = len(payload)
                    yield (number("x-page-id"), h["warc-target-uri"], h["warc-type"], size, digest, number("x-refers-to-page-id"), payload if payloads else None)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if len(held) == 5000 or size > 4 << 20:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    spark: SparkSession = archives.sparkSession
    spread = archives.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame, p: Archiving = Archiving()) -> DataFrame:
    """Archives the pages in the shared folder and reads them back, without payloads."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, p), payloads=False).drop("payload")
