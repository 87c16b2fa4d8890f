import io
import struct

import zstandard

from wakeline.llm import warc as W
from wakeline.llm.queries import ORACLES, QUERIES

ROWS = [(1, "http://a/\n b", "<p>é</p>"), (2, "u", "<p>é</p>"), (2, "u2", "<p>é</p>"), (3, None, None), (4, "x", ""), (None, "n", "only"), (None, "m", "<p>é</p>"), (9, "long", "<i>" * 300_000)]


def test_round_trip_and_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, payload string")
    made = W.write_archives(pages, str(tmp_path), W.Archiving(archive_bytes=100_000))
    back = W.read_archives(made).collect()
    assert len(back) == len(ROWS) and made.count() >= 1
    full = {r.page_id: r for r in back if r.record_type == "response" and r.payload is not None}
    assert bytes(full[2].payload).decode() == "<p>é</p>" and len(full[9].payload) == 900_000 and bytes(full[4].payload) == b""
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in back) == sorted([
        ("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("3", "revisit", 4), ("4", "response", None), ("None", "response", None), ("None", "revisit", 2), ("9", "response", None)])
    assert {r.payload_digest for r in back if r.payload_bytes == 0} == {W.payload_digest(b"")}
    assert {r.url for r in back if r.page_id == 1} == {"http://a/%0A%20b"}


def test_archive_layout():
    records = [W.page_record(i, f"http://h/{i}", f"<html><body><p>page {i} of many that look alike</p></body></html>".encode() * 3, None, W.Archiving()) for i in range(400)]
    body = W.pack(records, W.Archiving())
    magic, size = struct.unpack("<II", body[:8])
    assert magic == 0x184D2A5D
    data = zstandard.ZstdCompressionDict(body[8:8 + size])
    first = zstandard.ZstdDecompressor(dict_data=data).decompressobj()
    assert first.decompress(body[8 + size:]) == records[0] and first.unused_data  # a frame holds one record
    assert [h["x-page-id"] for h, _ in W.records(io.BytesIO(body))] == [str(i) for i in range(400)]
    assert len(body) - size < len(W.pack(records, W.Archiving(sample_bytes=0)))


def test_empty_table_and_sql(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.read_archives(W.write_archives(none, str(tmp_path))).count() == 0
    assert "op6_warc_dictionary" in QUERIES and "op6_warc_dictionary" in ORACLES
