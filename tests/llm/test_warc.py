"""Round trip of pages through archives, the file format, and faults."""

import hashlib

import pytest
import zstandard
from rankflow.llm import warc
from rankflow.session import new_folder

SCHEMA = "page_id long, url string, html string, DIGEST int"
BIG = "<p>é" + "x" * 150


def rows():
    out = [(i, f"http://h/{i}\r\n%0A", f"<html><b>{i % 7} page {i * i}</b>\r\n\r\n" + "word " * (i % 40), 1) for i in range(300)]
    return out + [
        (900, None, BIG, None), (901, "u", BIG, 2), (905, "u", BIG, 2), (905, "u", BIG, 2), (None, "n", BIG, 2), (902, "u", None, 2),
        (903, "", "", 2), (904, "u", "short", 2), (906, "u", "short", 2), (None, None, None, None), (907, "long", "y" * 300_000, 1),
    ]


@pytest.mark.parametrize("size", [1, 10_000, warc.ARCHIVE_BYTES])
def test_round_trip(spark, size):
    data, path = rows(), new_folder(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(data, SCHEMA), path, archive_bytes=size)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(data) and all(r.error is None for r in got)
    want = []
    for page, url, html, _ in data:
        body = (html or "").encode()
        revisit = html == BIG and page != 900
        want.append((page, url, "revisit" if revisit else "response", 900 if revisit else None, len(body), hashlib.sha256(body).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    payloads = {(r.page_id, r.url): bytes(r.payload) for r in got if r.record_type == "response"}
    assert all(payloads[(p, u)] == (h or "").encode() for p, u, h, _ in data if (p, u) in payloads)


def test_files_are_plain_zstandard(spark):
    path = new_folder(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows(), SCHEMA).coalesce(1), path)
    files = [r.content for r in spark.read.format("binaryFile").load(path).collect()]
    for data in map(bytes, files):
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
        known = zstandard.ZstdCompressionDict(data[8 : 8 + int.from_bytes(data[4:8], "little")])
        stream = zstandard.ZstdDecompressor(dict_data=known).stream_reader(data, read_across_frames=True)
        assert stream.read().startswith(b"WARC/1.1\r\n")
        assert sum(data[a : a + 4] == zstandard.FRAME_HEADER for a, _ in warc.frames(data)) > 0


def test_faults_are_reported():
    record = warc.make_record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "d")
    pack = zstandard.ZstdCompressor().compress
    assert warc.read_record(record)["payload"] == b"payload"
    for bad in (record.replace(b"payload\r", b"paXload\r"), record[:-1], b"x" + record, record.replace(b"Length: 7", b"Length: 8", 1), b""):
        assert next(iter(warc.read_archive(pack(bad))))["error"]
    assert next(iter(warc.read_archive(pack(record)[:-3])))["error"]
    assert [r["error"] for r in warc.read_archive(pack(record) + pack(record))] == [None, None]


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
