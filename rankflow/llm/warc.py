"""WARC archives compressed with Zstandard: one frame a record, the dictionary in a leading skippable frame.

Writing: payload digests find copies (a grouped minimum, combined map-side, and a salted join, so
a page repeated a million times is no hot key); of equal payloads of at least `REVISIT_BYTES`
bytes the smallest page_id is a response, the others are revisits without a payload. A task packs
about `ARCHIVE_BYTES` of payload into each archive and returns it as one value; Spark's text
writer puts each value into a file of its own (`maxRecordsPerFile` 1), so files go through its
commit protocol to any file system and survive lost executors. The line end it appends is the
one-byte content of a skippable frame that closes the archive.

Reading: each file's dictionary comes from its leading frame, every other frame is one record,
decoded on its own. Headers, lengths and digests are checked; a record that fails has its fault in
`error` and nulls elsewhere.

Null html is an empty payload; null urls stay null. A null page_id is never the page that others
revisit, and rows that repeat the smallest page_id are all responses. An empty table gives no records.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from rankflow.llm.common import salted
from rankflow.session import new_folder

REVISIT_BYTES = 100
#: Payload bytes after which an archive is closed.
ARCHIVE_BYTES = 32 << 20
#: The dictionary is fitted on the first 16 KiB of at most so many payloads.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 16384, 32768
LEVEL = 3
# Fixed values of the formats.
DICTIONARY_MAGIC, SKIPPABLE_MAGIC = 0x184D2A5D, 0x184D2A50
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def fit_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample; empty where the sample is too small for one."""
    texts = pages.where("html IS NOT NULL").select(F.substring("html", 1, SAMPLE_CHARS)).limit(SAMPLE_PAGES).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r[0].encode("utf-8", "surrogatepass") for r in texts]).as_bytes()
    except zstandard.ZstdError:
        return b""


def make_record(page: object, url: object, payload: bytes, digest: str, refers: object, date: str) -> bytes:
    lines = [
        VERSION, f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Date: {date}",
        f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}", "X-Page: " + json.dumps([page, url]),
        "Content-Type: application/http; msgtype=response",
    ]
    if refers is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers is None else http
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def read_record(data: bytes) -> dict:
    """Fields of a record; ValueError where headers, lengths or digest do not hold."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError("no WARC header")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    if int(fields["Content-Length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("wrong Content-Length")
    http, found, payload = rest[:-4].partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/1.1 200 OK\r\n"):
        raise ValueError("no HTTP header")
    size, kind = int(fields["X-Payload-Length"]), fields["WARC-Type"]
    if f"\r\nContent-Length: {size}".encode() not in http:
        raise ValueError("payload lengths differ")
    algorithm, _, digest = fields["WARC-Payload-Digest"].partition(":")
    page, url = json.loads(fields["X-Page"])
    refers = None
    if kind == "revisit":
        if payload or fields["WARC-Profile"] != PROFILE:
            raise ValueError("not a revisit")
        refers = int(fields["WARC-Refers-To"][len("<urn:page:") : -1])
    elif kind != "response" or len(payload) != size or algorithm != "sha256" or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload differs from its length or digest")
    return {
        "page_id": page, "url": url, "record_type": kind, "refers_to": refers, "payload_bytes": size,
        "payload_digest": digest, "payload": payload if kind == "response" else None, "error": None,
    }


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def frames(data: bytes) -> Iterator[tuple[int, int]]:
    """Begin and end of each frame, from block headers alone."""
    at = 0
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        else:
            head = data[at : at + 18]
            end, last = at + zstandard.frame_header_size(head), False
            while not last:
                block = int.from_bytes(data[end : end + 3], "little")
                last = block & 1
                end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            end += 4 * zstandard.get_frame_parameters(head).has_checksum
        if end > len(data):
            raise ValueError("archive ends inside a frame")
        yield at, end
        at = end


def read_archive(data: bytes) -> Iterator[dict]:
    reader = zstandard.ZstdDecompressor()
    try:
        for at, end in frames(data):
            magic = int.from_bytes(data[at : at + 4], "little")
            if magic == DICTIONARY_MAGIC and at == 0:
                known = data[8:end]
                if known[:4] == zstandard.FRAME_HEADER:  # dictionaries may be compressed themselves
                    known = reader.decompress(known)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known))
            elif magic & 0xFFFFFFF0 != SKIPPABLE_MAGIC:
                try:
                    yield read_record(reader.decompress(data[at:end]))
                except (ValueError, KeyError, zstandard.ZstdError) as fault:
                    yield {"error": f"byte {at}: {fault}"}
    except (ValueError, zstandard.ZstdError) as fault:
        yield {"error": str(fault)}


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    copies = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")
    )
    joined = salted(rows, copies.where("n > 1").drop("n"), ["digest"], F.struct("page_id", "url"))
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first")).alias("refers")
    shared = spark.sparkContext.broadcast(fit_dictionary(pages))  # at most DICTIONARY_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, writer = b"", zstandard.ZstdCompressor(level=LEVEL)
        if shared.value:
            known = zstandard.ZstdCompressionDict(shared.value)
            known.precompute_compress(level=LEVEL)
            lead, writer = skippable(DICTIONARY_MAGIC, shared.value), zstandard.ZstdCompressor(dict_data=known)
        close = struct.pack("<II", SKIPPABLE_MAGIC, 1)  # the writer's line end is its content
        parts, size = [lead], 0
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.append(writer.compress(make_record(*values, date)))
                size += len(values[2])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join([*parts, close])], pa.binary())], ["archive"])
                    parts, size = [lead], 0
        if len(parts) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join([*parts, close])], pa.binary())], ["archive"])

    archives = joined.select("page_id", "url", "payload", "digest", refers).mapInArrow(pack, "archive binary")
    archives.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RECORD.split(", "))])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held, size = [], 0
                for record in read_archive(batch.column(0)[k].as_py()):
                    held.append(record)
                    size += len(record.get("payload") or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(unpack, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in a new folder of the shared store and read them back."""
    path = new_folder(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to, TRUE AS valid
FROM f
"""
