"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from noveltide.llm.common import prepare, table
from noveltide.session import materialize

#: The skippable frame that holds the dictionary has this magic number.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: Bytes of a dictionary at most, and of each record's head that goes into it.
DICT_BYTES, HEAD_BYTES = 64 << 10, 2 << 10
#: An archive is closed at this many bytes of records.
ARCHIVE_BYTES = 8 << 20
#: Payloads under this many bytes are never revisits.
REVISIT_BYTES = 100


class Record(NamedTuple):
    headers: dict[str, str]
    http: bytes
    payload: bytes


class WarcError(ValueError):
    """An archive or a record that isn't valid."""


def _uuid(page_id: object) -> str:
    h = hashlib.sha256(f"page-{page_id}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def record_bytes(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object | None) -> bytes:
    """A response record, or a revisit record (identical payload) if `refers_to` names a page."""
    http = _http(len(payload))
    block = http if refers_to is not None else http + payload
    clean = "".join(c for c in url or "urn:none" if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {_uuid(page_id)}",
        f"WARC-Target-URI: {clean}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Page-ID: {page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: {_uuid(refers_to)}",
            f"X-Refers-To-Page-ID: {refers_to}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(records: list[bytes], level: int = 3) -> bytes:
    """One archive of one frame per record; the dictionary, heads of evenly spread records, stands in the leading skippable frame."""
    step = max(1, len(records) // (DICT_BYTES // HEAD_BYTES))
    raw = b"".join(r[:HEAD_BYTES] for r in records[::step])[:DICT_BYTES]
    dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content = zstandard.ZstdCompressor(level=9).compress(raw)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", DICT_MAGIC, len(content)), content, *map(compressor.compress, records)])


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that starts at `at` ends, by its header and the headers of its blocks; nothing is decoded."""
    try:
        flags = data[at + 4]
        single = flags >> 5 & 1
        sizes = ((1 if single else 0), 2, 4, 8)[flags >> 6]
        end = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + sizes
        while True:
            head = int.from_bytes(data[end : end + 3], "little")
            kind, size = head >> 1 & 3, head >> 3
            if kind == 3 or end + 3 > len(data):
                raise WarcError(f"the frame at byte {at} has a block that isn't valid")
            end += 3 + (1 if kind == 1 else size)
            if head & 1:
                break
    except IndexError as e:
        raise WarcError(f"the frame at byte {at} is cut off") from e
    end += 4 * (flags >> 2 & 1)
    if end > len(data):
        raise WarcError(f"the frame at byte {at} is cut off")
    return end


def read_archive(data: bytes) -> Iterator[Record]:
    """The records of an archive, each checked.

    The dictionary comes from the leading skippable frame, plain or itself
    compressed; other skippable frames are passed over. Every further frame must
    hold exactly one record.
    """
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        content = data[8 : 8 + size]
        if len(content) != size:
            raise WarcError("the dictionary frame is cut off")
        if content[:4] == struct.pack("<I", FRAME_MAGIC):
            content = zstandard.ZstdDecompressor().decompress(content)
        dictionary = zstandard.ZstdCompressionDict(content)
        at = 8 + size
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    view = memoryview(data)
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError("bytes after the last frame")
        magic = struct.unpack_from("<I", data, at)[0]
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        end = frame_end(data, at)
        frame = decompressor.decompressobj()
        try:
            raw = frame.decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at byte {at}: {e}") from e
        if not frame.eof or frame.unused_data:
            raise WarcError(f"the frame at byte {at} isn't whole")
        at = end
        yield parse_record(raw)


def parse_record(raw: bytes) -> Record:
    """One record from one frame: version, required headers, lengths and digests must hold."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("no end of headers")
    lines = raw[:end].decode("utf-8").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"version {lines[0][:20]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"header {line[:40]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["content-length"].isdigit():
        raise WarcError("content-length isn't a number")
    block = raw[end + 4 : -4]
    if len(raw) < end + 8 or raw[-4:] != b"\r\n\r\n" or len(block) != int(headers["content-length"]):
        raise WarcError("the record's length isn't its content-length")
    if (d := headers.get("warc-block-digest", "")).startswith("sha256:") and d[7:] != hashlib.sha256(block).hexdigest():
        raise WarcError("the block's digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("no HTTP headers")
    if headers["warc-type"] == "response" and (d := headers.get("warc-payload-digest", "")).startswith("sha256:") and d[7:] != hashlib.sha256(payload).hexdigest():
        raise WarcError("the payload's digest differs")
    return Record(headers, http, payload)


def http_length(http: bytes) -> int:
    for line in http.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value)
    raise WarcError("no HTTP content-length")


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Archives (column content) with a record per row of `pages`.

    Of rows with equal payloads of `REVISIT_BYTES` or more, the one with the
    smallest id is the response and the others are revisits of it; rows that
    repeat its id too are responses like it. Payloads are the text in UTF-8, a
    null being empty. The smallest id per digest is summed per task before the
    shuffle, so a payload that many rows share costs one row per task. Ids are integers or
    null (a null id is written as empty and read back as null); other columns are ignored, whatever their names.
    """
    if not isinstance(pages.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} isn't an integer column")
    prepare(pages.sparkSession)
    narrow = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[body_col].cast("string"), F.lit("")).alias("body"))
    narrow = narrow.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256))
    long = F.octet_length("body") >= REVISIT_BYTES
    firsts = pages.select(pages[id_col].alias("id"), F.coalesce(pages[body_col].cast("string"), F.lit("")).alias("body")).where(long)
    firsts = firsts.groupBy(F.sha2(F.col("body").cast("binary"), 256).alias("digest")).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    firsts = materialize(firsts.where("n > 1").select("digest", "first"), "warc-repeats")
    joined = narrow.join(firsts, "digest", "left").withColumn("refers", F.when(long & (F.col("first") != F.coalesce("id", F.col("first") - 1)), F.col("first")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0
        for batch in batches:
            for page, url, body, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                records.append(record_bytes("" if page is None else page, url, body.encode(), digest, refers))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([write_archive(records)], pa.binary())], names=["content"])
                    records, size = [], 0
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([write_archive(records)], pa.binary())], names=["content"])

    return joined.select("id", "url", "body", "digest", "refers").mapInArrow(write, "content binary")


def read_warc(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """The records of archives: a table with a binary column, as Spark's binaryFile source gives it.

    Returns record_type, record_id, target_uri, page_id, refers_to, payload_bytes
    and payload_digest (of the full payload, for a revisit as its record states
    them), payload (null for a revisit). An archive that breaks the format
    raises; a null archive has no records.
    """
    prepare(archives.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for record in read_archive(data or b""):
                    h, revisit = record.headers, record.headers["warc-type"] == "revisit"
                    length = http_length(record.http)
                    if not revisit and length != len(record.payload):
                        raise WarcError("the payload's length isn't its HTTP content-length")
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(record.payload).hexdigest()
                    number = lambda k: int(h[k]) if h.get(k) else None
                    rows.append((h["warc-type"], h["warc-record-id"], h.get("warc-target-uri"), number("x-page-id"), number("x-refers-to-page-id"), length, digest, None if revisit else record.payload))
                if rows:
                    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["record_type", "record_id", "target_uri", "page_id", "refers_to", "payload_bytes", "payload_digest", "payload"])

    schema = "record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return archives.select(archives[content_col].alias("content")).mapInArrow(read, schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialize(write_warc(table(spark, sf_dir, "pages")), "warc")
    return read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES = {
    "op1_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""
}
