import hashlib
import os
import struct
import time

import pytest
import zstandard

from noveltide.llm import warc


def records(*payloads):
    return [warc.record_bytes(i, f"http://x/{i}", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads)]


def test_archive_round_trip():
    small = records(b"", b"a" * 10)
    large = records(*(f"<html>{i} common words in every page {i * 17}</html>".encode() * 400 for i in range(40)))
    for rs in (small, large, records(b"x" * 3_000_000, bytes(range(256)) * 4000), records(os.urandom(300_000))):
        data = warc.write_archive(rs)
        assert struct.unpack_from("<I", data)[0] == warc.DICT_MAGIC
        got = list(warc.read_archive(data))
        assert [g.headers["x-page-id"] for g in got] == [str(i) for i in range(len(rs))]
        assert [len(g.payload) for g in got] == [warc.http_length(g.http) for g in got]


def test_reading_takes_time_in_proportion():
    body = lambda k: b"".join(hashlib.sha256(b"%d-%d" % (k, j)).digest() for j in range(125))
    rs = records(*(body(k) for k in range(2000)))
    times = []
    for part in (rs[:250], rs):
        data = warc.write_archive(part)
        start = time.process_time()
        assert sum(1 for _ in warc.read_archive(data)) == len(part)
        times.append(time.process_time() - start)
    assert times[1] < 24 * times[0] + 0.2


def test_frames_end_where_their_blocks_do():
    for level in (1, 19):
        for n in (0, 1, 100, 131_072, 131_073, 1_000_000):
            for raw in (b"a" * n, os.urandom(n)):
                for size, check in ((True, True), (False, False)):
                    frame = zstandard.ZstdCompressor(level=level, write_content_size=size, write_checksum=check).compress(raw)
                    assert warc.frame_end(b"12345" + frame + frame, 5) == 5 + len(frame)


def test_ids_are_integers(spark):
    with pytest.raises(TypeError):
        warc.write_warc(spark.createDataFrame([("a", "u", "b")], "page_id string, url string, html string"))


def test_plain_dictionary_and_foreign_skippable_frames():
    rs = records(b"hello world " * 30)
    raw = b"hello world " * 200
    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data = struct.pack("<II", warc.DICT_MAGIC, len(raw)) + raw + struct.pack("<II", 0x184D2A50, 3) + b"abc" + zstandard.ZstdCompressor(dict_data=d).compress(rs[0])
    assert [g.payload for g in warc.read_archive(data)] == [b"hello world " * 30]


@pytest.mark.parametrize("damage", [
    lambda d: d[:-3],
    lambda d: d + b"\x01\x02",
    lambda d: d + b"not a frame at all",
    lambda d: struct.pack("<II", warc.DICT_MAGIC, 99) + b"short",
])
def test_damaged_archives_raise(damage):
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(damage(warc.write_archive(records(b"x" * 500)))))


@pytest.mark.parametrize("old,new", [(b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 2", b"Content-Length: 3"), (b"WARC-Date", b"WARC-Dull"), (b"\r\n\r\nabc", b"\r\n\r\nabd"), (b"WARC-Record-ID:", b"WARC-Record-ID ")])
def test_invalid_records_raise(old, new):
    raw = records(b"abc" * 60)[0]
    assert old in raw
    with pytest.raises(warc.WarcError):
        warc.parse_record(raw.replace(old, new, 1))


def test_two_records_in_a_frame_raise():
    a, b = records(b"a" * 20, b"b" * 20)
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(zstandard.ZstdCompressor().compress(a + b)))


def test_pages(spark):
    body = "é" * 60
    rows = [(5, "u", body), (3, "u\r\nX: y", body), (9, None, body), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (3, "v", body), (7, "u", "z" * 200_000), (None, "u", body)]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, digest int, first int")
    got = warc.read_warc(warc.write_warc(pages)).collect()
    assert len(got) == len(rows)
    seen = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert seen == sorted([(5, "revisit", 3, 120), (3, "response", None, 120), (9, "revisit", 3, 120), (1, "response", None, 5), (2, "response", None, 5), (4, "response", None, 0), (6, "response", None, 0), (3, "response", None, 120), (7, "response", None, 200_000), (0, "revisit", 3, 120)], key=lambda r: (r[0], r[1], r[2] or 0, r[3]))
    assert all(r.payload_digest == hashlib.sha256({120: body, 5: "short", 0: "", 200_000: "z" * 200_000}[r.payload_bytes].encode()).hexdigest() for r in got)
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0
