import base64
import hashlib

import pytest

from podium.llm import warc

ROWS = [
    (5, "http://a", "same"), (3, "http://b", "same"), (9, "http://c\r\nWARC-Type: response", "same"), (1, None, None), (2, "", ""), (7, "u%0D X-Page-ID: 8", "é😀" * 1000),
    (4, "d", "single"), (4, "d", "single"), (None, "n", "single"), (None, "m", "only null"), (None, "m", "only null"), (6, "x", "\r\n\r\nWARC/1.1\r\n"), (8, "y", "z" * 500_000),
]


def expect(rows, least=0):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data]
        owner = min((p for p in same if p is not None), default=None)
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), len(data) < least, owner))
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*r, "own", "own") for r in ROWS], "page_id bigint, url string, html string, digest string, record string")
    archive = warc.write_archive(pages, least)
    assert archive.payloads.count() == len({(h or "") for _, _, h in ROWS})
    got = warc.parse_records(warc.read_archive(archive)).collect()
    want = expect(ROWS, least)
    assert sorted(map(str, [(r.page_id, r.payload_bytes, r.payload_digest) for r in got])) == sorted(map(str, [w[:3] for w in want]))
    for digest in {w[2] for w in want}:
        mine, owner = [r for r in got if r.payload_digest == digest], next(w for w in want if w[2] == digest)
        if owner[3]:
            assert all(r.record_type == "response" and r.refers_to is None for r in mine)
        else:
            responses = [r for r in mine if r.record_type == "response"]
            assert [r.page_id for r in responses] == [owner[4]]
            assert all(r.refers_to == owner[4] for r in mine if r.record_type == "revisit")
    assert warc.parse_records(warc.read_archive(warc.write_archive(pages.where("false")))).count() == 0


def test_record_bytes(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>é"), (2, "http://b", "<p>é")], "page_id bigint, url string, html string")
    records = warc.read_archive(warc.write_archive(pages))
    content = sorted(bytes(r.content) for r in warc.record_bytes(records).collect())
    response, revisit = (next(c for c in content if t in c) for t in (b"WARC-Type: response", b"WARC-Type: revisit"))
    head, _, body = response.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\n") and b"Content-Length: 5" in head and body == "<p>é".encode() + b"\r\n\r\n"
    assert revisit.endswith(b"\r\n\r\n\r\n\r\n") and b"Content-Length: 0" in revisit
    record_id = next(line for line in head.split(b"\r\n") if line.startswith(b"WARC-Record-ID")).partition(b": ")[2]
    assert b"WARC-Refers-To: " + record_id in revisit


def test_damage_is_noticed(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "def")], "page_id bigint, url string, html string")
    archive = warc.write_archive(pages)
    other = archive.payloads.selectExpr("digest", "first(frame) OVER (PARTITION BY 1 ORDER BY digest) AS frame")
    for damaged in (other, archive.payloads.selectExpr("digest", "cast('abx' as binary) AS frame"), archive.payloads.limit(1)):
        with pytest.raises(Exception, match="lost or damaged"):
            warc.read_archive(warc.Archive(archive.headers, damaged)).collect()
