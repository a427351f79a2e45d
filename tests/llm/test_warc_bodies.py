"""WARC bodies of several members, bodies that grow, digests and repeated rows."""

import gzip
import zlib

import pytest
import zstandard

from graphtide.llm import warc

PAGE = b"<html><body>one<p>two</body></html>"


def made(headers, body, payload=None):
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{headers}\r\n\r\n".encode() + body
    return warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), *([("WARC-Payload-Digest", warc.digest(payload))] if payload is not None else [])], block)


@pytest.mark.parametrize("coding,body", [("gzip", gzip.compress(PAGE[:15]) + gzip.compress(PAGE[15:])), ("gzip", gzip.compress(b"") + gzip.compress(PAGE) + gzip.compress(b"") + b"\0\0"), ("x-gzip", gzip.compress(PAGE)), ("zstd", zstandard.compress(PAGE[:9]) + zstandard.compress(PAGE[9:])), ("deflate", zlib.compress(PAGE)), ("deflate", zlib.compress(PAGE)[2:-4]), ("deflate, gzip", gzip.compress(zlib.compress(PAGE)))])
def test_all_members_are_read(coding, body):
    rows = warc.derive(made(f"Content-Encoding: {coding}", body))
    assert [r[-1] for r in rows] == [None, None] and rows[1][-2] == "one\ntwo"


@pytest.mark.parametrize("body", [gzip.compress(PAGE)[:-9], gzip.compress(PAGE[:9]) + gzip.compress(PAGE[9:])[:20], b""])
def test_a_member_that_ends_too_soon_is_an_error(body):
    (row,) = warc.derive(made("Content-Encoding: gzip", body))
    assert row[-1].startswith("coding gzip")


@pytest.mark.parametrize("coding,pack", [("gzip", gzip.compress), ("deflate", zlib.compress), ("zstd", zstandard.compress)])
def test_bodies_grow_within_a_bound(coding, pack, monkeypatch):
    most = 100_000
    whole = b"x" * most
    assert warc.decoded([("Content-Encoding", coding)], pack(whole), most)[1] == whole
    for body in (pack(whole + b"x"), pack(bytes(200 << 20))):
        with pytest.raises(ValueError, match="more than 100000 bytes"):
            warc.decoded([("Content-Encoding", coding)], body, most)
    with pytest.raises(ValueError, match="more than"):
        warc.decoded([("Content-Encoding", "gzip")], gzip.compress(whole[:60_000]) * 2, most)


def test_payload_digests_are_of_the_body_without_transfer_codings():
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(PAGE[i : i + 7]), PAGE[i : i + 7]) for i in range(0, len(PAGE), 7)) + b"0\r\n\r\n"
    packed = gzip.compress(PAGE)
    for headers, body, payload, said in (
        ("Transfer-Encoding: chunked", chunked, PAGE, "valid"), ("Transfer-Encoding: chunked", chunked, chunked, "invalid"), ("Content-Encoding: gzip", packed, packed, "valid"),
        ("Content-Encoding: gzip", packed, PAGE, "invalid"), ("X: y", PAGE, PAGE, "valid"), ("X: y", PAGE, None, "unchecked"),
    ):
        assert f"source-payload-digest: {said}\r\n" in warc.derive(made(headers, body, payload))[0][-2]


def test_repeated_rows_give_equal_records(spark):
    data = made("Content-Encoding: gzip", gzip.compress(PAGE))
    rows = warc.derivatives(spark.createDataFrame([(1, data), (1, data), (2, data)], "page_id long, record binary")).collect()
    assert len(rows) == 6 and len({tuple(r)[1:] for r in rows}) == 2
