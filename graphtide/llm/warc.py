"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A derivative names its response in WARC-Refers-To and WARC-Refers-To-Target-URI and carries the response's date, block
and payload digests (and whether they are right) and HTTP headers on. Text is taken from the body without its transfer and content codings. Ids are UUIDs of the source's id and the derivative's kind, so that a retried task
writes the same records.

Defined results: a null or damaged record, and one with an unknown or broken coding or a body that grows beyond INFLATED
bytes, gives one `metadata` row with a non-null `error` and no links; a gzip or zstandard body may have several members, which
follow each other; a payload digest is held against the body without its transfer codings; an empty body gives an empty conversion; repeated rows give repeated, equal records. A very
long page, unclosed tags and comments included, is read in time that grows with its length. Other columns are ignored; the
key may have any name but those of the result.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtide.llm.common import map_rows

VERSION = "WARC/1.1"
#: Most bytes that a coding may give for one body; a body that would give more is an error.
INFLATED = 128 << 20
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "2024-01-01T00:00:00Z"
HIDDEN = ("script", "style", "template", "noscript", "head")
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*HIDDEN, "title")}
BREAK = re.compile(r"(?:p|div|br|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|main|blockquote|pre|hr|dd|dt|dl|form|figure|aside)\Z")
TAG = re.compile(r"<(/?)([A-Za-z!?][A-Za-z0-9-]*)[^>]*>")
LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.I)
BLANKS = re.compile(r"[^\S\n]+")
LINES = re.compile(r"\s*\n\s*")
CHARSET = re.compile(r"charset=[\"']?([\w-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(10).join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"{VERSION}\r\n{head}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _one_line(s: str) -> str:
    return " ".join(s.split())


def response(uri: str | None, body: str | None, key: str, date: str = DATE) -> bytes:
    """A response record for a page of text/html."""
    payload = (body or "").encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, uri or "")), ("WARC-Target-URI", _one_line(uri or "")), ("WARC-Date", date), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")]
    return record(headers, block)


def _headers(lines: list[str]) -> list[tuple[str, str]]:
    """Names and values; a line that begins with white space goes on with the one above."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    headers = {k.lower(): v for k, v in _headers(lines[1:])}
    n = int(headers.get("content-length", "-1"))
    if n < 0 or n > len(rest):
        raise ValueError("block shorter than Content-Length")
    return headers, rest[:n]


def parse_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers, body."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    lines = head.decode("latin-1").split("\r\n")
    return lines[0], _headers(lines[1:]), body


class Ends:
    """Where comments and elements end. What isn't found once is not looked for again, so that a page is read a fixed number of times."""

    def __init__(self, page: str) -> None:
        self.page, self.missing = page, set()

    def after(self, name: str, at: int) -> int | None:
        """The place behind the end of the comment ('!--') or of the element `name` that begins before `at`."""
        if name in self.missing:
            return None
        if name == "!--":
            found = self.page.find("-->", at) + 3
            out = found if found > 2 else None
        else:
            m = CLOSING[name].search(self.page, at)
            out = m.end() if m else None
        if out is None:
            self.missing.add(name)
        return out


def tags(page: str, at: int = 0) -> Iterator[re.Match]:
    """A tag goes on to the next '>'; behind the last '>' there is none."""
    return TAG.finditer(page, at, page.rfind(">") + 1)


def plain_text(page: str) -> str:
    """Visible text: one line for each block element, blanks collapsed, entities resolved after tags are gone. Comments and hidden elements that never end are tags like others."""
    ends, end, parts, at = Ends(page), page.rfind(">") + 1, [], 0
    while m := TAG.search(page, at, end):
        parts.append(page[at : m.start()])
        name = m[2].lower()
        behind = None
        if page.startswith("<!--", m.start()):
            behind = ends.after("!--", m.start() + 4)
        elif not m[1] and name in HIDDEN:
            behind = ends.after(name, m.end())
        if behind is not None:
            parts.append(" ")
        elif BREAK.match(name):
            parts.append("\n")
        at = m.end() if behind is None else behind
    parts.append(page[at:])
    return LINES.sub("\n", BLANKS.sub(" ", html.unescape("".join(parts)))).strip()


def page_fields(page: str) -> tuple[str, str, list[str]]:
    """Title, language and links, from all tags of the page."""
    title, lang, links = None, None, []
    for m in tags(page):
        name = "" if m[1] else m[2].lower()
        if name == "title" and title is None:
            closing = CLOSING["title"].search(page, m.end())
            title = page[m.end() : closing.start()] if closing else ""
        elif name == "html" and lang is None and (found := LANG.search(m[0])):
            lang = found[1]
        elif name == "a" and (found := HREF.search(m[0])):
            links.append(_one_line(html.unescape(found[1] if found[1] is not None else found[2])))
    return _one_line(html.unescape(title or "")), lang or "", links


def _dechunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunked body without its last chunk")
        n = int(body[at:end].split(b";")[0], 16)
        if n <= 0:
            return b"".join(parts)
        if end + 2 + n > len(body):
            raise ValueError("chunk passes the body's end")
        parts.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def _inflated(body: bytes, window: int, most: int) -> bytes:
    """All members of a gzip body, or one zlib or raw stream. What follows the last member is left out."""
    parts, left = [], most
    while True:
        stream = zlib.decompressobj(window)
        parts.append(stream.decompress(body, left + 1))
        left -= len(parts[-1])
        if left < 0:
            raise ValueError(f"more than {most} bytes")
        if not stream.eof:
            raise ValueError("ends too soon")
        body = stream.unused_data
        if window < 16 or not body.startswith(b"\x1f\x8b"):
            return b"".join(parts)


def _named(http: list[tuple[str, str]], header: str) -> list[str]:
    return [x.strip().lower() for k, v in http if k.lower() == header for x in v.split(",") if x.strip()]


def _without(codings: list[str], body: bytes, most: int) -> bytes:
    for coding in reversed(codings):
        try:
            if coding == "chunked":
                body = _dechunked(body)
            elif coding in ("gzip", "x-gzip"):
                body = _inflated(body, 31, most)
            elif coding == "deflate":
                try:
                    body = _inflated(body, 15, most)
                except zlib.error:
                    body = _inflated(body, -15, most)
            elif coding == "zstd":
                body = zstandard.ZstdDecompressor().stream_reader(body, read_across_frames=True).read(most + 1)
                if len(body) > most:
                    raise ValueError(f"more than {most} bytes")
            elif coding != "identity":
                raise ValueError("unknown")
        except (ValueError, zlib.error, zstandard.ZstdError) as e:
            raise ValueError(f"coding {coding}: {e}") from e
    return body


def decoded(http: list[tuple[str, str]], body: bytes, most: int = INFLATED) -> tuple[bytes, bytes]:
    """The body without its transfer codings (what a payload digest is of), and without its content codings as well. ValueError where a coding is unknown or broken, or would give more than `most` bytes."""
    payload = _without(_named(http, "transfer-encoding"), body, most)
    return payload, _without(_named(http, "content-encoding"), payload, most)


def _agrees(said: str | None, data: bytes) -> str:
    """Whether a digest of the source is that of its bytes; 'unchecked' for other digests than SHA-1."""
    if not said or not said.lower().startswith("sha1:"):
        return "unchecked"
    return "valid" if said[5:].upper() == digest(data)[5:] else "invalid"


def derive(data: bytes) -> list[tuple]:
    """(record_type, record_id, refers_to, target_uri, date, content_type, block_digest, source_block_digest, source_payload_digest, source_headers, block, error) of a response's derivatives."""
    try:
        headers, block = parse(data)
        if headers.get("warc-type") != "response":
            raise ValueError(f"not a response: {headers.get('warc-type')}")
        status, http, body = parse_http(block)
        payload, content = decoded(http, body)
    except ValueError as e:
        return [("metadata", *[None] * 10, str(e))]
    source, uri, date = headers.get("warc-record-id", ""), headers.get("warc-target-uri", ""), headers.get("warc-date", "")
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    charset = CHARSET.search(kind)
    try:
        page = content.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, ValueError):
        page = content.decode("utf-8", "replace")
    title, lang, links = page_fields(page)
    fields = [("title", title), ("language", lang), ("source-status", status), ("source-content-type", kind), ("source-length", str(len(body)))]
    fields += [("source-block-digest", _agrees(headers.get("warc-block-digest"), block)), ("source-payload-digest", _agrees(headers.get("warc-payload-digest"), payload))]
    fields += [("outlink", link) for link in links]
    blocks = {"metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)), "conversion": ("text/plain; charset=utf-8", plain_text(page))}
    kept = json.dumps(http, ensure_ascii=False)
    own = {"metadata": record_id("metadata", source), "conversion": record_id("conversion", source)}
    return [(k, own[k], source, uri, date, media, digest(text.encode("utf-8", "surrogatepass")), headers.get("warc-block-digest"), headers.get("warc-payload-digest"), kept, text, None) for k, (media, text) in blocks.items()]


FIELDS = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, source_block_digest string, source_payload_digest string, source_headers string, block string, error string"


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, record): a response record for each row of pages (page_id, url, html)."""

    def rows(batch):
        for row in batch:
            yield row["page_id"], response(row["url"], row["html"], str(row["page_id"]), date)

    return map_rows(pages.select("page_id", "url", "html"), rows, "page_id long, record binary")


def derivatives(records: DataFrame, key: str = "page_id", data: str = "record") -> DataFrame:
    """The key and the derivatives' columns, two rows for each response. ValueError for a key that is called like one of these."""
    if key.lower() in {f.split()[0] for f in FIELDS.split(", ")}:
        raise ValueError(f"a derivative has a column {key} of its own")

    def rows(batch):
        for row in batch:
            for out in [("metadata", *[None] * 10, "null record")] if row["d"] is None else derive(bytes(row["d"])):
                yield row["k"], *out

    return map_rows(records.select(F.col(key).alias("k"), F.col(data).alias("d")), rows, f"{key} {dict(records.dtypes)[key]}, {FIELDS}")


def to_bytes(rows: DataFrame) -> DataFrame:
    """(record_id, record): the derivatives as bytes of a WARC file, linked to their sources by WARC-Refers-To, with the source's digests and its HTTP headers (as JSON, in a header of our own). Rows with an error have no record."""

    def write(batch):
        for r in batch:
            if r["error"] is None:
                headers = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Refers-To-Target-URI", r["target_uri"]), ("WARC-Date", r["date"]), ("WARC-Block-Digest", r["block_digest"]), ("WARC-Source-Block-Digest", r["source_block_digest"] or ""), ("WARC-Source-Payload-Digest", r["source_payload_digest"] or ""), ("WARC-Source-HTTP-Headers", r["source_headers"] or ""), ("Content-Type", r["content_type"])]
                yield r["record_id"], record(headers, r["block"].encode("utf-8", "surrogatepass"))

    return map_rows(rows, write, "record_id string, record binary")
