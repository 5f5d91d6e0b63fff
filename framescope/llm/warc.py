"""Derived records of a web archive: linked metadata and plain-text conversions.

Every ``response`` record gives two records that refer to it by its identifier:

* ``metadata`` (application/warc-fields): the identifier, digests, date and length
  of the response, its status line and all its HTTP headers in order;
* ``conversion`` (text/plain): all text of the page, one block a line, without
  markup; a response that is no text gives an empty conversion.

Target, date and payload digest of the response are kept; identifiers of derived
records follow from the response's, so a rerun gives the same records.  Digests
are ``sha1:`` in base 32, as is usual in such archives.

Bodies are undone from chunked transfer and from gzip or deflate coding; what is
broken there is taken as it stands.  The character set is the header's, else the
one named in the page's head, else UTF-8; bytes that do not fit are replaced.

Nulls: a null page is an empty body, a null address becomes ``urn:page:<id>``, a
record without block has an empty one; records of other types are passed over.
Repeated rows give repeated records.  Empty tables give no rows.  Other columns
are not read.  A record is whole in one task, nothing is cut.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_extract import blocks

#: Capture date of records made from pages that have none.
NO_DATE = "1970-01-01T00:00:00Z"
RECORD = "record_id string, warc_type string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, block binary"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:derived-records")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {source}')}>"


def _name(name: str) -> str:
    return name.replace("`", "")


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = NO_DATE) -> DataFrame:
    """``page_id`` and a response record of every page, as an archive would hold it."""
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").cast("binary").alias("html"))
    kind = own.schema["page_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for page, target, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = body or b""
                target = f"urn:page:{page}" if target is None else re.sub(r"\s", "%20", target)
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                made.append((derived_id(f"{page} {target} {digest(body)}", "response"), "response", None, target, date, "application/http;msgtype=response", digest(block), digest(body), block))
            yield _batch(made, batch.column(0), "page_id")

    return own.mapInArrow(rows, f"page_id {kind}, {RECORD}")


def _batch(made: list[tuple], key: pa.Array, key_name: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in RECORD.split(", ")]
    columns = list(zip(*made, strict=True)) if made else [()] * len(names)
    kinds = [pa.string()] * (len(names) - 1) + [pa.binary()]
    return pa.RecordBatch.from_arrays([key, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [key_name, *names])


def split_response(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order and body of an HTTP response; without a status line all is body."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    headers: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        else:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    return lines[0], headers, body


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(body):
            return body  # not chunked after all, or cut off
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def decoded(headers: list[tuple[str, str]], body: bytes) -> tuple[bytes, str]:
    """The body without transfer and content coding, and its content type."""
    named = {n.lower(): v for n, v in headers}
    if "chunked" in named.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    coding = named.get("content-encoding", "").lower()
    try:
        if "gzip" in coding:
            body = gzip.decompress(body)
        elif "deflate" in coding:
            body = zlib.decompress(body) if body[:1] == b"\x78" else zlib.decompress(body, -15)
    except (OSError, EOFError, zlib.error):
        pass
    return body, named.get("content-type", "text/html")


def plain_text(content_type: str, body: bytes) -> str:
    """All text of a body; empty for what is no text."""
    kind = content_type.split(";")[0].strip().lower()
    if not (kind.startswith("text/") or "html" in kind or "xml" in kind):
        return ""
    said = re.search(r"charset=[\"']?([\w.:-]+)", content_type, re.I) or re.search(r"<meta[^>]+charset=[\"']?([\w.:-]+)", body[:2048].decode("latin-1"), re.I)
    try:
        text = body.decode(said[1] if said else "utf-8", "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    return text if kind == "text/plain" else "\n".join(b.text for b in blocks(text))


def derived(record_id: str, target: str, date: str, block: bytes, payload: str | None) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    status, headers, body = split_response(block)
    plain, content_type = decoded(headers, body)
    payload = payload or digest(body)
    fields = [("refers-to", record_id), ("source-date", date), ("source-length", str(len(block))), ("source-block-digest", digest(block)), ("source-payload-digest", payload), ("http-status", status)]
    fields += [("http-header", f"{n}: {v}") for n, v in headers]
    about = "".join(f"{n}: {v}\r\n" for n, v in fields).encode()
    text = plain_text(content_type, plain).encode()
    return [
        (derived_id(record_id, "metadata"), "metadata", record_id, target, date, "application/warc-fields", digest(about), payload, about),
        (derived_id(record_id, "conversion"), "conversion", record_id, target, date, "text/plain; charset=utf-8", digest(text), payload, text),
    ]


def derive(records: DataFrame, key: str = "page_id") -> DataFrame:
    """``key`` and the derived records of every response among ``records``.

    ``payload_digest`` of a derived record is that of its response.
    """
    own = records.filter(F.col("warc_type") == "response").select(F.col(key).alias("key_"), "record_id", "target_uri", "date", "payload_digest", "block")
    kind = own.schema["key_"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, at = [], []
            for k, (record, target, date, payload, block) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                made += derived(record, target, date, block or b"", payload)
                at += [k, k]
            yield _batch(made, batch.column(0).take(pa.array(at, pa.int64())), key)

    return own.mapInArrow(rows, f"`{_name(key)}` {kind}, {RECORD}")


def member(record: dict) -> bytes:
    """A record as one gzip member of an archive file."""
    block = record["block"] or b""
    lines = [("WARC-Type", record["warc_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Refers-To", record["refers_to"]), ("WARC-Target-URI", record["target_uri"]), ("WARC-Date", record["date"]), ("WARC-Block-Digest", record["block_digest"]), ("WARC-Payload-Digest", record["payload_digest"]), ("Content-Type", record["content_type"]), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in lines if v is not None) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", mtime=0)


def read_members(data: bytes) -> list[dict]:
    """The records of an archive file (gzip members or plain), as ``member`` wrote them."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    out, at = [], 0
    while data.startswith(b"WARC/", at):
        end = data.index(b"\r\n\r\n", at)
        named = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        begin, size = end + 4, int(named["Content-Length"])
        out.append({"record_id": named.get("WARC-Record-ID"), "warc_type": named.get("WARC-Type"), "refers_to": named.get("WARC-Refers-To"), "target_uri": named.get("WARC-Target-URI"), "date": named.get("WARC-Date"), "content_type": named.get("Content-Type"), "block_digest": named.get("WARC-Block-Digest"), "payload_digest": named.get("WARC-Payload-Digest"), "block": data[begin : begin + size]})
        at = begin + size + 4
    return out


def archive_members(records: DataFrame, key: str = "page_id") -> DataFrame:
    """``key`` and ``member``: every record as a gzip member; members joined in any order make an archive file."""
    kind = records.schema[key].dataType.simpleString()
    own = records.select(F.col(key), *(f.split()[0] for f in RECORD.split(", ")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([member(r) for r in batch.to_pylist()], pa.binary())], [key, "member"])

    return own.mapInArrow(rows, f"`{_name(key)}` {kind}, member binary")
