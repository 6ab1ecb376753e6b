"""Operator 5, WARC derivatives: metadata and conversion records from responses.

Records are rows: warc_type, record_id, target_uri, date, refers_to, headers (a map of the other
WARC fields, the values of a repeated field a line each), http_headers (text) and payload (bytes). ``derive`` turns each response into

  metadata    fields of the response (its status, type, length, title, links and digest), one
              ``name: value`` line each, with WARC-Refers-To the response's WARC-Record-ID
  conversion  the plain text of an HTML payload, or of a text payload as it is, with the same
              WARC-Refers-To, and WARC-Payload-Digest of the source kept as a field of the record

Both keep the response's target, date and all its fields but those of its own block, and carry
digests of their own blocks. Text is taken after transfer and content encodings are undone.
Record ids are name-based UUIDs of the source's id and the kind, so a rerun gives the same ids.
``serialise`` writes records as WARC/1.1 bytes, one gzip member each; ``parse`` reads them back.

Defined results
  null html: a response without payload. null url: no target URI, which the record leaves out.
  text that isn't HTML or text/*: no conversion record, as there is no text to give.
  encodings that the payload doesn't have, as they were undone before it was stored: the payload as it is.
  an encoding that can't be undone here (br): no title, links and conversion record.
  field names in any case and folded lines: as if they were spelt and written as usual.
  malformed records: parse() stops at the first broken header with an error that names its offset.
  repeated rows: each has its records; equal rows have equal ids. Empty table: empty result.
  columns beside the id, url and html aren't read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.html_tree import Page, attributes
from quillon.llm.scratch import BATCH_BYTES, bound_batches

#: The format's version, and the namespace of RFC 4122 for URLs.
VERSION = "WARC/1.1"
SPACE = uuid.NAMESPACE_URL
#: Elements whose text a reader doesn't see.
UNSEEN = frozenset("script style noscript template iframe head".split())
#: Fields of a source that its derivatives replace by their own; those of its block, kept under WARC-Source-.
REPLACED = frozenset("content-type content-length warc-block-digest warc-payload-digest warc-source-payload-digest".split())
OF_BLOCK = frozenset("warc-truncated warc-segment-number warc-segment-origin-id warc-segment-total-length".split())

#: Fields that are looked for by name, as they are spelt; a record may spell them in any case.
NAMES = {n.lower(): n for n in ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "WARC-Refers-To", "WARC-Payload-Digest", "WARC-Block-Digest", "Content-Type", "Content-Length")}

SCHEMA = "warc_type string, record_id string, target_uri string, date string, refers_to string, headers map<string,string>, http_headers string, payload binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, '|'.join(names))}>"


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages: id_col and the columns of a record.

    The table knows no capture date, so ``date`` is a parameter.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, bodies = (batch.column(c).to_pylist() for c in range(3))
            rows = []
            for key, url, body in zip(ids, urls, bodies, strict=True):
                payload = (body or "").encode("utf-8", "replace")
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                fields = {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(http.encode() + payload), "WARC-Page-ID": str(key)}
                rows.append(("response", record_id("response", str(key), url or "", fields["WARC-Payload-Digest"]), url, date, None, list(fields.items()), http, payload))
            yield _batch(batch.column(0), rows, id_col)

    bound_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(build, f"{id_col} {kind}, {SCHEMA}")


def _batch(ids: pa.Array, rows: list[tuple], id_col: str) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary())
    names = [id_col, *(c.split()[0] for c in SCHEMA.split(", "))]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)


def http_parts(http: str | None) -> tuple[str, list[tuple[str, str]]]:
    """Status line, and header fields in their order, with lower-case names."""
    lines = unfolded((http or "").split("\r\n"))
    fields = []
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields.append((name.strip().lower(), value.strip()))
    return lines[0], fields


def unfolded(lines: list[str]) -> list[str]:
    """Header lines with those that start with white space put, after a space, behind the one they go on."""
    out = lines[:1]
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and len(out) > 1:
            out[-1] = f"{out[-1].rstrip()} {line.strip()}"
        else:
            out.append(line)
    return out


def unchunked(data: bytes) -> bytes:
    """Content of a chunked body, up to where it was cut; ``data`` itself if it isn't chunked."""
    out, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]+)[ \t]*(?:;[^\r\n]*)?\r\n").match(data, at):
        size, at = int(m[1], 16), m.end()
        if not size:
            return b"".join(out)
        out.append(data[at : at + size])
        at += size + 2
        if not b"\r\n".startswith(data[at - 2 : at]):
            return data
    return b"".join(out) if out and at >= len(data) else data


def decompressed(data: bytes, make: Callable) -> bytes | None:
    """Content of all streams in ``data``, up to where it was cut or is broken; None if there is none."""
    out, found = [], False
    while data:
        one, at = make(), 0
        try:
            while at < len(data) and not one.eof:
                out.append(one.decompress(data[at : at + 65536]))
                at += 65536
        except (zlib.error, zstandard.ZstdError):
            return b"".join(out) if found or any(out) else None
        found = True
        data = one.unused_data + data[at:]
    return b"".join(out) if found else None


def decoded(payload: bytes, headers: list[tuple[str, str]]) -> bytes | None:
    """The payload without transfer and content encodings; None if one isn't known."""
    for field in ("transfer-encoding", "content-encoding"):
        for coding in reversed([c.strip().lower() for n, v in headers if n == field for c in v.split(",")]):
            if coding in ("", "identity"):
                continue
            if coding == "chunked":
                payload = unchunked(payload)
            elif coding in ("gzip", "x-gzip"):
                payload = _or_as_it_is(payload, lambda: zlib.decompressobj(31))
            elif coding == "deflate":
                payload = _or_as_it_is(payload, lambda: zlib.decompressobj(15), lambda: zlib.decompressobj(-15))
            elif coding == "zstd":
                payload = _or_as_it_is(payload, lambda: zstandard.ZstdDecompressor().decompressobj())
            else:
                return None
    return payload


def _or_as_it_is(data: bytes, *kinds: Callable) -> bytes:
    return next((x for x in (decompressed(data, kind) for kind in kinds) if x is not None), data)


def decode(payload: bytes, content_type: str) -> str:
    m = re.search(r"charset=\"?([\w.:-]+)", content_type, re.I)
    try:
        return payload.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def html_parts(source: str) -> tuple[str, list[str], str]:
    """Title, link targets in page order, and visible text with a line for each block."""
    page = Page(source)
    elements = page.elements
    seen = [True] * len(elements)
    title, links = "", []
    for k in range(1, len(elements)):
        tag, attrs, parent, first, end = elements[k]
        seen[k] = seen[parent] and tag not in UNSEEN
        if tag == "title" and not title and end > first + 1:
            title = " ".join(html.unescape("".join(page.tokens[first + 1 : end])).split())
        if attrs and tag in ("a", "area", "link", "img", "script", "iframe"):
            links += [html.unescape(v).strip() for n, v in attributes(attrs).items() if n in ("href", "src")]
    return title, links, "\n".join(page.blocks(seen))


def derive_one(source: tuple) -> list[tuple]:
    """The records derived from one response (a tuple in the order of ``SCHEMA``)."""
    kind, source_id, target, date, _, fields, http, payload = source
    if kind != "response":
        return []
    held, payload = dict(fields or {}), payload or b""
    status, headers = http_parts(http)
    content_type = next((v for n, v in headers if n == "content-type"), "")
    media = content_type.split(";")[0].strip().lower()
    is_html = media in ("text/html", "application/xhtml+xml")
    source_digest = next((v for n, v in held.items() if n.lower() == "warc-payload-digest" and v), None) or digest(payload)
    kept = {f"WARC-Source-{n[5:]}" if n.lower() in OF_BLOCK else n: v for n, v in held.items() if n.lower() not in REPLACED}
    body_bytes = decoded(payload, headers)
    readable = body_bytes is not None
    title, links, text = html_parts(decode(body_bytes, content_type)) if is_html and readable else ("", [], "")

    def record(what: str, mime: str, body: bytes, more: dict[str, str]) -> tuple:
        own = {**kept, "Content-Type": mime, "WARC-Source-Payload-Digest": source_digest, **more, "WARC-Block-Digest": digest(body)}
        return (what, record_id(what, source_id or ""), target, date, source_id, list(own.items()), None, body)

    lines = [("http-status", status), *((f"http-header-{n}", v) for n, v in headers), ("payload-length", str(len(payload))), ("payload-digest", source_digest)]
    if is_html and readable:
        lines += [("title", title), *(("outlink", _absolute(target, x)) for x in links)]
    about = "".join(f"{n}: {' '.join(v.split())}\r\n" for n, v in lines).encode("utf-8", "replace")
    out = [record("metadata", "application/warc-fields", about, {})]
    if readable and (is_html or media.startswith("text/")):
        plain = (text if is_html else decode(body_bytes, content_type)).encode("utf-8", "replace")
        out.append(record("conversion", "text/plain; charset=utf-8", plain, {"WARC-Payload-Digest": digest(plain)}))
    return out


def _absolute(base: str | None, link: str) -> str:
    try:
        return urljoin(base or "", link)
    except ValueError:
        return link


def derive(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Metadata and conversion records of all response records; other records give none."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, source in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 9)), strict=True)):
                for made in derive_one(source):
                    at.append(k)
                    rows.append(made)
            yield _batch(batch.column(0).take(pa.array(at, pa.int64())), rows, id_col)

    bound_batches(records.sparkSession)
    kind = records.schema[id_col].dataType.simpleString()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return records.select(id_col, *names).mapInArrow(build, f"{id_col} {kind}, {SCHEMA}")


def to_bytes(record: tuple) -> bytes:
    """One record as WARC/1.1."""
    kind, own_id, target, date, refers, fields, http, payload = record
    block = (http or "").encode("utf-8", "replace") + (payload or b"")
    named = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Refers-To", refers), *dict(fields or {}).items(), ("Content-Length", str(len(block)))]
    head = VERSION + "\r\n" + "".join(f"{n}: {one}\r\n" for n, v in named if v is not None for one in v.split("\n"))
    return head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


class Content:
    """The bytes of a file, plain or of all its gzip members, decompressed as far as they are asked for."""

    def __init__(self, data: bytes):
        self.parts = self._decompressed(data) if data[:2] == b"\x1f\x8b" else iter([data])
        self.held, self.at, self.start = bytearray(), 0, 0  # start: the file's byte at which ``held`` begins

    @staticmethod
    def _decompressed(data: bytes) -> Iterator[bytes]:
        at = 0
        while at < len(data):
            one = zlib.decompressobj(31)
            while at < len(data) and not one.eof:
                piece = data[at : at + 65536]
                yield one.decompress(piece)
                at += len(piece) - len(one.unused_data)

    def more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        if self.at:
            del self.held[: self.at]
            self.start, self.at = self.start + self.at, 0
        self.held += part
        return True

    def has(self, n: int) -> bool:
        """Whether ``n`` more bytes are there."""
        while len(self.held) - self.at < n:
            if not self.more():
                return False
        return True

    def upto(self, mark: bytes) -> bytes | None:
        """Bytes before ``mark``, which is passed over; None if it isn't there."""
        seen = 0
        while (found := self.held.find(mark, self.at + seen)) < 0:
            seen = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self.more():
                return None
        return self.take(found - self.at + len(mark))[: -len(mark)]

    def take(self, n: int) -> bytes:
        out = bytes(self.held[self.at : self.at + n])
        self.at += n
        return out

    def skip(self, mark: bytes) -> None:
        while self.has(len(mark)) and self.held[self.at : self.at + len(mark)] == mark:
            self.at += len(mark)

    @property
    def place(self) -> int:
        return self.start + self.at


def from_bytes(data: bytes) -> Iterator[tuple]:
    """The records in WARC bytes, plain or gzipped, one at a time, as tuples in the order of ``SCHEMA``."""
    source = Content(data)
    while source.has(1):
        at = source.place
        head = source.upto(b"\r\n\r\n")
        lines = (head or b"").decode("utf-8", "replace").split("\r\n")
        if head is None or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        named: dict[str, str] = {}
        spelt = dict(NAMES)
        for line in unfolded(lines)[1:]:
            name, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"broken header line in the WARC record at byte {at}")
            name, value = spelt.setdefault(name.strip().lower(), name.strip()), value.strip()
            named[name] = f"{named[name]}\n{value}" if name in named and name != "Content-Length" else value
        length = named.pop("Content-Length", "")
        if not length.isdecimal() or not source.has(int(length)):
            raise ValueError(f"no valid Content-Length in the WARC record at byte {at}")
        block = source.take(int(length))
        http = None
        if named.get("Content-Type", "").lower().startswith("application/http"):
            cut = block.find(b"\r\n\r\n")
            http, block = (block[: cut + 4].decode("utf-8", "replace"), block[cut + 4 :]) if cut >= 0 else (None, block)
        first = [named.pop(n, None) for n in ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "WARC-Refers-To")]
        yield (*first, list(named.items()), http, block)
        source.skip(b"\r\n")


def serialise(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id_col, warc_type, member: each record as one gzip member; joined in any order they are a .warc.gz file."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in range(1, 9)), strict=True)
            blobs = [gzip.compress(to_bytes(r), mtime=0) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], [id_col, "warc_type", "member"])

    bound_batches(records.sparkSession)
    kind = records.schema[id_col].dataType.simpleString()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return records.select(id_col, *names).mapInArrow(build, f"{id_col} {kind}, warc_type string, member binary")


def parse(spark: SparkSession, path: str) -> DataFrame:
    """All records of the .warc and .warc.gz files at ``path``; file is their place.

    A task holds a file as it is stored (2 GB at most: more is an error of the reader; WARC files are split below that), and of its content the records of one batch.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                for row in from_bytes(content):
                    rows.append(row)
                    size += len(row[-1])
                    if size >= BATCH_BYTES or len(rows) >= 1000:
                        yield _batch(pa.array([file] * len(rows), pa.string()), rows, "file")
                        rows, size = [], 0
                yield _batch(pa.array([file] * len(rows), pa.string()), rows, "file")

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(build, f"file string, {SCHEMA}")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all ``pages``, their headers as a line each."""
    made = derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), F.replace(e["value"], F.lit("\n"), F.concat(F.lit("\n"), e["key"], F.lit(": "))))), "\n")
    return made.select("page_id", "warc_type", "record_id", "target_uri", "date", "refers_to", lines.alias("headers"), F.decode("payload", "UTF-8").alias("content"), F.length("payload").cast("long").alias("content_length"))
