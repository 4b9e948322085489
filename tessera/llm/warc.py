"""WARC derivatives: each response becomes a metadata record and a plain-text conversion record that point back to it.

A derivative keeps what names its source: WARC-Refers-To has the response's id, and the target URI, the date and the
response's payload digest are carried over; the response's HTTP headers stand in the metadata block, and its content
type and last-modified date in the conversion's own fields. Every record has the SHA-256 of its block. Ids are derived
from type, source and digest, so a task that runs again writes the same records.

Responses come from WARC files (``read_records``) or from a table of pages (``responses``). Files are read and written
record by record within tasks, through the file system that the path names; each record is a gzip member of its own. The
table of written files names only those of attempts that ended well. No step shuffles.

Text conversion is one pass over the markup: comments, scripts, styles and the like go, block elements break lines, other
tags go, references are resolved, white space within a line becomes one space, and blank lines go. What is not closed
ends with the document. Every pattern takes time in proportion to the page, whatever it holds.

Defined results: a null URL leaves the target URI out, a null or empty page has an empty payload and text; repeated rows
are derived each, with equal ids; records other than responses give no derivatives; the input's other columns are not
read; a very long page is held whole by the task that converts it; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

RECORD = "record_type string, record_id string, refers_to string, target_uri string, fields array<struct<name:string,value:string>>, block binary"
_FIELD = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_KINDS = [pa.string()] * 4 + [_FIELD, pa.binary()]
_NAMES = ["record_type", "record_id", "refers_to", "target_uri", "fields", "block"]

#: Elements whose content is no text, and elements that stand on lines of their own.
HIDDEN = "script|style|noscript|template|title|iframe|svg"
BLOCKS = frozenset(
    "address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({HIDDEN})(?=[\s/>])[^>]*+(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|</?([a-zA-Z][^\s/<>]*+)(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[!?][^<>]*+>",
    re.S | re.I,
)
#: Of these tags attributes are read up to the next bracket, so that a page is read in time that its length bounds.
_TITLE = re.compile(r"<title(?=[\s>])[^<>]*+>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_LINK = re.compile(r"<a\s[^<>]*?(?<![\w-])href\s*=", re.I)
_ROOT = re.compile(r"<html(?=\s)([^<>]*+)", re.I)
_LANG = re.compile(r"(?<![\w:-])lang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
#: Leading zeros of character references, and references beyond all characters.
_ZEROS, _BEYOND = re.compile(r"(?<=&#)0{9,}|(?<=&#[xX])0{9,}"), re.compile(r"&#(?:0*+[1-9][0-9]{8,}|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{8,});?")


def unescaped(text: str) -> str:
    if "&#" in text:
        text = _BEYOND.sub("\ufffd", _ZEROS.sub("0", text))
    return html.unescape(text)


def language(markup: str) -> str | None:
    found = (_LANG.search(m[1]) for m in _ROOT.finditer(markup))
    return next((m[1].lower() for m in found if m), None)


def plain_text(markup: str) -> str:
    out, last = [], 0
    for m in _MARKUP.finditer(markup):
        out.append(markup[last : m.start()])
        if m[2] and m[2].lower() in BLOCKS or m[1]:
            out.append("\n")
        last = m.end()
    out.append(markup[last:])
    lines = "".join(out).split("\n")
    if "&" in markup:
        lines = map(unescaped, lines)
    return "\n".join(filter(None, [" ".join(x.split()) for x in lines]))


def record_id(kind: str, *parts: str | None) -> str:
    seed = hashlib.sha256("\n".join([kind, *(p or "" for p in parts)]).encode("utf-8", "surrogatepass")).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=seed[:16], version=5)}>"


def digest(block: bytes) -> str:
    return "sha256:" + hashlib.sha256(block).hexdigest()


def _record(kind: str, rid: str, refers_to: str | None, uri: str | None, fields: list[tuple[str, str]], block: bytes) -> tuple:
    named = [{"name": n, "value": v} for n, v in [*fields, ("WARC-Block-Digest", digest(block))] if v is not None]
    return kind, rid, refers_to, uri, named, block


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], _NAMES)


def _in_batches(rows: Iterator[tuple], most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[5])
        if n > most:
            yield _batch(held)
            held, n = [], 0
    if held:
        yield _batch(held)


def _rows(batch: pa.RecordBatch, at_once: int = 100) -> Iterator[tuple]:
    for k in range(0, len(batch), at_once):
        part = batch.slice(k, at_once)
        yield from zip(*(part.column(c).to_pylist() for c in _NAMES), strict=True)


def _clean(value: str) -> str:
    """A field's value on one line."""
    return " ".join(value.split())


def _responses(batch: pa.RecordBatch, date: str) -> Iterator[tuple]:
    """A response record of each page in a batch."""
    for k in range(0, len(batch), 100):
        part = batch.slice(k, 100)
        for page_id, url, page in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            payload = (page or "").encode("utf-8", "surrogatepass")
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            fields = [
                ("WARC-Date", date),
                ("Content-Type", "application/http; msgtype=response"),
                ("WARC-Payload-Digest", digest(payload)),
                ("X-Page-Id", None if page_id is None else str(page_id)),
            ]
            rid = record_id("response", str(page_id), url, fields[2][1])
            yield _record("response", rid, None, None if url is None else _clean(url), fields, head.encode() + payload)


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of ``pages`` (page_id, url, html), as they would stand in a crawl's files."""

    def rows(batches):
        for batch in batches:
            yield from _in_batches(_responses(batch, date))

    return pages.select("page_id", "url", "html").mapInArrow(rows, RECORD)


def _derived(row: tuple) -> Iterator[tuple]:
    _, source_id, _, uri, named, whole = row
    fields = {f["name"].lower(): f["value"] for f in named}
    head, _, payload = whole.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    http = [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in lines) if n.strip()]
    by_name = {n.lower(): v for n, v in http}
    charset = re.search(r"charset=([\w.-]+)", by_name.get("content-type", ""), re.I)
    try:
        markup = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        markup = payload.decode("utf-8", "replace")
    title = _TITLE.search(markup)
    known = [
        ("status", _clean(status)),
        *((f"http-{n.lower()}", _clean(v)) for n, v in http),
        ("title", _clean(unescaped(title[1])) if title else None),
        ("language", language(markup)),
        ("links", str(len(_LINK.findall(markup)))),
        ("payload-bytes", str(len(payload))),
    ]
    about = "".join(f"{n}: {v}\r\n" for n, v in known if v is not None).encode("utf-8", "surrogatepass")
    text = plain_text(markup).encode("utf-8", "surrogatepass")
    source = fields.get("warc-payload-digest") or digest(payload)
    carried = [
        ("WARC-Date", fields.get("warc-date")),
        ("WARC-Refers-To-Target-URI", uri),
        ("WARC-Refers-To-Date", fields.get("warc-date")),
        ("WARC-Source-Payload-Digest", source),
        ("WARC-Source-Content-Type", by_name.get("content-type")),
        ("WARC-Source-Last-Modified", by_name.get("last-modified")),
        ("X-Page-Id", fields.get("x-page-id")),
    ]
    for kind, content_type, block in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", text)):
        yield _record(kind, record_id(kind, source_id, source), source_id, uri, [*carried, ("Content-Type", content_type)], block)


def derivatives(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of all responses among ``records``."""

    def rows(batches):
        for batch in batches:
            yield from _in_batches(r for row in _rows(batch) for r in _derived(row))

    return records.where(F.col("record_type") == "response").mapInArrow(rows, RECORD)


def to_bytes(row: tuple) -> bytes:
    """A record as it stands in a file."""
    kind, rid, refers_to, uri, fields, block = row
    named = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Refers-To", refers_to), ("WARC-Target-URI", uri)]
    named += [(f["name"], f["value"]) for f in fields] + [("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in named if v is not None) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(stream) -> Iterator[tuple]:
    """The records of an open file, one at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        named = []
        while (line := stream.readline().rstrip(b"\r\n")):
            if line[:1] in b" \t" and named:
                named[-1][1] += " " + line.strip().decode("utf-8", "surrogatepass")
            else:
                n, _, v = line.decode("utf-8", "surrogatepass").partition(":")
                named.append([n.strip(), v.strip()])
        own = {n.lower(): v for n, v in named}
        block = stream.read(int(own["content-length"]))
        if len(block) < int(own["content-length"]):
            raise ValueError("WARC record is incomplete")
        apart = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "content-length")
        fields = [{"name": n, "value": v} for n, v in named if n.lower() not in apart]
        yield own.get("warc-type"), own.get("warc-record-id"), own.get("warc-refers-to"), own.get("warc-target-uri"), fields, block


def _to_files(rows: Iterator[tuple], path: str, file_bytes: int, level: int) -> Iterator[pa.RecordBatch]:
    """Write records to files of a task's own under ``path``; yields (path, n_records) of each file."""
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    task, out, name, n, size, files = TaskContext.get(), None, None, 0, 0, 0
    done = lambda: pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["path", "n_records"])
    for row in rows:
        if out is None:
            name = f"{root}/part-{task.partitionId():06d}-{files:04d}-{uuid.uuid4().hex}.warc.gz"
            out, n, size, files = store.open_output_stream(name, compression=None), 0, 0, files + 1
        member = gzip.compress(to_bytes(row), level, mtime=0)
        out.write(member)
        n, size = n + 1, size + len(member)
        if size >= file_bytes:
            out.close()
            yield done()
            out = None
    if out is not None:
        out.close()
        yield done()


FILES = "path string, n_records long"


def write_records(records: DataFrame, path: str, file_bytes: int = 64_000_000, level: int = 1) -> DataFrame:
    """Write ``records`` under ``path``; returns the table of files (path, n_records)."""
    rows = lambda batches: _to_files((r for b in batches for r in _rows(b)), path, file_bytes, level)
    return written(records.mapInArrow(rows, FILES), "warc-files")


def write_derivatives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 64_000_000, level: int = 1) -> DataFrame:
    """Write the derivatives of the responses of ``pages`` (page_id, url, html) under ``path``, as ``write_records`` of
    ``derivatives`` of ``responses`` does, but a record goes from page to file within one task's worker."""
    derived = lambda batches: (r for b in batches for response in _responses(b, date) for r in _derived(response))
    rows = lambda batches: _to_files(derived(batches), path, file_bytes, level)
    return written(pages.select("page_id", "url", "html").mapInArrow(rows, FILES), "warc-files")


def verified(row: tuple) -> tuple:
    """A record whose block has the digest that it names: SHA-256 or SHA-1, in hexadecimal or base 32; others pass."""
    named = next((f["value"] for f in row[4] if f["name"].lower() == "warc-block-digest"), "")
    kind, _, value = named.partition(":")
    if kind.lower() in ("sha256", "sha1"):
        made = hashlib.new(kind.lower(), row[5]).digest()
        if value.lower() != made.hex() and value.upper().rstrip("=") != base64.b32encode(made).decode().rstrip("="):
            raise ValueError(f"block of {row[1]} does not have its digest")
    return row


def read_records(files: DataFrame, path: str, verify: bool = True) -> DataFrame:
    """The records of ``files`` (path), which lie on the file system that ``path`` names; gzipped if named ``.gz``. Each
    file is a task's; a block that does not have the digest its record names ends the job, unless ``verify`` is off."""

    def rows(batches):
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with store.open_input_stream(name, compression=None) as raw:
                    stream = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw
                    yield from _in_batches(map(verified, parse(stream)) if verify else parse(stream))

    return files.select("path").repartition(min(max(files.count(), 1), 100_000)).mapInArrow(rows, RECORD)


def field(name: str):
    """The value of a named field of a record."""
    return F.get(F.filter("fields", lambda x: F.lower(x["name"]) == name.lower()), F.lit(0))["value"]
