"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Every response yields one ``metadata`` record (source status and headers, digests, title, out-links)
and one ``conversion`` record (its text), both naming the response in WARC-Refers-To and keeping its
target URI, date and payload digest.  Records are serialised as WARC/1.1 and read back whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, small_batches

DATE = "1970-01-01T00:00:00Z"
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|title|blockquote|pre)\b[^>]*>", re.I)
TAG = re.compile(r"<[^>]*>")
LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.I | re.S)


@dataclass
class Record:
    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        """The first header of that name, whatever its case."""
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def to_bytes(self) -> bytes:
        lines = "".join(f"{k}: {v}\r\n" for k, v in self.headers)
        return f"WARC/1.1\r\n{lines}\r\n".encode() + self.block + b"\r\n\r\n"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """The same parts always name the same record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def response(page_id, url: str | None, body: str | None, date: str = DATE) -> Record:
    """A response record of a page; a page without a URL has no target, one without HTML no payload."""
    payload = (body or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    target = [("WARC-Target-URI", clean_uri(url))] if url else []
    return Record(
        [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url)), ("WARC-Date", date), *target]
        + [("WARC-Payload-Digest", sha1(payload)), ("WARC-Block-Digest", sha1(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))],
        block,
    )


def clean_uri(uri: str) -> str:
    """A URI on one line: control characters and spaces are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def unpacked(source: BinaryIO) -> BinaryIO:
    """A stream of the records' bytes, whether the file is gzipped or plain; nothing is read ahead whole."""
    buffered = io.BufferedReader(source)
    return gzip.GzipFile(fileobj=buffered) if buffered.peek(2)[:2] == b"\x1f\x8b" else buffered


def scan_records(source: BinaryIO) -> Iterator[Record | str]:
    """Records of a WARC stream, one at a time, and a message in place of each stretch that is none.

    After a broken header reading goes on at the next line that starts a record.  A stream that ends
    within a record, or whose compression breaks, ends with a message.
    """
    broken = ""
    try:
        stream = unpacked(source)
        while line := stream.readline():
            if line.strip() == b"":
                continue
            if not line.startswith(b"WARC/"):
                broken = broken or f"no WARC record: {line[:40]!r}"
                continue
            if broken:
                yield broken
                broken = ""
            lines = []
            while (line := stream.readline()).strip():
                lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
            if not line:
                yield "record cut short in its headers"
                return
            headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
            size = next((v for k, v in headers if k.lower() == "content-length"), "0")
            if not (size.isascii() and size.isdigit()):
                broken = f"no Content-Length: {size[:40]!r}"
                continue
            block = stream.read(int(size))
            if len(block) < int(size):
                yield f"record cut short: {len(block)} of {size} bytes"
                return
            yield Record(headers, block)
    except (OSError, EOFError, zlib.error) as e:
        broken = f"{type(e).__name__}: {e}"[:200]
    if broken:
        yield broken


def read_records(data: bytes) -> Iterator[Record]:
    """Records of a WARC file, plain or gzipped; raises ValueError where a record is broken."""
    for r in scan_records(io.BytesIO(data)):
        if isinstance(r, str):
            raise ValueError(r)
        yield r


def body_of(lines: list[str], payload: bytes) -> tuple[bytes, list[str]]:
    """The payload without transfer and content encodings, and what could not be taken off."""
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(":") for x in lines)}
    trouble = []
    if fields.get("transfer-encoding", "").endswith("chunked"):
        out, rest = [], payload
        while rest:
            size, _, tail = rest.partition(b"\r\n")
            size = size.split(b";")[0].strip()
            n = int(size, 16) if re.fullmatch(rb"[0-9a-fA-F]+", size) else -1
            if n < 0 or len(tail) < n:
                trouble.append("transfer-encoding: chunked")
                break
            if n == 0:
                break
            out.append(tail[:n])
            rest = tail[n:].removeprefix(b"\r\n")
        payload = payload if trouble else b"".join(out)
    for name in reversed([x.strip() for x in fields.get("content-encoding", "").split(",") if x.strip() not in ("", "identity")]):
        try:
            if name in ("gzip", "x-gzip"):
                payload = gzip.decompress(payload)
            elif name == "deflate":
                payload = zlib.decompress(payload, 15 if payload[:1] == b"\x78" else -15)
            else:
                raise ValueError(name)
        except (OSError, EOFError, ValueError, zlib.error):
            trouble.append(f"content-encoding: {name}")
            break
    return payload, trouble


def write_records(records: list[Record], compress: bool = True) -> bytes:
    """A WARC file, each record a gzip member of its own."""
    out = io.BytesIO()
    for r in records:
        out.write(gzip.compress(r.to_bytes(), mtime=0) if compress else r.to_bytes())
    return out.getvalue()


def plain_text(page: str) -> str:
    """Visible text: hidden elements and comments dropped, block tags as line breaks, entities decoded."""
    text = TAG.sub("", BREAK.sub("\n", HIDDEN.sub(" ", page)))
    lines = (" ".join(x.split()) for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def derive(source: Record) -> list[Record]:
    """The metadata and conversion records of a response; other records have none."""
    if (source.get("WARC-Type") or "").lower() != "response":
        return []
    head, cut, payload = source.block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    body, trouble = body_of(lines[1:], payload)
    kind = next((x.partition(":")[2].strip() for x in lines[1:] if x.lower().startswith("content-type:")), "")
    charset = re.search(r"charset=[\"']?([\w-]+)", kind)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    if trouble:  # what stays encoded is no text
        page = ""
    title = TITLE.search(page)
    links = list(dict.fromkeys(clean_uri(html.unescape(a or b or c).strip()) for a, b, c in LINK.findall(HIDDEN.sub(" ", page))))
    fields = [("http-status", lines[0])] + [("http-header", x) for x in lines[1:] if x]
    fields += [("source-block-digest", source.get("WARC-Block-Digest") or sha1(source.block)), ("source-payload-digest", source.get("WARC-Payload-Digest") or sha1(payload))]
    fields += [("not-decoded", x) for x in trouble]
    fields += [("title", " ".join(html.unescape(title[1]).split()))] if title else []
    fields += [("outlink", f"{x} L a/@href") for x in links if x]
    metadata = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    own = source.get("WARC-Record-ID") or record_id("response", sha1(source.block))
    kept = [(k, v) for k in ("WARC-Target-URI", "WARC-Date") if (v := source.get(k))]

    def linked(kind: str, mime: str, block: bytes, more: list[tuple[str, str]]) -> Record:
        ids = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, own)), ("WARC-Refers-To", own)]
        return Record(ids + kept + more + [("WARC-Block-Digest", sha1(block)), ("Content-Type", mime), ("Content-Length", str(len(block)))], block)

    digest = source.get("WARC-Payload-Digest") or sha1(payload)
    return [
        linked("metadata", "application/warc-fields", metadata, [("WARC-Source-Payload-Digest", digest)]),
        linked("conversion", "text/plain; charset=utf-8", plain_text(page).encode(), [("WARC-Source-Payload-Digest", digest)]),
    ]


SCHEMA = "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, block_digest string, source_payload_digest string, block binary, record binary"


def _row(r: Record) -> tuple:
    names = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Block-Digest", "WARC-Source-Payload-Digest")
    return (*map(r.get, names), r.block, r.to_bytes())


def _batch(first: list, key: str, kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string()] * 7 + [pa.binary()] * 2
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return pa.record_batch([pa.array(first, kind), *columns], [key, *(x.split()[0] for x in SCHEMA.split(", "))])


def page_derivatives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Two rows (metadata, conversion) for each row of ``pages`` (page_id, url, html), by SCHEMA.

    Null HTML gives an empty conversion, a null URL records without a target; repeated rows give
    repeated records of the same ids.  Other columns are ignored.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [(i, _row(d)) for i, u, h in zip(*(c.to_pylist() for c in batch.columns)) for d in derive(response(i, u, h, date))]
        return _batch([m[0] for m in made], "page_id", batch.column(0).type, [m[1] for m in made])

    return arrow_map(pages.select("page_id", "url", "html"), run, f"page_id {kind}, {SCHEMA}")


def file_derivatives(files: DataFrame, part: int = 256) -> DataFrame:
    """The same for WARC files, with a last column ``error``; ``files`` has a row for each file.

    With a column ``content`` (as from Spark's ``binaryFile`` source) a file's bytes are taken from
    there; otherwise it is opened by its ``path`` and streamed, record by record, so files may be of
    any size.  Records that are no responses give nothing.  A broken stretch gives one row with its
    path and ``error`` alone, and reading goes on behind it where it can; an empty file or a null
    content gives no rows.
    """
    packed = "content" in files.columns

    def opened(path: str, content: bytes | None) -> BinaryIO:
        if packed:
            return io.BytesIO(content or b"")
        store, name = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
        return store.open_input_stream(name, compression=None)

    def derived(path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            for r in scan_records(opened(path, content)):
                if isinstance(r, str):
                    yield (None,) * 9, r
                else:
                    for d in derive(r):
                        yield _row(d), None
        except OSError as e:
            yield (None,) * 9, f"{type(e).__name__}: {e}"[:200]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(1).to_pylist() if packed else [None] * batch.num_rows
            for path, content in zip(batch.column(0).to_pylist(), contents):
                found = derived(path, content)
                while made := list(islice(found, part)):
                    out = _batch([path] * len(made), "path", pa.string(), [m[0] for m in made])
                    yield pa.record_batch([*out.columns, pa.array([m[1] for m in made], pa.string())], [*out.schema.names, "error"])

    return files.select("path", *(["content"] if packed else [])).mapInArrow(run, f"path string, {SCHEMA}, error string")


def op4_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = page_derivatives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "block_digest", "source_payload_digest",
        F.octet_length("block").cast("long").alias("content_length"), F.sha2("record", 256).alias("record_sha256"),
    )
