"""Readers and parsers: encodings, delimited text, mail, Markdown blocks and file kinds."""

from __future__ import annotations

import csv
import email
import email.policy
import html
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = 500
# First bytes of files and their media types.
MAGIC = (
    (b"%PDF", "application/pdf"), (b"\x89PNG", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"PK\x03\x04", "application/zip"),
    (b"\xd0\xcf\x11\xe0", "application/x-ole-storage"), (b"\x1f\x8b", "application/gzip"), (b"II*\x00", "image/tiff"), (b"MM\x00*", "image/tiff"),
)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content, sha) of files under ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content", F.sha2("content", 256).alias("sha"))


def sniff(content: Column) -> Column:
    """Media type by the first bytes; null where none is known."""
    out = F.lit(None).cast("string")
    for mark, kind in reversed(MAGIC):
        out = F.when(F.substring(content, 1, len(mark)) == F.lit(bytearray(mark)), kind).otherwise(out)
    return out


def new_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (path, sha) a manifest does not list yet."""
    return found.join(manifest.select("path", "sha"), ["path", "sha"], "left_anti")


def decode_bytes(data: bytes) -> str:
    """Text of unknown encoding: BOM and UTF-8 first, then Windows-1252, then Latin-1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    for name in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def cells(text: str) -> list[list[str]]:
    """Rows of a delimited text: delimiter sniffed among , ; tab |, white space collapsed, blank rows dropped."""
    head = text[:4096]
    delimiter = max(",;\t|", key=lambda d: (min([line.count(d) for line in head.splitlines()[:5] if line.strip()] or [0]), -",;\t|".index(d)))
    rows = ([" ".join(c.split())[:CELL] for c in row] for row in csv.reader(io.StringIO(text), delimiter=delimiter))
    return [r for r in rows if any(r)]


def markdown_table(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(c.replace("|", "\\|") for c in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([*lines[:1], "|" + " --- |" * width, *lines[1:]]) if lines else ""


def reduce_html(page: str) -> str:
    page = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ", page)
    return " ".join(html.unescape(re.sub(r"(?s)<[^>]+>", " ", page)).split())


def mail_text(data: bytes) -> str:
    """Headers, then the first plain part, else the HTML part reduced."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    heads = [f"{h}: {message[h]}" for h in ("From", "To", "Cc", "Subject", "Date") if message[h]]
    body = message.get_body(("plain",)) or message.get_body(("html",))
    text = body.get_content() if body else ""
    return "\n".join([*heads, "", reduce_html(text) if body and body.get_content_subtype() == "html" else text]).strip()


def markdown_blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) of a page's blocks: heading, table, list, key_value, paragraph."""
    out: list[tuple[str, str]] = []
    lines = page.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i].strip()
        if not line:
            i += 1
            continue
        j = i + 1
        if re.match(r"#{1,6}\s", line):
            kind = "heading"
        elif line.startswith("|") and j < len(lines) and re.fullmatch(r"\s*\|?[\s:|-]+\|?\s*", lines[j]) and "-" in lines[j]:
            kind = "table"
            while j < len(lines) and lines[j].strip().startswith("|"):
                j += 1
        elif re.match(r"([-*+]|\d+[.)])\s", line):
            kind = "list"
            while j < len(lines) and re.match(r"\s*([-*+]|\d+[.)])\s", lines[j]):
                j += 1
        elif (m := re.match(r"([^:]{1,40}):\s+\S", line)) and len(m[1].split()) <= 6:
            kind = "key_value"
        else:
            kind = "paragraph"
            while j < len(lines) and lines[j].strip() and not re.match(r"\s*(#{1,6}\s|\||[-*+]\s)", lines[j]):
                j += 1
        out.append((kind, "\n".join(x.strip() for x in lines[i:j])))
        i = j
    return out


def parse(found: DataFrame) -> DataFrame:
    """(path, page, text) of ``files``: csv, tsv, eml, html and text by extension; others give no page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                ext = path.rsplit(".", 1)[-1].lower()
                if ext in ("csv", "tsv"):
                    out.append((path, 1, markdown_table(cells(decode_bytes(content)))))
                elif ext == "eml":
                    out.append((path, 1, mail_text(content)))
                elif ext in ("html", "htm"):
                    out.append((path, 1, reduce_html(decode_bytes(content))))
                elif ext in ("txt", "md", "log"):
                    out.append((path, 1, decode_bytes(content).strip()))
            yield pd.DataFrame(out, columns=["path", "page", "text"])

    return found.select("path", "content").mapInPandas(run, "path string, page int, text string")


def blocks(pages: DataFrame, key: str, column: str) -> DataFrame:
    """(key, idx, kind, text) of Markdown pages."""
    kinds = dict(pages.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, i, kind, text) for k, page in zip(pdf[key], pdf[column]) for i, (kind, text) in enumerate(markdown_blocks(page or ""))]
            yield pd.DataFrame(rows, columns=[key, "idx", "kind", "text"])

    return pages.select(key, column).mapInPandas(run, f"{key} {kinds[key]}, idx int, kind string, text string")


def segments(pages: DataFrame, key: str, page: str, starts: Column) -> DataFrame:
    """(key, first, last, pages): runs of pages, a new one where ``starts`` holds."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(page)
    run = pages.withColumn("_run", F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key, "_run").agg(F.min(page).alias("first"), F.max(page).alias("last"), F.count("*").alias("pages")).drop("_run")
