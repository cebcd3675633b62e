"""Joins of intervals and boxes that overlap, and what is mapped with them: edited text to blocks, chunks to lines."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitize
from ..session import small_batches
from .documents import nfkc, pack
from .search import Patterns

MARK = r"<!-- block:(b_\w+) -->"


def interval_overlaps(left: DataFrame, right: DataFrame, on: list[str], span: int = 1024) -> DataFrame:
    """Rows of ``left`` (with a0, a1) and ``right`` (with b0, b1) of equal ``on`` whose half-open intervals share a point.

    Intervals are dealt to buckets of ``span``, and a pair meets in the bucket of its first common point only,
    so no pair comes twice and no bucket is compared with another.  Empty intervals overlap nothing.
    """
    bucket = lambda c: F.floor(c / span)
    l = left.filter("a0 < a1").withColumn("_bucket", F.explode(F.sequence(bucket(F.col("a0")), bucket(F.col("a1") - 1))))  # noqa: E741
    r = right.filter("b0 < b1").withColumn("_bucket", F.explode(F.sequence(bucket(F.col("b0")), bucket(F.col("b1") - 1))))
    met = l.join(r, [*on, "_bucket"]).filter("a0 < b1 AND b0 < a1")
    return met.filter(bucket(F.greatest("a0", "b0")) == F.col("_bucket")).drop("_bucket")


def box_overlaps(left: DataFrame, right: DataFrame, on: list[str], width: float, height: float) -> DataFrame:
    """Rows of ``left`` (ax0, ay0, ax1, ay1) and ``right`` (bx0, by0, bx1, by1) of equal ``on`` whose closed boxes touch.

    Boxes are dealt to the cells of a grid; a pair counts in the cell of the least corner of its common part alone.
    Boxes with a null or turned-round side touch nothing.
    """
    cell = lambda c, size: F.floor(F.col(c) / size)

    def dealt(df: DataFrame, x: str) -> DataFrame:
        df = df.filter((F.col(f"{x}x0") <= F.col(f"{x}x1")) & (F.col(f"{x}y0") <= F.col(f"{x}y1")))
        df = df.withColumn("_cx", F.explode(F.sequence(cell(f"{x}x0", width), cell(f"{x}x1", width))))
        return df.withColumn("_cy", F.explode(F.sequence(cell(f"{x}y0", height), cell(f"{x}y1", height))))

    met = dealt(left, "a").join(dealt(right, "b"), [*on, "_cx", "_cy"]).filter("ax0 <= bx1 AND bx0 <= ax1 AND ay0 <= by1 AND by0 <= ay1")
    first = (F.floor(F.greatest("ax0", "bx0") / width) == F.col("_cx")) & (F.floor(F.greatest("ay0", "by0") / height) == F.col("_cy"))
    return met.filter(first).drop("_cx", "_cy")


def shared_area() -> Column:
    """Area of the common part of a pair that ``box_overlaps`` gives."""
    side = lambda k: F.least(f"a{k}1", f"b{k}1") - F.greatest(f"a{k}0", f"b{k}0")
    return side("x") * side("y")


def segments(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, j, block, text, b0, b1): the marked segments of edited Markdown, as they stand joined by blank lines.

    Text before the first mark, and behind no mark, has a null block; blank segments are left out.
    """
    types = dict(docs.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, text in zip(pdf[key], pdf[column]):
                parts = re.split(MARK, text or "")
                found = [(None, parts[0]), *zip(parts[1::2], parts[2::2])]
                at = 0
                for j, (block, part) in enumerate((b, t) for b, t in found if t.strip()):
                    clean = nfkc(part.strip()) or ""
                    rows.append((k, j, block, clean, at, at + len(clean)))
                    at += len(clean) + 2
            yield pd.DataFrame(rows, columns=[key, "j", "block", "text", "b0", "b1"])

    clean = docs.select(key, sanitize(F.col(column)).alias(column))
    return clean.mapInPandas(run, f"{key} {types[key]}, j int, block string, text string, b0 int, b1 int")


def packed(found: DataFrame, key: str, target: int = 1000, overlap: int = 150) -> DataFrame:
    """(key, idx, a0, a1, text): the joined segments of each document in packed chunks."""
    types = dict(found.dtypes)
    joined = found.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "text"))), lambda x: x["text"]), "\n\n").alias("page"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, idx, a, b, text) for k, page in zip(pdf[key], pdf["page"]) for idx, (text, a, b) in enumerate(pack(page, target, overlap))]
            yield pd.DataFrame(rows, columns=[key, "idx", "a0", "a1", "text"])

    return joined.mapInPandas(run, f"{key} {types[key]}, idx int, a0 int, a1 int, text string")


def blocks_of(spans: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, idx, blocks): of each span (a0, a1) the marked segments it overlaps, in order; empty where it overlaps none."""
    met = interval_overlaps(spans.select(key, "idx", "a0", "a1"), found.filter("block IS NOT NULL").select(key, "j", "block", "b0", "b1"), [key])
    lists = met.groupBy(key, "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "block"))), lambda x: x["block"]).alias("blocks"))
    return spans.join(lists, [key, "idx"], "left").withColumn("blocks", F.coalesce("blocks", F.array().cast("array<string>")))


def annotated_chunks(docs: DataFrame, key: str, column: str, target: int = 1000, overlap: int = 150) -> DataFrame:
    """(key, idx, a0, a1, text, blocks): edited Markdown in chunks again, each with the blocks it was made from."""
    found = segments(docs, key, column)
    return blocks_of(packed(found, key, target, overlap), found, key)


def lines_of_pages(pages: DataFrame, margin: float = 0.02, n: int = 4) -> DataFrame:
    """``lines_of_chunks`` of pages that hold their chunks and lines as arrays: (page, chunk, lines), nothing is shuffled.

    ``pages`` has page, chunks (chunk, kind, text, y0, y1) and lines (line, y0, h, text).  Lines are looked up in the chunks
    of their page by their rarest n-grams (``search.Patterns``), so a page is read once, not once a line.
    """
    small_batches(pages.sparkSession)
    of = lambda column, field: pages.schema[column].dataType.elementType[field].dataType.simpleString()
    # Empty texts hold no line; unboxed tables are as those whose box touches none.
    box = lambda c: (c["y0"] < c["y1"]) & (c["y0"] >= 0)
    chunk = lambda c: F.struct(
        c["chunk"].alias("chunk"), (c["kind"] == "table").alias("table"), F.when(c["kind"] != "table", F.lower(F.trim(c["text"]))).alias("text"),
        F.when(box(c), F.greatest(c["y0"] - margin, F.lit(0.0))).alias("y0"), F.when(box(c), F.least(c["y1"] + margin, F.lit(1.0))).alias("y1"))
    line = lambda x: F.struct(x["line"].alias("line"), x["y0"].alias("top"), (x["y0"] + x["h"]).alias("bottom"), F.lower(x["text"]).alias("held"))
    full = F.array_sort(F.transform(F.filter(F.coalesce("lines", F.array()), lambda x: F.length(x["text"]) > 0), lambda x: F.struct(x["y0"].alias("top"), line(x).alias("x"))))
    read = pages.select("page", F.transform("chunks", chunk).alias("chunks"), F.transform(full, lambda x: x["x"]).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, chunks, lists = [], [], []
            for k, (own, lines) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                number, held = [x["line"] for x in lines], [x["held"] for x in lines]
                top, bottom = (np.array([np.nan if x[c] is None else x[c] for x in lines], float) for c in ("top", "bottom"))
                places = defaultdict(list)
                for i, x in enumerate(held):
                    places[x].append(i)
                texts, values = [c["text"] or "" for c in own], [*places]
                inside = defaultdict(list)
                for t, p in Patterns(values, n).find(texts) if any(texts) else ():
                    inside[t] += places[values[p]]
                for t, c in enumerate(own):
                    met = sorted(inside[t])
                    if c["table"]:
                        met = [] if c["y0"] is None or c["y0"] > c["y1"] else np.flatnonzero((bottom >= c["y0"]) & (top <= c["y1"]) & (bottom >= top)).tolist()
                        met = met or range(len(lines))
                    at.append(k), chunks.append(c["chunk"]), lists.append([number[i] for i in met] or None)
            schema = batch.schema.field("chunks").type.value_type.field("chunk").type, batch.schema.field("lines").type.value_type.field("line").type
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(chunks, schema[0]), pa.array(lists, pa.list_(schema[1]))], ["page", "chunk", "lines"])

    return read.mapInArrow(run, f"page {pages.schema['page'].dataType.simpleString()}, chunk {of('chunks', 'chunk')}, lines array<{of('lines', 'line')}>")


def lines_of_chunks(chunks: DataFrame, lines: DataFrame, margin: float = 0.02, n: int = 4) -> DataFrame:
    """(page, chunk, lines): the lines of its page that each chunk covers, by place, null where there are none.

    ``chunks`` has page, chunk, kind, text, y0 and y1 (shares of the page's height, null without a box), ``lines``
    page, line, y0, h and text.  A table covers the lines its box touches, give or take ``margin``, or without box or
    touch all of its page; any other chunk the lines whose text it holds.  Lines without text cover nothing.  Chunks and
    lines of a page meet in one row.
    """
    whole = lambda df, name, *columns: df.groupBy("page").agg(F.collect_list(F.struct(*columns)).alias(name))
    pages = whole(chunks, "chunks", "chunk", "kind", "text", "y0", "y1").join(whole(lines, "lines", "line", "y0", "h", "text"), "page", "left")
    return lines_of_pages(pages, margin, n)
