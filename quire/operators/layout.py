"""Word boxes of pages: rows, two-column pages and their reading order, and where a value stands."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows are words within so many points of each other; a gutter is sought in the middle of the page, by percent; a row
# this wide across it stands alone; words that head the columns of a table.
ROW_GAP, GUTTER_FROM, GUTTER_TO, FULL = 5.0, 30, 70, 0.62
TABLE_HEADS = ("result", "results", "unit", "units", "ref", "reference", "range", "test", "value")
TABLE, BLANKS = frozenset(TABLE_HEADS), "[ \t\n\x0b\f\r]+"
# Types of columns as Arrow names them.
ARROW = {"int": "int32", "long": "int64", "double": "double", "string": "string"}


def normal(text: Column) -> Column:
    """Letters, digits and underscores alone, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", "")


def tokens(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands in there."""
    return F.transform(F.array(value), use)[0]


def running(numbers: Column, block: int = 16) -> Column:
    """Sums of an array of integers up to each of its places, block by block, so that long arrays are not copied at each place."""
    add = lambda s, x: F.concat(s, F.array(F.coalesce(F.get(s, F.size(s) - 1), F.lit(0).cast("long")) + x))
    sums = lambda a: F.aggregate(a, F.array().cast("array<bigint>"), add)
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda i: sums(F.slice(a, i * block + 1, F.lit(block))))
    moved = lambda parts, ends: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: x + F.get(ends, i - 1)))))
    joined = lambda parts: let(sums(F.transform(parts, lambda p: F.element_at(p, -1))), lambda ends: moved(parts, ends))
    return let(numbers, lambda a: F.when(F.size(a) > 0, let(cut(a), joined)).otherwise(F.array().cast("array<bigint>")))


def located(words: DataFrame, values: DataFrame) -> DataFrame:
    """(page, field, first, last, x0, y0, x1, y1): where each value of a page stands, those found nowhere left out.

    ``words`` has page, n (the word's place on the page, from 0), text and its box, ``values`` page, field and value.  They meet
    by page, each moved once; ``located_in`` says which place wins.
    """
    w = words.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text", "x0", "y0", "x1", "y1"))), lambda x: x.dropFields("n")).alias("words"))
    v = values.groupBy("page").agg(F.collect_list(F.struct("field", "value")).alias("values"))
    return located_in(w.join(v, "page"))


def located_in(pages: DataFrame) -> DataFrame:
    """As ``located``, of pages with their words in order (text and box) and values (field and value) as arrays: nothing is shuffled.

    The first word that spells the whole value, three characters or more, wins; else the first run of words that spells its
    tokens one by one; else, of three tokens and more, the first run that misses one; else the first place of
    its first two tokens.  A run must begin with one of the first two tokens in its place, so only those starts are read further.
    """

    def found(f: Column, v: Column) -> Column:
        """(way, start, m) of the best place, the start from 0; null where there is none."""
        k, m, n = v["tokens"], F.size(v["tokens"]), F.size(f)
        spelled = F.array_position(f, v["joined"])
        near = F.array_compact(F.transform(f, lambda t, i: F.when((t == F.get(k, F.lit(0))) | (F.get(f, i + 1) == F.get(k, F.lit(1))), i)))
        hits = lambda s: F.size(F.filter(F.transform(k, lambda t, i: t == F.get(f, s + i)), lambda x: x))
        head = lambda s: (m >= 2) & (F.get(f, s) == F.get(k, F.lit(0))) & (F.get(f, s + 1) == F.get(k, F.lit(1)))
        way = lambda s, hit: F.when((s + m <= n) & (hit == m), 1).when((s + m <= n) & (m >= 3) & (hit == m - 1), 2).when(head(s), 3)
        place = lambda s: let(hits(s), lambda hit: let(way(s, hit), lambda w: F.when(w.isNotNull(), F.struct(w.alias("way"), s.alias("start"), F.when(w == 3, 2).otherwise(m).alias("m")))))
        return F.when((F.length(v["joined"]) >= 3) & (spelled > 0), F.struct(F.lit(0).alias("way"), (spelled - 1).cast("int").alias("start"), F.lit(1).alias("m"))).when(
            (m > 0) & (m <= n), F.array_min(F.array_compact(F.transform(near, place))))

    def box(x: Column, at: Column) -> Column:
        held = F.slice("words", at["start"] + 1, at["m"])
        side = lambda of, c: of(F.transform(held, lambda w: w[c])).alias(c)
        return F.struct(x["field"].alias("field"), at["start"].alias("first"), (at["start"] + at["m"] - 1).alias("last"), side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1"))

    said = F.filter("values", lambda x: F.trim(x["value"]) != "")
    asked = F.transform(said, lambda x: F.struct(x["field"].alias("field"), normal(x["value"]).alias("joined"), tokens(x["value"]).alias("tokens")))
    f = F.transform("words", lambda w: normal(w["text"]))
    boxes = let(f, lambda f: F.array_compact(F.transform(asked, lambda x: let(found(f, x), lambda at: F.when(at.isNotNull(), box(x, at))))))
    return pages.select("page", F.inline(boxes))


def _in_rows(words: DataFrame, gap: float) -> tuple[DataFrame, Column]:
    """Pages, and their ``page_rows`` as an expression: Spark would compute a column that is exploded twice, to see if it is empty."""
    pages = words if "words" in words.columns else words.groupBy("page").agg(F.collect_list(F.struct("x0", "x1", "y0", "y1", "text")).alias("words"))
    placed = F.sort_array(F.transform("words", lambda w: F.struct(((w["y0"] + w["y1"]) / 2).alias("cy"), w["x0"].alias("x0"), w["text"].alias("text"), w["x1"].alias("x1"))))

    def parted(down: Column) -> Column:
        starts = F.array_compact(F.transform(down, lambda w, i: F.when((i == 0) | (w["cy"] - F.get(down, i - 1)["cy"] > gap), i)))
        row = lambda at, to: F.sort_array(F.transform(F.slice(down, at + 1, to - at), lambda w: F.struct(w["x0"].alias("x0"), w["x1"].alias("x1"), w["text"].alias("text"))))
        return let(starts, lambda s: F.transform(s, lambda at, i: row(at, F.coalesce(F.get(s, i + 1), F.size(down)))))

    return pages, let(placed, parted)


def page_rows(words: DataFrame, gap: float = ROW_GAP) -> DataFrame:
    """(page, rows): the visual rows of each page from top to bottom, each an array of (x0, x1, text) from left to right.

    ``words`` is a table of words or of pages, with their words as an array; a row ends where the next word's
    middle stands more than ``gap`` below the one before.
    """
    pages, found = _in_rows(words, gap)
    return pages.select("page", found.alias("rows"))


def rows(words: DataFrame, gap: float = ROW_GAP) -> DataFrame:
    """(page, row, words): a row for each of the ``page_rows``, numbered from 0."""
    pages, found = _in_rows(words, gap)
    return pages.select("page", F.posexplode(found).alias("row", "words")).select("page", F.col("row").cast("long").alias("row"), "words")


def _places(width: float) -> np.ndarray:
    return width * np.arange(GUTTER_FROM, GUTTER_TO + 1) / 100.0


def _gutter(row: np.ndarray, n: int, x0: np.ndarray, x1: np.ndarray, width: float, lines_from: int = 8) -> tuple[float, int, int, int] | None:
    """(gutter, split, crossing, rows) of a page's words by row if it is cleanly set in two columns, else None.

    A gutter is the place that most rows are split by, words on both sides and none across it, and fewest cross; it
    counts if at least four rows and 35 % are split and the crossing ones are a quarter of those at most.
    """
    if n < lines_from:
        return None
    at = _places(width)
    k, wide = len(at), len(at) + 1
    # A row is crossed from the first place beyond a word's start to the one before its end, and split from its first end to its last start.
    marks = np.bincount(row * wide + np.searchsorted(at, x0, "right"), minlength=n * wide) - np.bincount(row * wide + np.maximum(np.searchsorted(at, x1, "left"), np.searchsorted(at, x0, "right")), minlength=n * wide)
    crossed = np.cumsum(marks.reshape(n, wide), axis=1)[:, :k] > 0
    ends, starts = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(ends, row, x1)
    np.maximum.at(starts, row, x0)
    parted = (ends[:, None] <= at) & (at <= starts[:, None]) & ~crossed
    split, crossing = parted.sum(axis=0), crossed.sum(axis=0)
    best = np.lexsort((np.arange(k), crossing, -split))[0]
    s, c = int(split[best]), int(crossing[best])
    return (float(at[best]), s, c, n) if s >= max(4, math.floor(0.35 * n)) and c <= 0.25 * max(1, s) else None


def _rowed(text: list[str | None], x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The order of a page's words by row, from left to right, the row of each in that order, and how many rows there are."""
    cy = (y0 + y1) / 2
    down = np.argsort(cy, kind="stable")
    row = np.empty(len(cy), np.int64)
    row[down] = np.cumsum(np.append(0, np.diff(cy[down]) > gap))
    order = np.lexsort((x1, x0, row))
    keys = np.stack([row[order], x0[order], x1[order]])
    same = np.flatnonzero((keys[:, 1:] == keys[:, :-1]).all(axis=0))
    # Words at one place go by their text.
    for run in np.split(same, np.flatnonzero(np.diff(same) > 1) + 1) if len(same) else ():
        span = slice(run[0], run[-1] + 2)
        order[span] = sorted(order[span], key=lambda i: (text[i] is not None, text[i] or ""))
    return order, row[order], int(row.max()) + 1


def _laid(pages: DataFrame, read: Callable[..., list[tuple]], kind: str, gap: float, boxes: Callable | None) -> DataFrame:
    """``read`` of each page's words by row, its rows behind the page; a page is laid out where it stands."""
    if "words" not in pages.columns:
        pages = pages.groupBy("page").agg(F.collect_list(F.struct("text", "x0", "y0", "x1", "y1")).alias("words"))
    held = pages.select("page", "words" if boxes else F.transform("words", lambda w: F.struct(w["text"].alias("text"), *(w[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))).alias("words"))
    names = [c.split()[0] for c in kind.split(", ")]

    def worded(words: pa.ListScalar) -> tuple:
        flat = words.values
        return flat.field("text").to_pylist(), *(flat.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            out, at = [], []
            for i, words in enumerate(batch.column(1)):
                if words.is_valid:
                    text, x0, y0, x1, y1 = boxes(words.as_py()) if boxes else worded(words)
                    if len(text):
                        order, row, n = _rowed(text, x0, y0, x1, y1, gap)
                        found = read([text[j] for j in order], x0[order], x1[order], row, n)
                        out += found
                        at += [i] * len(found)
            schema = schema or [pa.type_for_alias(ARROW[c.split()[1]]) for c in kind.split(", ")]
            columns = [pa.array(c, t) for c, t in zip([*zip(*out)] or [()] * len(names), schema)]
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["page", *names])

    return held.mapInArrow(run, f"page {held.schema['page'].dataType.simpleString()}, {kind}")


def gutters(lines: DataFrame, width: float, lines_from: int = 8, gap: float = ROW_GAP, boxes: Callable | None = None) -> DataFrame:
    """(page, gutter, split, crossing, rows) of the pages that are cleanly set in two columns; ``lines`` are ``rows`` or ``page_rows``, or with ``boxes`` pages as in ``columns``."""
    if not boxes:
        pages = lines if "rows" in lines.columns else lines.groupBy("page").agg(F.collect_list("words").alias("rows"))
        word = lambda w, y: F.struct(w["text"].alias("text"), w["x0"].alias("x0"), y.alias("y0"), w["x1"].alias("x1"), y.alias("y1"))
        lines = pages.select("page", F.flatten(F.transform("rows", lambda row, i: F.transform(row, lambda w: word(w, i * 2 * gap)))).alias("words"))

    def read(text, x0, x1, row, n):
        found = _gutter(row, n, x0, x1, width, lines_from)
        return [found] if found else []

    return _laid(lines, read, "gutter double, split long, crossing long, rows long", gap, boxes)


def heading(text: str) -> bool:
    """A short label in capitals, without digits."""
    lettered = any(sum(c.isalpha() for c in line) >= 2 for line in re.split("[\n\r\x85\u2028\u2029]", text))
    return len(re.split(BLANKS, text.strip(" "))) <= 6 and not re.search("[0-9]", text) and lettered and text.upper() == text


def columns(words: DataFrame, width: float, headings: int = 2, gap: float = ROW_GAP, boxes: Callable | None = None) -> DataFrame:
    """(page, pos, band, side, text): the rows of two-column pages in reading order.

    ``words`` is a table of words or of pages, with their words as an array; with ``boxes``, a page's ``words`` are whatever that
    makes its texts, x0, y0, x1 and y1 of.

    Rows that cross the gutter and fill FULL of the page part it in bands; in each the left column is read before the right, a
    word across the gutter going to the side of its middle.  Pages with fewer than ``headings`` headings in either
    column, with two rows of table heads on the right, or whose right side parts again, are tables or forms and left out.
    """

    def read(text, x0, x1, row, n):
        found = _gutter(row, n, x0, x1, width)
        if not found:
            return []
        g = found[0]
        across = (x0 < g) & (x1 > g)
        middle = (x0 + x1) / 2
        sides = [np.where(across, middle < g, x1 <= g), np.where(across, middle >= g, x0 >= g)]
        first = np.searchsorted(row, np.arange(n))
        last = np.maximum.reduceat(x1, first)
        full = np.logical_or.reduceat(across, first) & (last - x0[first] >= FULL * width)

        def said(mask: np.ndarray) -> list[str]:
            rows: list[list[str]] = [[] for _ in range(n)]
            for i in np.flatnonzero(mask).tolist():
                if text[i] is not None:
                    rows[row[i]].append(text[i])
            return [" ".join(r) for r in rows]

        right = sides[1] & (x0 >= g)
        if sum(1 for r in said(right) if not TABLE.isdisjoint(re.split(BLANKS, r.lower()))) >= 2:
            return []
        there, again = np.unique(row[right], return_inverse=True)
        if _gutter(again, len(there), x0[right], x1[right], width):
            return []
        if headings:
            for mask in (sides[0] & (x1 <= g), right):
                if sum(1 for i, r in enumerate(said(mask)) if not full[i] and heading(r)) < headings:
                    return []
        # A full row is a band of its own: it ends the one before and the next row starts another.
        band = np.cumsum(full.astype(int) + np.append(0, full[:-1])).tolist()
        whole = said(np.ones(len(row), bool))
        each = [(band[i], 0, i, whole[i]) for i in np.flatnonzero(full).tolist()]
        for side, mask in enumerate(sides, 1):
            each += [(band[i], side, i, t) for i, t in enumerate(said(mask)) if not full[i]]
        kept = sorted(x for x in each if x[3].strip(" "))
        return [(pos, b, side, t) for pos, (b, side, _, t) in enumerate(kept, 1)]

    return _laid(words, read, "pos int, band long, side int, text string", gap, boxes)
