"""Queries over word boxes, which are made of all documents' words by line and character."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from ..operators import layout as L
from ..session import small_batches, table
from .registry import query

#: What RE2 takes for \\S+; Java takes a vertical tab for white space as well.
WORD = r"[^\t\n\f\r ]+"
WORDS = re.compile(WORD).findall
BOXES = r"""l AS (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS y FROM documents),
w AS (SELECT page, y, i, a[i] AS text, list_sum(list_transform(a[1:i], lambda x: length(x) + 1)) - length(a[i]) - 1 AS x FROM (SELECT page, y, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT page, y, regexp_extract_all(line, '\S+') AS a FROM l))),
words AS (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY y, i) - 1 AS INTEGER) AS n, text, CAST(x * 5 AS DOUBLE) AS x0, CAST(y * 12 AS DOUBLE) AS y0, CAST((x + length(text)) * 5 AS DOUBLE) AS x1, CAST(y * 12 + 10 AS DOUBLE) AS y1, y FROM w)"""


def _documents(spark, sf):
    """(page, texts): each document where it stands; only documents of one id are brought together."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.array("text").alias("texts"))
    if docs.groupBy("page").count().filter("count > 1").isEmpty():
        return docs
    return docs.groupBy("page").agg(F.flatten(F.collect_list("texts")).alias("texts"))


def _pages(spark, sf):
    """(page, words): the words of all documents, each with text, x0, y0, x1, y1 and y: five points a character and twelve a line.

    A page is made where its document stands.
    """
    docs = _documents(spark, sf)
    box = lambda w, end, y: F.struct(w.alias("text"), ((end - F.length(w)) * 5.0).alias("x0"), (y * 12.0).alias("y0"), (end * 5.0).alias("x1"), (y * 12.0 + 10).alias("y1"), y.alias("y"))
    placed = lambda found, y: F.zip_with(found, L.running(F.transform(found, lambda w: F.length(w) + 1)), lambda w, end: box(w, end - 1, y))
    line = lambda c, y: L.let(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), lambda found: placed(found, y))
    words = F.flatten(F.transform(F.array_compact("texts"), lambda t: F.flatten(F.transform(F.split(t, "\n"), line))))
    return docs.filter("exists(texts, t -> t IS NOT NULL)").select("page", words.alias("words"))


@query("q_locate", rf"""
WITH {BOXES}, a AS (SELECT page, list(text ORDER BY n) AS t, list(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', '', 'g') ORDER BY n) AS f FROM words GROUP BY 1),
vals AS (SELECT page, f, unnest([{{'field': 'run', 'v': coalesce(t[6], '') || '-' || coalesce(t[7], '') || ' ' || coalesce(t[8], '')}}, {{'field': 'garbled', 'v': coalesce(t[3], '') || ' zzzz ' || coalesce(t[5], '')}},
 {{'field': 'head', 'v': coalesce(t[2], '') || ' ' || coalesce(t[3], '') || ' qqqq rrrr ssss'}}, {{'field': 'last', 'v': coalesce(t[-1], '')}}, {{'field': 'none', 'v': 'never there'}}]) AS x FROM a),
v AS (SELECT page, f, x.field AS field, regexp_replace(lower(x.v), '[^\p{{L}}\p{{N}}_]+', '', 'g') AS joined, regexp_extract_all(lower(x.v), '[\p{{L}}\p{{N}}_]+') AS k FROM vals WHERE trim(x.v, ' ') <> ''),
s AS (SELECT page, field, joined, k, f, unnest(range(len(f))) AS start FROM v),
r AS (SELECT page, field, start, len(k) AS m, CASE WHEN length(joined) >= 3 AND f[start + 1] = joined THEN 0 WHEN len(k) = 0 OR len(k) > len(f) THEN NULL
 WHEN start + len(k) <= len(f) AND f[start + 1:start + len(k)] = k THEN 1
 WHEN start + len(k) <= len(f) AND len(k) >= 3 AND list_sum(list_transform(range(1, len(k) + 1), lambda i: CAST(f[start + i] = k[i] AS INTEGER))) = len(k) - 1 THEN 2
 WHEN len(k) >= 2 AND f[start + 1] = k[1] AND f[start + 2] = k[2] THEN 3 END AS way FROM s),
b AS (SELECT page, field, start, CASE way WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE m END AS m FROM r WHERE way IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page, field ORDER BY way, start) = 1)
SELECT page, field, CAST(start AS INTEGER) AS first, CAST(start + m - 1 AS INTEGER) AS last, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
FROM b JOIN words USING (page) WHERE n BETWEEN start AND start + m - 1 GROUP BY 1, 2, 3, 4""")
def q_locate(spark, sf):
    """Five values of each document, cut from its own words: a run, one with a wrong word, one whose head alone is right, its last word, and one that is not there."""
    at = lambda i: F.coalesce(F.get("words", F.lit(i))["text"], F.lit(""))
    made = {"run": F.concat(at(5), F.lit("-"), at(6), F.lit(" "), at(7)), "garbled": F.concat(at(2), F.lit(" zzzz "), at(4)), "head": F.concat(at(1), F.lit(" "), at(2), F.lit(" qqqq rrrr ssss")), "last": F.get("words", F.size("words") - 1)["text"], "none": F.lit("never there")}
    values = F.array(*(F.struct(F.lit(k).alias("field"), c.alias("value")) for k, c in made.items()))
    return L.located_in(_pages(spark, sf).select("page", "words", values.alias("values")))


#: Documents as pages of two columns: lines turn by turn on the left and on the right, eight words of each at most in a row.
SIDES = rf"""{BOXES}, fold AS (SELECT page, text, y AS line, x1 - x0 AS wide, CAST(floor(x0 / 270) AS BIGINT) AS fold, x0 AS x FROM words),
two AS (SELECT page, text, x - fold * 270 + 310e0 * (line % 2) AS x0, x - fold * 270 + 310e0 * (line % 2) + wide AS x1, CAST(line // 2 * 60 + fold % 5 * 12 AS DOUBLE) AS y0 FROM fold),
marked AS (SELECT *, CASE WHEN y0 - lag(y0) OVER d > 5 THEN 1 ELSE 0 END AS new FROM two WINDOW d AS (PARTITION BY page ORDER BY y0, x0, text)),
rowed AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y0, x0, text ROWS UNBOUNDED PRECEDING) AS r FROM marked)"""


def _two_columns(spark, sf):
    def side(w):
        fold, y = F.floor(w["x0"] / 270), w["y"]
        x0 = w["x0"] - fold * 270 + 310.0 * (y % 2)
        y0 = F.floor(y / 2) * 60 + fold % 5 * 12.0
        return F.struct(w["text"].alias("text"), x0.alias("x0"), (x0 + w["x1"] - w["x0"]).alias("x1"), y0.alias("y0"), (y0 + 10).alias("y1"))

    return _pages(spark, sf).select("page", F.transform("words", side).alias("words"))


def _texts(spark, sf):
    """(page, words): the texts that ``_in_two`` makes a page's words of, handed to Python in small batches."""
    small_batches(spark)
    return _documents(spark, sf).select("page", F.col("texts").alias("words"))


def _in_two(texts):
    """What ``_two_columns`` makes of a document: texts, x0, y0, x1 and y1 of its words."""
    lines = [(y, WORDS(line)) for t in texts if t is not None for y, line in enumerate(t.split("\n"))]
    text = [w for _, found in lines for w in found]
    counts, long = np.array([len(found) for _, found in lines], int), np.fromiter(map(len, text), int, len(text))
    y, upto = np.repeat(np.array([y for y, _ in lines], int), counts), np.cumsum(long + 1)
    before = np.append(0, upto)[np.cumsum(counts) - counts]
    x = (upto - long - 1 - np.repeat(before, counts)) * 5.0
    fold = np.floor(x / 270)
    x0, y0 = x - fold * 270 + 310.0 * (y % 2), y // 2 * 60 + fold % 5 * 12.0
    return text, x0, y0, x0 + long * 5.0, y0 + 10


@query("pdf_rows", f"WITH {SIDES} SELECT page, CAST(r AS BIGINT) AS row, count(*) AS words, min(x0) AS x0, max(x1) AS x1 FROM rowed GROUP BY 1, 2")
def pdf_rows(spark, sf):
    found = L.rows(_two_columns(spark, sf))
    return found.select("page", "row", F.size("words").cast("long").alias("words"), F.col("words")[0]["x0"].alias("x0"), F.array_max(F.transform("words", lambda w: w["x1"])).alias("x1"))


@query("pdf_gutter", f"""WITH {SIDES}, k AS (SELECT unnest(range(30, 71)) AS k),
t AS (SELECT page, r, k, bool_or(x0 < 6.0 * k AND x1 > 6.0 * k) AS crossing, bool_or(x1 <= 6.0 * k) AND bool_or(x0 >= 6.0 * k) AS split FROM rowed, k GROUP BY 1, 2, 3),
s AS (SELECT page, k, count(*) FILTER (WHERE split AND NOT crossing) AS split, count(*) FILTER (WHERE crossing) AS crossing, count(*) AS rows FROM t GROUP BY 1, 2),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY page ORDER BY split DESC, crossing, k) = 1)
SELECT page, 6e0 * k AS gutter, split, crossing, rows FROM b WHERE rows >= 8 AND split >= greatest(4, floor(0.35 * rows)) AND crossing <= 0.25 * greatest(1, split)""")
def pdf_gutter(spark, sf):
    return L.gutters(_texts(spark, sf), 600.0, boxes=_in_two)


@query("src_pdf_columns")
def src_pdf_columns(spark, sf):
    """Reading order of the two-column pages; as the texts have no headings, none are asked for."""
    return L.columns(_texts(spark, sf), 600.0, headings=0, boxes=_in_two)
