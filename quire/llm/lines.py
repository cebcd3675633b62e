"""Line dedup by winnowing over line hashes, in DataFrame operations only.

Documents are sequences of lines; a run of consecutive lines holding ``min_words`` words or more is
removed where an equal run stands earlier (by doc_id, then position).

1. Winnow: every line starts a window, the least run of lines from it that holds ``min_words`` words,
   and ends one.  Each window selects its least line hash (the last of equals).  Equal windows select
   equal hashes, so repeated runs of ``min_words`` words always share a selected fingerprint.
2. Join: windows whose fingerprint is selected at one position only are dropped; the others join the
   positions of their fingerprint.  A line that stands in a third of all documents has too many
   positions to pair up, so each window meets the first equal one, a grouped minimum.
3. Extend: the windows that start and those that end at each line grow a match to the right and to the
   left, so the union of a document's repeated windows is exactly its repeated runs.
4. Delete the lines of those runs, keeping the first occurrence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, skew_join

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_hash", F.xxhash64("text"))


def windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per window: doc_id, row_hash, kind, at, first, last, print, print_at, k1, k2."""
    line = F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    lines = _keyed(docs).select("doc_id", "row_hash", F.posexplode(line).alias("pos", "line")).filter("line.w > 0")
    lines = lines.select("doc_id", "row_hash", "pos", "line.*").repartition("doc_id", "row_hash")
    lines = lines.groupBy("doc_id", "row_hash", "pos").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("w").cast("long").alias("w"))
    doc = Window.partitionBy("doc_id", "row_hash")
    lines = lines.withColumn("upto", F.sum("w").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("before", F.col("upto") - F.col("w"))
    right = doc.orderBy("before").rangeBetween(0, min_words - 1)
    left = doc.orderBy("upto").rangeBetween(1 - min_words, 0)

    def window(kind: int, frame):
        low = F.min(F.struct(F.col("a"), (-F.col("pos")).alias("p"))).over(frame)
        return F.struct(
            F.lit(kind).alias("kind"),
            F.min("pos").over(frame).alias("first"),
            F.max("pos").over(frame).alias("last"),
            F.sum("w").over(frame).alias("words"),
            low["a"].alias("print"),
            (-low["p"]).alias("print_at"),
            F.xxhash64(F.collect_list("a").over(frame)).alias("k1"),
            F.xxhash64(F.lit(1), F.collect_list("b").over(frame)).alias("k2"),
        )

    both = lines.select("doc_id", "row_hash", F.col("pos").alias("at"), window(0, right).alias("r"), window(1, left).alias("l"))
    return both.select("doc_id", "row_hash", "at", F.explode(F.array("r", "l")).alias("x")).select("doc_id", "row_hash", "at", "x.*").filter(F.col("words") >= min_words).drop("words")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row_hash, first, last): disjoint runs of line positions, from 0, that stand earlier elsewhere."""
    wins = materialize(windows(docs, min_words), "windows")
    total = wins.count()
    spot = F.struct("doc_id", "row_hash", "print_at")
    prints = wins.groupBy("print").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi"), F.count("*").alias("n"))
    prints = materialize(prints.filter("lo <> hi").select("print", "n"), "prints")
    met = materialize(skew_join(wins, prints, ["print"], "n", total).drop("n", "print", "print_at"), "met")
    here = F.struct("doc_id", "row_hash", "at")
    key = ["kind", "k1", "k2"]
    firsts = materialize(met.groupBy(*key).agg(F.min(here).alias("origin"), F.count("*").alias("n")).filter("n > 1"), "firsts")
    later = skew_join(met, firsts, key, "n", total).filter(here != F.col("origin")).select("doc_id", "row_hash", "first", "last").distinct()
    doc = Window.partitionBy("doc_id", "row_hash").orderBy("first", "last")
    reach = F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    run = later.withColumn("fresh", F.when(F.col("first") <= reach + 1, 0).otherwise(1))
    run = run.withColumn("run", F.sum("fresh").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("doc_id", "row_hash", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs removed from ``text``, and a last column of removed runs.

    The added column, ``removed_runs`` (array of first and last line), is null where nothing went; if
    ``docs`` has a column of that name, the new one takes its place.  Null texts stay null; a text that
    repeats as a whole becomes empty.  Rows repeated with the same doc_id and text count as one document
    and come out alike.  A null doc_id counts as the smallest.  Lines without words never start, end or
    break a run and go with a run around them.  Runs repeated within one document keep the first.
    """
    names = [c for c in docs.columns if c != "removed_runs"]
    runs = repeated_runs(docs, min_words).groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    # The row travels as one struct, so its columns may have any names.
    own = docs.select(F.struct(*names).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_hash"))
    joined = own.join(runs, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("row_hash")), "left").select("row", F.col("runs").alias("_runs"))
    # Kept stretches lie between runs: after run i (or the start) up to run i+1 (or the end).
    starts = F.concat(F.array(F.lit(0)), F.transform("_runs", lambda r: r["last"] + 1))

    def rest(lines):
        ends = F.concat(F.transform("_runs", lambda r: r["first"]), F.array(F.size(lines)))
        pieces = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: x["a"] < x["b"])
        return F.array_join(F.flatten(F.transform(pieces, lambda x: F.slice(lines, x["a"] + 1, x["b"] - x["a"]))), "\n")

    kept = F.transform(F.array(F.split(F.col("row")["text"], "\n")), rest)[0]  # the array around it splits a text once
    text = F.when(F.col("_runs").isNull(), F.col("row")["text"]).otherwise(kept).alias("text")
    return joined.select(*(text if c == "text" else F.col("row")[c].alias(c) for c in names), F.col("_runs").alias("removed_runs"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    gone = F.aggregate(F.coalesce("removed_runs", F.array().cast("array<struct<first:int,last:int>>")), F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    return out.select(
        "doc_id", gone.cast("long").alias("n_removed"), F.coalesce(F.size("removed_runs"), F.lit(0)).cast("long").alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("clean_sha256")
    )


ORACLE = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
counted AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM raw),
summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM counted WHERE w > 0),
lines AS (SELECT doc_id, line, pos, CAST(w AS BIGINT) AS w, CAST(upto AS BIGINT) AS upto, CAST(upto - w AS BIGINT) AS before FROM summed),
wins AS (
  SELECT 0 AS kind, doc_id, pos, min(pos) OVER f AS first, max(pos) OVER f AS last, sum(w) OVER f AS words, list(line) OVER f AS content FROM lines
  WINDOW f AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT 1, doc_id, pos, min(pos) OVER f, max(pos) OVER f, sum(w) OVER f, list(line) OVER f FROM lines
  WINDOW f AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
ranked AS (
  SELECT doc_id, first, last, row_number() OVER (PARTITION BY kind, content ORDER BY doc_id, pos) AS k FROM wins WHERE words >= 50),
gone AS (
  SELECT r.doc_id, r.pos, bool_or(k.doc_id IS NOT NULL) AS gone FROM raw r
  LEFT JOIN (SELECT DISTINCT doc_id, first, last FROM ranked WHERE k > 1) k ON r.doc_id = k.doc_id AND r.pos BETWEEN k.first AND k.last GROUP BY ALL),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM gone)
SELECT e.doc_id, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (WHERE starts) AS BIGINT) AS n_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY e.pos) FILTER (WHERE NOT gone), '')) AS clean_sha256
FROM edges e JOIN raw r ON e.doc_id = r.doc_id AND e.pos = r.pos GROUP BY e.doc_id
"""
