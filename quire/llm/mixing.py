"""Mixing sources to target weights by systematic sampling.

Each source gets a target of words; every document of the source is then expected
``target / source_size`` times.  Walking the source's documents in a fixed order, the running sum of
expected copies plus one offset per source crosses integers, and a document is emitted once for each
integer it crosses.  Ordering by falling size class makes the words taken miss the target by less
than about one long document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, release, skew_join

WORD = r"[^\x20\x09-\x0D]+"
#: Equal rows ranked in one piece; longer runs of them are dealt out again.
RUN = 4096


def running(df: DataFrame, order: list, **sums: Column) -> DataFrame:
    """``df`` with, for each of ``sums``, its total over all rows before in ``order``.

    Rows are dealt out by range; each range adds up its own, and one row per range gives its start.
    """
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    per = dealt.groupBy("_range").agg(*(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_range", *(F.coalesce(F.sum(f"_{name}").over(ahead), F.lit(0)).alias(f"_{name}") for name in sums))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.withColumns({f"_own_{name}": F.coalesce(F.sum(c).over(own), F.lit(0)) for name, c in sums.items()}).join(F.broadcast(per), "_range")
    return joined.select(*df.columns, *((F.col(f"_own_{name}") + F.col(f"_{name}")).alias(name) for name in sums))


def targets(sources: DataFrame, share: float, weights: tuple[float, ...], cap: float) -> DataFrame:
    """``sources`` (key, source_size) with ``target``: words in proportion to ``weights``, given out in turn
    by key, that add up to ``share`` of all sizes, none above ``cap`` times its size.

    Sources fill up in order of cap over weight; the first one that the words left would not fill sets
    the level for it and all after it.  Sources may be of any number.
    """
    numbered = running(sources, ["key"], i=F.lit(1).cast("long"))
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("i"), F.lit(len(weights))).cast("int"))
    rated = numbered.withColumn("w", weight).withColumn("full", cap * F.col("source_size")).withColumn("r", F.col("full") / F.col("w"))
    filled = running(rated, ["r", "i"], given=F.col("full"), passed=F.col("w"))
    whole = filled.agg(F.sum("source_size").alias("n"), F.sum("w").alias("w")).first()
    level = (share * (whole.n or 0) - F.col("given")) / ((whole.w or 0.0) - F.col("passed"))
    first = filled.withColumn("level", level).filter("level <= r").agg(F.min(F.struct("r", "i", "level")).alias("x")).first().x
    height = F.lit(first.level if first else math.inf)
    return filled.select("key", "source_size", F.when(height > F.col("r"), F.col("full")).otherwise(F.least("full", height * F.col("w"))).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), cap: float = 2.0, seed: int = 7, carry: tuple[Column, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies.

    ``size`` is the number of words (null text: 0); sources, by code point and null last, weigh
    ``weights`` in turn; their targets add up to ``share`` of all words and none exceeds ``cap`` times
    its source.  ``copies`` is how often the mix takes the document, ``taken`` the words that makes.
    Documents stand in falling size class and there in the order of a hash of id and text, so reruns
    agree whatever the partitions; rows equal in both, null and repeated ids included, are counted and
    ranked as one run, and which of them is taken makes no difference.  Empty texts get copies but take
    no words.  An empty table gives no rows; a source of no words has target 0 and is not taken at
    all.  Other columns of ``docs`` are ignored, but ``carry`` (named columns) comes out too.
    """
    extra = [c for c in docs.select(*carry).columns] if carry else []
    digits = F.length(F.col("size").cast("string"))
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        F.col("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t")).alias("key"),  # null last
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(text.cast("binary"))).cast("binary")).alias("order"),
        *carry,
    ).withColumn("class", digits * 100 + F.expr("size div cast(pow(10, greatest(length(cast(size as string)) - 2, 0)) as bigint)").cast("int"))
    place = ["key", "class", "block"]
    runs = sized.withColumn("block", F.substring("order", 1, 2)).groupBy(*place, "order", "doc_id", "size", *extra).agg(F.count("*").alias("n"))
    runs = materialize(runs, "runs")

    # Rank within the source = rows of larger classes + rows of earlier blocks of the class + rows before
    # in the block.  Classes of a source and blocks of a class are few, and a block is 1/256 of a class.
    upto = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    blocks = runs.groupBy(*place).agg(F.sum("n").alias("n"))
    blocks = blocks.withColumn("in_class", F.coalesce(F.sum("n").over(upto(place[:2], "block")), none))
    classes = runs.groupBy("key", "class").agg(F.sum("n").alias("n"))
    classes = classes.select("key", "class", F.coalesce(F.sum("n").over(upto(["key"], F.desc("class"))), none).alias("in_source"))
    starts = blocks.join(classes, ["key", "class"]).select(*place, (F.col("in_class") + F.col("in_source")).alias("start"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*place).orderBy("order", "doc_id", *extra).rowsBetween(Window.unboundedPreceding, -1)), none)
    placed = runs.withColumn("before", before).join(starts, place)
    placed = materialize(placed.select("key", "order", "doc_id", *extra, "size", "n", (F.col("start") + F.col("before")).alias("start")), "placed")
    release(runs)

    per = materialize(placed.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("rows")), "sources")
    sources = materialize(targets(per.select("key", "source_size"), share, weights, cap).join(per.select("key", "rows"), "key"), "targets")
    out = skew_join(placed, sources, ["key"], "rows", placed.count())
    few = out.filter(F.col("n") <= RUN).withColumn("rank", F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("n"))))
    many = out.filter(F.col("n") > RUN).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long")))).repartition("order", "at")
    upper = F.least(F.col("at") + RUN, F.col("n"))
    many = many.withColumn("rank", F.explode(F.sequence(F.col("start") + F.col("at") + 1, F.col("start") + upper))).drop("at")
    out = few.unionByName(many)

    name = F.when(F.col("key") == "t", "null").otherwise(F.substr("key", F.lit(2)))
    offset = (F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{seed}")).cast("binary")), 1, 4), 16, 10).cast("double") + 0.5) / 65536.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = lambda r: F.floor(r * rate + offset)
    copies = (crossed(F.col("rank")) - crossed(F.col("rank") - 1)).cast("int")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"), *extra)


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7:' || md5(coalesce(text, ''))) AS ord FROM documents),
classed AS (
  SELECT *, length(CAST(size AS VARCHAR)) * 100 + size // CAST(pow(10, greatest(length(CAST(size AS VARCHAR)) - 2, 0)) AS BIGINT) AS class FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS i FROM sources),
ratio AS (
  SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / w AS r FROM weighed),
filled AS (
  SELECT *, 1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS left_words,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS left_w FROM ratio
  WINDOW before AS (ORDER BY r, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT coalesce((SELECT left_words / left_w FROM filled WHERE left_words / left_w <= r ORDER BY r, i LIMIT 1), 0.0) AS lam),
target AS (
  SELECT source, source_size, CASE WHEN lam > r THEN cap ELSE least(cap, lam * w) END AS target,
    (CAST('0x' || substr(md5(coalesce(source, 'null') || ':7'), 1, 4) AS BIGINT) + 0.5) / 65536.0 AS u FROM filled, level),
ranked AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY class DESC, ord, doc_id) AS k FROM classed),
taken AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
         CAST(floor(k * (target / nullif(source_size, 0)) + u) - floor((k - 1) * (target / nullif(source_size, 0)) + u) AS BIGINT) AS n
  FROM ranked r JOIN target t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, coalesce(size * n, 0) AS taken, CAST(coalesce(n, 0) AS INTEGER) AS copies FROM taken
"""
