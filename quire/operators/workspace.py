"""Answers and listings over many records: counts, names, currencies, review reasons, windows of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import word_pairs


def shuffled(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of which no side goes whole to all tasks through the driver: of a name's parts Spark's estimate is the bytes of the file, many times too few."""
    return a.join(b.hint("merge"), on, how)


def by_rarity(sets: DataFrame, words: str = "w") -> DataFrame:
    """Different ``sets``, those without words left out, with the words of each in the order of how few sets hold them, and in ``often`` how many hold each."""
    each = sets.select(F.struct(*sets.columns).alias("_row"), F.explode(words).alias("_word"))
    counts = each.groupBy("_word").agg(F.count("*").alias("_often"))
    told = shuffled(each, counts, "_word").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_often", "_word"))).alias("_w"))
    rest = [F.col(f"_row.{c}").alias(c) for c in sets.columns if c != words]
    return told.select(*rest, F.transform("_w", lambda x: x["_word"]).alias(words), F.transform("_w", lambda x: x["_often"]).alias("often"))


def subset_candidates(groups: DataFrame) -> DataFrame:
    """(a, wa, b, wb) of names of which the shorter's two rarest words stand in the longer, so a word of all names pairs nothing."""
    ranked = by_rarity(groups.select("name", F.array_distinct(F.split("name", " ")).alias("w")).distinct())
    a = ranked.filter(F.size("w") >= 2).select(F.col("name").alias("a"), F.col("w").alias("wa"), F.explode(word_pairs(F.slice("w", 1, 2))).alias("pair"))
    b = ranked.filter(F.size("w") >= 3).select(F.col("name").alias("b"), F.col("w").alias("wb"), F.explode(word_pairs(F.col("w"))).alias("pair"))
    return shuffled(a, b, "pair").filter(F.size("wa") < F.size("wb")).select("a", "wa", "b", "wb")


def merge_name_subsets(groups: DataFrame) -> DataFrame:
    """(name, into): groups named by words fold into the largest group that holds all their words and more.

    Only names of two words or more fold; of equally large groups the first by name takes them.  The
    largest such group lies in no other, so one step is all there is.
    """
    held = subset_candidates(groups).filter(F.size(F.array_except("wa", "wb")) == 0)
    best = held.groupBy(F.col("a").alias("name")).agg(F.min(F.struct((-F.size("wb")).alias("n"), "b"))["b"].alias("into"))
    return shuffled(groups.select("name").distinct(), best, "name", "left").select("name", F.coalesce("into", "name").alias("into"))


def names_on_file(asked: DataFrame, mentions: DataFrame) -> DataFrame:
    """(question, doc): documents that hold all names (at most 4) of a question."""
    names = asked.select("question", F.explode(F.slice(F.array_distinct("names"), 1, 4)).alias("name"))
    need = names.groupBy("question").agg(F.count("*").alias("need"))
    found = names.join(mentions.select("name", "doc").distinct(), "name").groupBy("question", "doc").agg(F.count("*").alias("have"))
    return found.join(need, "question").filter("have = need").select("question", "doc")


def kind_counts(docs: DataFrame, kind: str, day: str) -> DataFrame:
    """(kind, n, oldest, newest) of documents."""
    return docs.groupBy(kind).agg(F.count("*").alias("n"), F.min(day).alias("oldest"), F.max(day).alias("newest"))


def currencies(pairs: DataFrame) -> DataFrame:
    """(code, docs): codes of two to four characters in fields whose name speaks of currency."""
    code = F.upper(F.trim("value"))
    held = pairs.filter(F.lower("name").contains("currency") & F.length(F.trim("value")).between(2, 4))
    return held.groupBy(code.alias("code")).agg(F.countDistinct("doc_id").alias("docs"))


def review_reasons(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(doc_id, code, severity) for all that keeps a document from being approved by itself; a failed one has that reason alone."""
    reason = lambda code, severity: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    ok = F.col("status") != "failed"
    rules = F.array_compact(F.array(
        F.when(~ok, reason("ingestion_failed", "block")),
        F.when(ok & F.col("doc_type").isNull(), reason("no_type", "block")),
        F.when(ok & F.col("confidence").isNull(), reason("no_confidence", "warn")),
        F.when(ok & (F.col("confidence") < threshold), reason("low_confidence", "warn")),
        F.when(ok & (F.col("low_pages") > 0), reason("low_ocr", "info")),
    ))
    return docs.select("doc_id", F.explode(rules).alias("r")).select("doc_id", "r.code", "r.severity")


def named_first(hits: DataFrame, named: Column, k: int) -> DataFrame:
    """Hits (qid, doc, score) of named documents before all others, each by score."""
    order = Window.partitionBy("qid").orderBy(named.desc(), F.desc("score"), "doc")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def table_windows(rows: Column, header: int, target: int) -> Column:
    """Number of the window each body row goes to: rows are packed until ``target`` characters, header included."""
    start = F.struct(F.lit(0).alias("g"), F.lit(header).alias("n"), F.array().cast("array<int>").alias("out"))

    def add(s, r):
        size = F.length(r) + 1
        fresh = (s["n"] > header) & (s["n"] + size > target)
        g = s["g"] + fresh.cast("int")
        return F.struct(g.alias("g"), F.when(fresh, header + size).otherwise(s["n"] + size).alias("n"), F.concat(s["out"], F.array(g)).alias("out"))

    return F.aggregate(rows, start, add, lambda s: s["out"])


def box_union(boxes: DataFrame, by: str) -> DataFrame:
    """Least box around each group's boxes, page and place of the first by ``at``."""
    return boxes.groupBy(by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min_by("page", "at").alias("page"))


def entity_edges(rows: DataFrame, doc: str, roles: dict[str, str]) -> DataFrame:
    """(src, rel, dst, doc): an edge from each document to the entity in each of its filled columns, by role."""
    parts = F.array(*(F.struct(F.lit(rel).alias("rel"), F.col(c).cast("string").alias("dst")) for c, rel in roles.items()))
    long = rows.select(F.col(doc).alias("doc"), F.explode(parts).alias("e")).filter("trim(e.dst) <> ''")
    return long.select(F.concat(F.lit("doc:"), "doc").alias("src"), "e.rel", F.lower(F.trim("e.dst")).alias("dst"), "doc")


def latest_zscore(monthly: DataFrame, key: str) -> DataFrame:
    """(key, latest, mean, sd, z) of each key's latest month against all before it, where those are two or more."""
    last = Window.partitionBy(key)
    m = monthly.withColumn("_last", F.max("month").over(last))
    before = F.when(F.col("month") < F.col("_last"), F.col("amount"))
    out = m.groupBy(key).agg(F.max(F.when(F.col("month") == F.col("_last"), F.col("amount"))).alias("latest"), F.avg(before).alias("mean"), F.stddev_samp(before).alias("sd"), F.count(before).alias("n"))
    return out.filter("n >= 2").select(key, "latest", "mean", "sd", F.when(F.col("sd") > 0, (F.col("latest") - F.col("mean")) / F.col("sd")).alias("z"))


def schema_slug(types: DataFrame, slugs: list[str], weak: tuple[str, ...] = ()) -> DataFrame:
    """(type, slug): an approved slug equal to the type, else the one slug that alone holds a word of it of four letters or more."""
    held: dict[str, list[str]] = {}
    for s in slugs:
        for w in set(s.split("_")):
            held.setdefault(w, []).append(s)
    alone = {w: s[0] for w, s in held.items() if len(s) == 1 and len(w) >= 4 and w not in weak}
    words = F.split(F.lower(F.trim("type")), "_")
    known = F.create_map(*(F.lit(x) for pair in alone.items() for x in pair))
    first = F.get(F.filter(F.transform(words, lambda w: F.try_element_at(known, w)), lambda x: x.isNotNull()), F.lit(0))
    return types.select("type", F.when(F.lower(F.trim("type")).isin(*slugs), F.lower(F.trim("type"))).otherwise(first).alias("slug"))
