"""Saved views and dashboards as declarative specifications, coverage of extracted values, claim verdicts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .records import deadline

SOON = 30
# Amounts, and phrases before a number that make it a threshold rather than a value.
DECIMAL = re.compile(r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b|\b\d+\.\d+\b")
THRESHOLDS = ("desirable", "optimal", "reference", "normal", "range", "recommended", "less than", "greater than", "level <", "level =", "level >", "< ", "> ", "upto", "up to", "target")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAY_NAMED = re.compile(r"\b(?P<d>\d{1,2})[-/ ](?P<m>[A-Za-z]{3,9})[-/ ](?P<y>\d{4})\b")
ISO = re.compile(r"\b(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})\b")
DAY_FIRST = re.compile(r"\b(?P<d>\d{1,2})[-/](?P<m>\d{1,2})[-/](?P<y>\d{2,4})\b")
NAMED_DAY = re.compile(r"\b(?P<m>[A-Za-z]{3,9})\.?\s+(?P<d>\d{1,2}),?\s+(?P<y>\d{4})\b")


def cell(fields: Column, keys: list[str]) -> Column:
    """First non-empty of the keys, then of labelled facts whose label holds a key in words."""
    facts = F.from_json(F.get_json_object(fields, "$.key_facts"), "array<struct<label:string,value:string>>")
    out = []
    for k in keys:
        v = F.get_json_object(fields, f"$.{k}")
        out.append(F.when(F.trim(v) != "", v))
    for k in keys:
        out.append(F.filter(facts, lambda f: F.lower(f["label"]).contains(k.replace("_", " ")))[0]["value"])
    return F.coalesce(*out)


def view(docs: DataFrame, spec: dict, as_of: str) -> DataFrame:
    """One row per ready document of the view's types: doc_id, its columns, deadline, days, flag.

    ``spec``: docTypes, and columns of label with get (keys) or deadline.
    """
    day = deadline(F.col("fields"))["date"]
    days = F.datediff(day, F.lit(as_of))
    chosen = docs.filter((F.col("status") == "ready") & F.lower("doc_type").isin(*spec["docTypes"]))
    shown = [(day.cast("string") if c.get("deadline") else F.col("doc_type") if c.get("get") == ["__doctype__"] else cell(F.col("fields"), c["get"])).alias(c["label"]) for c in spec["columns"]]
    return chosen.select("doc_id", *shown, day.alias("deadline"), days.alias("days"), F.when(days < 0, "past").when(days <= SOON, "soon").alias("flag"))


def view_metrics(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("count"), F.count_if(F.col("flag") == "past").alias("past"), F.count_if(F.col("flag") == "soon").alias("soon"))


def feed(alerts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most pressing alerts: by severity, then days left, then document and type."""
    order = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    return alerts.orderBy(order, F.coalesce("days", F.lit(10**6)), "doc_id", "type").limit(k).select("doc_id", "type", "severity")


def donut(rows: DataFrame, key: str, amount: str, k: int = 8) -> DataFrame:
    """Largest ``k`` groups by sum, texts that are no number counting 1, with their share of everything."""
    per = rows.groupBy(key).agg(F.sum(F.coalesce(F.col(amount).try_cast("double"), F.lit(1.0))).alias("total"))
    grand = per.agg(F.sum("total").alias("grand"))
    return per.join(F.broadcast(grand)).withColumn("pct", F.round(100 * F.col("total") / F.col("grand"), 1)).drop("grand").orderBy(F.desc("total"), key).limit(k)


def dates_in(text: str) -> list[tuple[str, str | None]]:
    """(as written, ISO or None) of the dates of a text, by the four patterns in turn."""
    out = []
    for pattern in (DAY_NAMED, ISO, DAY_FIRST, NAMED_DAY):
        for m in pattern.finditer(text):
            month = m["m"] if m["m"].isdigit() else str(1 + MONTHS.index(m["m"][:3].lower()) if m["m"][:3].lower() in MONTHS else 0)
            year = int(m["y"]) + (2000 if len(m["y"]) < 4 and int(m["y"]) < 100 else 0)
            ok = 1 <= int(month) <= 12 and 1 <= int(m["d"]) <= 31
            out.append((m[0], f"{year:04d}-{int(month):02d}-{int(m['d']):02d}" if ok else None))
    return out


def coverage_of(source: str, envelope: str) -> tuple[int, int, int]:
    """(considered, captured, thresholds) among the distinct amounts and dates of a text."""
    held = {m[0].replace(",", "") for m in DECIMAL.finditer(envelope)}
    days = {iso for _, iso in dates_in(envelope) if iso}
    amounts: dict[tuple[str, bool], str] = {}
    for m in DECIMAL.finditer(source):
        lead = source[max(0, m.start() - 36) : m.start()].lower()
        amounts.setdefault((m[0].replace(",", ""), any(t in lead for t in THRESHOLDS)), m[0])
    found: dict[str, str] = {}
    for raw, iso in dates_in(source):
        found.setdefault(iso or raw, raw)
    values = {n: raw for (n, threshold), raw in amounts.items() if not threshold}
    captured = sum(n in held or raw in envelope for n, raw in values.items()) + sum(d in days or raw in envelope for d, raw in found.items())
    return len(values) + len(found), captured, len(amounts) - len(values)


def coverage(docs: DataFrame, key: str, source: str, envelope: str) -> DataFrame:
    """(key, considered, captured, thresholds, pct, grade) of each row."""
    kinds = dict(docs.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, *coverage_of(s or "", e or "{}")) for k, s, e in zip(pdf[key], pdf[source], pdf[envelope])]
            yield pd.DataFrame(rows, columns=[key, "considered", "captured", "thresholds"])

    out = docs.select(key, source, envelope).mapInPandas(run, f"{key} {kinds[key]}, considered long, captured long, thresholds long")
    pct = F.when(F.col("considered") > 0, F.bround(100 * F.col("captured") / F.col("considered"), 0).cast("int"))
    return out.withColumn("pct", pct).withColumn("grade", F.when(F.col("pct").isNull(), "na").when(F.col("pct") >= 90, "green").when(F.col("pct") >= 70, "amber").otherwise("red"))


def verdicts(replies: DataFrame, key: str, text: str, claims: str) -> DataFrame:
    """(key, claim, supported, reason) for claims 1 to ``claims``: lines such as '2: UNSUPPORTED — why'; silence supports."""
    lines = replies.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).select(key, "at", F.regexp_extract("line", r"^\s*(\d+)\s*[:.)]\s*(.+)$", 1).alias("n"), F.regexp_extract("line", r"^\s*(\d+)\s*[:.)]\s*(.+)$", 2).alias("body"))
    lines = lines.filter("n <> ''").select(key, F.col("n").cast("int").alias("claim"), "at", F.trim("body").alias("body"))
    last = lines.withColumn("k", F.row_number().over(Window.partitionBy(key, "claim").orderBy(F.desc("at")))).filter("k = 1").drop("k", "at")
    every = replies.select(key, F.explode(F.sequence(F.lit(1), F.col(claims))).alias("claim"))
    bad = F.upper("body").rlike("UNSUPPORTED|NOT SUPPORTED")
    tail = F.regexp_replace(F.when(F.col("body").contains("—"), F.regexp_extract("body", "—(.*)$", 1)).otherwise(F.col("body")), r"^[ —:-]+|[ —:-]+$", "")
    return every.join(last, [key, "claim"], "left").select(key, "claim", (~F.coalesce(bad, F.lit(False))).alias("supported"), F.when(bad, F.substring(tail, 1, 160)).otherwise("").alias("reason"))


def verdict_summary(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key).agg(F.count("*").alias("n"), F.count_if("supported").alias("supported"), F.count_if(~F.col("supported")).alias("unsupported"), F.min("supported").alias("all_supported"))
