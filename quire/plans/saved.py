"""Queries over saved views, coverage, verdicts and possession."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import views as W
from ..session import table
from .records import ALERTS, AS_OF, RECORDS, SINCE, records
from .registry import query

SPEC = {"docTypes": ["invoice", "passport", "policy"], "columns": [{"label": "holder", "get": ["holder", "vendor_email"]}, {"label": "type", "get": ["__doctype__"]}, {"label": "due", "deadline": True}]}


FLAG = f"CASE WHEN {SINCE} < 0 THEN 'past' WHEN {SINCE} <= 30 THEN 'soon' END"
VIEW = f"""SELECT doc_id, CASE k WHEN 0 THEN 'c' || cust || '@b.co' WHEN 1 THEN 'Holder ' || cust END AS holder, doc_type AS type, CAST(day AS VARCHAR) AS due, {SINCE} AS days, {FLAG} AS flag
 FROM ({RECORDS}) WHERE status = 'ready' AND k <= 2"""


@query("vw_eval", VIEW)
def vw_eval(spark, sf):
    return W.view(records(spark, sf), SPEC, AS_OF).select("doc_id", "holder", "type", "due", "days", "flag")


@query("vw_metrics", f"SELECT count(*) AS count, count(*) FILTER (WHERE flag = 'past') AS past, count(*) FILTER (WHERE flag = 'soon') AS soon FROM ({VIEW})")
def vw_metrics(spark, sf):
    return W.view_metrics(W.view(records(spark, sf), SPEC, AS_OF))


@query("db_feed", ALERTS + "SELECT doc_id, type, severity FROM a ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, coalesce(days, 1000000), doc_id, type LIMIT 25")
def db_feed(spark, sf):
    from ..operators.records import alerts

    return W.feed(alerts(records(spark, sf), AS_OF), 25)


# Each order's note names its total, day and a range; its record holds the total, the day or neither.
_MONEY = "printf('%.2f', o_totalprice)"
NOTES = "SELECT o_orderkey, o_orderkey % 4 AS k FROM orders"


def _notes(spark, sf):
    total, day = F.format_string("%.2f", "o_totalprice"), F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 4
    source = F.when(k == 3, F.lit("nothing here")).otherwise(F.concat(F.lit("Total "), total, F.lit(" due "), F.date_format(day, "d-MMM-yyyy"), F.lit(". Level in normal range 0.13 only")))
    held = F.when(k == 0, F.concat(F.lit('{"total": "'), total, F.lit('", "due": "'), day.cast("string"), F.lit('"}'))).when(k == 1, F.concat(F.lit('{"total": "'), total, F.lit('"}'))).otherwise(F.lit("{}"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), source.alias("source"), held.alias("envelope"))


@query("cov_analyze", f"""SELECT o_orderkey AS id, CASE k WHEN 3 THEN 0 ELSE 2 END AS considered, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS captured, CASE k WHEN 3 THEN 0 ELSE 1 END AS thresholds,
 CASE k WHEN 0 THEN 100 WHEN 1 THEN 50 WHEN 2 THEN 0 END AS pct, CASE k WHEN 0 THEN 'green' WHEN 3 THEN 'na' ELSE 'red' END AS grade FROM ({NOTES})""")
def cov_analyze(spark, sf):
    return W.coverage(_notes(spark, sf), "id", "source", "envelope")


# Replies of a checker to three claims of each document: the second is refused for every third, the third for every fifth.
VERDICTS = "SELECT doc_id AS id, unnest([1, 2, 3]) AS claim FROM documents"


def _replies(spark, sf):
    second = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("2: UNSUPPORTED — not in text "), F.col("doc_id"))).otherwise(F.lit("2) SUPPORTED"))
    third = F.when(F.col("doc_id") % 5 == 0, F.lit("3. not supported")).otherwise(F.lit("noise"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("\n", F.lit("1: SUPPORTED"), second, third).alias("reply"), F.lit(3).alias("n"))


@query("cit_verdicts", f"""SELECT id, claim, NOT (claim = 2 AND id % 3 = 0 OR claim = 3 AND id % 5 = 0) AS supported,
 CASE WHEN claim = 2 AND id % 3 = 0 THEN 'not in text ' || id WHEN claim = 3 AND id % 5 = 0 THEN 'not supported' ELSE '' END AS reason FROM ({VERDICTS})""")
def cit_verdicts(spark, sf):
    return W.verdicts(_replies(spark, sf), "id", "reply", "n")


@query("cit_summary", """SELECT doc_id AS id, 3 AS n, 3 - CAST(doc_id % 3 = 0 AS INTEGER) - CAST(doc_id % 5 = 0 AS INTEGER) AS supported, CAST(doc_id % 3 = 0 AS INTEGER) + CAST(doc_id % 5 = 0 AS INTEGER) AS unsupported,
 doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS all_supported FROM documents""")
def cit_summary(spark, sf):
    return W.verdict_summary(cit_verdicts(spark, sf), "id")


@query("qa_possession", f"SELECT t.asked, count(r.doc_id) AS on_file FROM (SELECT lower(p_type) AS asked FROM part UNION SELECT unnest(['invoice', 'passport', 'visa'])) t LEFT JOIN ({RECORDS}) r ON r.doc_type = t.asked GROUP BY 1")
def qa_possession(spark, sf):
    """How many documents of each kind asked about are on file: part types stand in for kinds nobody has."""
    kinds = spark.createDataFrame([("invoice",), ("passport",), ("visa",)], "asked string")
    asked = table(spark, sf, "part").select(F.lower("p_type").alias("asked")).unionByName(kinds).distinct()
    held = records(spark, sf).groupBy(F.col("doc_type").alias("asked")).agg(F.count("*").alias("n"))
    return asked.join(held, "asked", "left").select("asked", F.coalesce("n", F.lit(0)).alias("on_file"))
