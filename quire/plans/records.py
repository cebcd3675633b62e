"""Queries over graphs, identities and extracted records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import records as X
from ..session import table
from .registry import query

EDGES = """SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier"""


def _edges(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    return n.unionByName(s)


@query("gr_traverse", f"""
WITH RECURSIVE e AS ({EDGES}), d AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
w AS (SELECT 'n1' AS node, 0 AS depth, ['n1'] AS path UNION ALL SELECT d.dst, w.depth + 1, list_append(w.path, d.dst) FROM w JOIN d ON w.node = d.src WHERE w.depth < 3 AND NOT list_contains(w.path, d.dst))
SELECT DISTINCT node, depth FROM w""")
def gr_traverse(spark, sf):
    return G.traverse(_edges(spark, sf), spark.createDataFrame([("n1",)], "node string"), 3)


@query("gr_degree", f"WITH e AS ({EDGES}), d AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT src AS node, count(*) AS degree FROM d GROUP BY 1")
def gr_degree(spark, sf):
    return G.degrees(_edges(spark, sf))


@query("gr_identity", f"WITH e AS ({EDGES}), near AS (SELECT 'r2' AS node UNION SELECT dst FROM e WHERE src = 'r2') SELECT src, dst FROM e WHERE src IN (SELECT node FROM near) AND dst IN (SELECT node FROM near)")
def gr_identity(spark, sf):
    return G.ego(_edges(spark, sf), spark.createDataFrame([("r2",)], "node string")).select("src", "dst")


@query("gr_relations", f"WITH e AS ({EDGES}) SELECT src, dst FROM e WHERE src LIKE 'n%' AND dst LIKE 's%'")
def gr_relations(spark, sf):
    return _edges(spark, sf).filter("src LIKE 'n%' AND dst LIKE 's%'")


@query("dup_related", "SELECT o_custkey AS other, count(DISTINCT o_orderpriority) AS shared FROM orders WHERE o_custkey <> 1 AND o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_custkey = 1) GROUP BY 1")
def dup_related(spark, sf):
    m = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("canonical"))
    return G.related_documents(m, 1).select("other", F.col("shared").cast("long").alias("shared"))


# Three spellings of one name for every three customers; names of different threes share no word.
_FIRST, _LAST = "substr(md5(CAST((c_custkey - c_custkey % 3) AS STRING)), 1, 8)", "substr(md5(CAST((c_custkey - c_custkey % 3 + 1000000000) AS STRING)), 1, 8)"
_FORM = f"CASE c_custkey % 3 WHEN 0 THEN {_FIRST} || ' ' || {_LAST} WHEN 1 THEN {_LAST} || ' ' || {_FIRST} ELSE {_FIRST} || ' j ' || {_LAST} END"
MENTIONS = f"SELECT c_custkey AS id, c_custkey % 3 AS k, {_FORM} AS canonical, c_nationkey AS doc FROM customer".replace("STRING", "VARCHAR")


def _mentions(spark, sf):
    kind = F.lit("person").alias("kind")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), kind, F.expr(_FORM).alias("canonical"), F.initcap(F.expr(_FORM)).alias("text"), F.col("c_nationkey").alias("doc"))


@query("res_cluster", f"WITH m AS ({MENTIONS}) SELECT id, min(id) OVER (PARTITION BY id - k) AS root FROM m")
def res_cluster(spark, sf):
    return G.cluster(_mentions(spark, sf).select("id", "kind", "canonical"))


@query("agg_identity_rebuild", f"""WITH m AS ({MENTIONS}) SELECT min(id) AS root, string_agg(canonical, '|' ORDER BY canonical) AS aliases, max(length(canonical)) AS name_length,
 count(DISTINCT doc) AS docs, count(*) AS mentions FROM m GROUP BY id - k""")
def agg_identity_rebuild(spark, sf):
    found = G.identities(_mentions(spark, sf))
    return found.select("root", F.array_join("aliases", "|").alias("aliases"), F.length("name").cast("long").alias("name_length"), "docs", "mentions")


#: Extracted records of all orders: what the database side sees of them.
RECORDS = """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'ready' END AS status, o_custkey % 5 AS k,
 CASE o_custkey % 5 WHEN 0 THEN 'invoice' WHEN 1 THEN 'passport' WHEN 2 THEN 'policy' WHEN 3 THEN 'unclassified' END AS doc_type,
 CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 100) / 100.0 END AS confidence, o_orderkey % 3 AS low_pages, CAST(o_orderdate AS DATE) AS day, o_totalprice AS total, o_custkey AS cust FROM orders"""
AS_OF = "1996-06-15"
SINCE = f"CAST(day - DATE '{AS_OF}' AS INTEGER)"


def records(spark, sf):
    """The same orders as records: status, type, confidence, low pages, and fields as JSON."""
    k, day = F.col("o_custkey") % 5, F.to_date("o_orderdate")
    money, cust = F.format_string("%.2f", "o_totalprice"), F.col("o_custkey").cast("string")
    said = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    fields = (
        F.when(k == 0, said('{"due_date": "', day.cast("string"), '", "total": "', money, '", "vendor_email": "c', cust, '@b.co"}'))
        .when(k == 1, said('{"expiry_date": "', F.date_format(day, "dd/MM/yyyy"), '", "holder": "Holder ', cust, '"}'))
        .when(k == 2, said('{"end_date": "', F.date_format(day, "d MMM yyyy"), '", "rate": "four", "items": [1, 2]}'))
        .when(k == 3, F.lit('{"valid_until": "soon"}')).otherwise(F.lit("{}"))
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 11 == 0, "failed").when(F.col("o_orderstatus") == "P", "pending").otherwise("ready").alias("status"),
        F.when(k == 0, "invoice").when(k == 1, "passport").when(k == 2, "policy").when(k == 3, "unclassified").alias("doc_type"),
        F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 100) / 100.0).alias("confidence"), (F.col("o_orderkey") % 3).alias("low_pages"), fields.alias("fields"),
    )


ALERTS = f"""WITH r AS (SELECT *, CASE WHEN k <= 2 THEN {SINCE} END AS days FROM ({RECORDS})), a AS (
 SELECT doc_id, 'ingestion_failed' AS type, 'high' AS severity, CAST(NULL AS INTEGER) AS days FROM r WHERE status = 'failed'
 UNION ALL SELECT doc_id, CASE WHEN k = 0 THEN 'overdue' ELSE 'expired' END, 'high', days FROM r WHERE status = 'ready' AND days < 0
 UNION ALL SELECT doc_id, CASE WHEN k = 0 THEN 'due_soon' ELSE 'expiring_soon' END, 'warn', days FROM r WHERE status = 'ready' AND days BETWEEN 0 AND 30
 UNION ALL SELECT doc_id, 'unclassified', 'review', NULL FROM r WHERE status = 'ready' AND k >= 3
 UNION ALL SELECT doc_id, 'low_confidence', 'review', NULL FROM r WHERE status = 'ready' AND k < 3 AND confidence < 0.6
 UNION ALL SELECT doc_id, 'low_ocr_confidence', 'review', NULL FROM r WHERE status = 'ready' AND low_pages > 0) """
WATCHED = f"""WITH w AS (SELECT doc_id, CASE k WHEN 0 THEN 'due_date' ELSE 'expiry_date' END AS name, CASE k WHEN 0 THEN 'payment' ELSE 'expiry' END AS kind, {SINCE} AS days
 FROM ({RECORDS}) WHERE status = 'ready' AND k <= 1 AND {SINCE} >= -45)"""
PAIRS = f"""WITH r AS ({RECORDS}), f AS (SELECT doc_id, unnest(CASE k
 WHEN 0 THEN [{{'name': 'due_date', 'value': CAST(day AS VARCHAR), 'score': 0.95}}, {{'name': 'total', 'value': printf('%.2f', total), 'score': 0.8}}, {{'name': 'vendor_email', 'value': 'c' || cust || '@b.co', 'score': 0.8}}]
 WHEN 1 THEN [{{'name': 'expiry_date', 'value': strftime(day, '%d/%m/%Y'), 'score': 0.95}}, {{'name': 'holder', 'value': 'Holder ' || cust, 'score': 0.7}}]
 WHEN 2 THEN [{{'name': 'end_date', 'value': strftime(day, '%-d %b %Y'), 'score': 0.8}}, {{'name': 'rate', 'value': 'four', 'score': 0.4}}]
 WHEN 3 THEN [{{'name': 'valid_until', 'value': 'soon', 'score': 0.4}}] ELSE [] END, recursive := true) FROM r) """


@query("al_doc", ALERTS + "SELECT * FROM a")
def al_doc(spark, sf):
    return X.alerts(records(spark, sf), AS_OF)


@query("al_deadline", f"SELECT doc_id, CASE WHEN k <= 2 THEN day END AS date, CASE k WHEN 0 THEN 'due_date' WHEN 1 THEN 'expiry_date' WHEN 2 THEN 'end_date' END AS key FROM ({RECORDS})")
def al_deadline(spark, sf):
    return records(spark, sf).select("doc_id", X.deadline(F.col("fields")).alias("d")).select("doc_id", "d.date", "d.key")


@query("prj_unpivot", PAIRS + "SELECT doc_id, name, value FROM f")
def prj_unpivot(spark, sf):
    return X.unpivot(records(spark, sf))


@query("sink_extract", f"SELECT doc_id, CASE WHEN k = 0 THEN CAST(day AS VARCHAR) END AS due_date, CASE WHEN k = 0 THEN printf('%.2f', total) END AS total FROM ({RECORDS}) WHERE k <= 3")
def sink_extract(spark, sf):
    return X.export(records(spark, sf), ["due_date", "total"])


@query("q_field_score", PAIRS + "SELECT doc_id, name, CAST(score AS DOUBLE) AS score FROM f")
def q_field_score(spark, sf):
    f = X.unpivot(records(spark, sf))
    return f.select("doc_id", "name", F.round(X.field_score(F.col("name"), F.col("value"), F.col("name").isin("due_date", "expiry_date"), F.lit(0.7)), 3).alias("score"))


@query("q_low", PAIRS + "SELECT doc_id, name, CAST(score AS DOUBLE) AS score FROM f WHERE score < 0.6")
def q_low(spark, sf):
    return q_field_score(spark, sf).filter("score > 0 AND score < 0.6")


@query("q_trust", f"""WITH s AS (SELECT doc_id, status, k, CASE WHEN status <> 'ready' THEN 0.0 WHEN doc_id % 13 = 0 THEN 1.0 ELSE round(CAST(greatest(0.0, least(1.0, coalesce(confidence, 0.7) - CASE WHEN k >= 3 THEN 0.25 ELSE 0 END
 - CASE WHEN low_pages > 0 THEN least(0.3, 0.1 + 0.05 * low_pages) ELSE 0 END - CASE WHEN k IN (1, 2) THEN 0.05 ELSE 0 END)) AS DOUBLE), 3) END AS score FROM ({RECORDS})),
 l AS (SELECT *, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS level FROM s)
SELECT doc_id, CAST(score AS DOUBLE) AS score, level, CASE WHEN status <> 'ready' THEN 'unprocessed' WHEN doc_id % 13 = 0 THEN 'verified' WHEN k = 4 THEN 'unstructured' WHEN level = 'high' THEN 'trusted' WHEN level = 'medium' THEN 'review' ELSE 'needs_review' END AS state FROM l""")
def q_trust(spark, sf):
    uncertain = F.when(F.col("doc_type").isin("passport", "policy"), 1).otherwise(0)
    review = F.when(F.col("doc_id") % 13 == 0, "reviewed")
    d = records(spark, sf).withColumns({"review": review, "n_fields": F.size(F.from_json("fields", "map<string,string>")), "uncertain": uncertain})
    return X.trust(d).select("doc_id", "score", "level", "state")


@query("al_urgency", f"SELECT doc_id, CASE WHEN {SINCE} < 0 THEN 'overdue' WHEN {SINCE} <= 7 THEN 'urgent' WHEN {SINCE} <= 30 THEN 'soon' WHEN {SINCE} <= 90 THEN 'upcoming' ELSE 'info' END AS bucket FROM ({RECORDS})")
def al_urgency(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), X.urgency(F.datediff(F.to_date("o_orderdate"), F.lit(AS_OF))).alias("bucket"))


@query("al_watch", WATCHED + " SELECT *, CASE WHEN days < 0 THEN 'overdue' WHEN days <= 7 THEN 'urgent' WHEN days <= 30 THEN 'soon' WHEN days <= 90 THEN 'upcoming' ELSE 'info' END AS urgency FROM w")
def al_watch(spark, sf):
    return X.watched(records(spark, sf), AS_OF)


@query("al_merge", ALERTS.replace("WITH r", WATCHED + ", r", 1) + "SELECT doc_id, kind AS type FROM w UNION ALL SELECT doc_id, type FROM a WHERE days IS NULL OR doc_id NOT IN (SELECT doc_id FROM w)")
def al_merge(spark, sf):
    d = records(spark, sf)
    return X.merged_alerts(X.watched(d, AS_OF), X.alerts(d, AS_OF))


@query("al_unified", ALERTS + "SELECT severity, count(*) AS n FROM a GROUP BY 1")
def al_unified(spark, sf):
    return X.alerts(records(spark, sf), AS_OF).groupBy("severity").agg(F.count("*").alias("n"))
