"""Queries over values of records, written in several ways, and over caches and small rule ladders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, values as V
from ..operators import records as X
from ..operators import retrieval as R
from ..operators import views as W
from ..session import table
from .registry import query


def _shaped(name, column, pairs, fn, kind="double"):
    """A query over all orders: values written in turn in several ways (Spark SQL), read back by ``fn``, beside what each says (SQL)."""
    cases = lambda i: " ".join(f"WHEN {n} THEN {pair[i]}" for n, pair in enumerate(pairs))
    cast = {"double": "DOUBLE", "date": "DATE", "string": "VARCHAR", "boolean": "BOOLEAN"}[kind]

    @query(name, f"SELECT o_orderkey, CAST(CASE o_orderkey % {len(pairs)} {cases(1)} END AS {cast}) AS {column} FROM orders")
    def run(spark, sf):
        written = F.expr(f"CASE o_orderkey % {len(pairs)} {cases(0)} END")
        return table(spark, sf, "orders").select("o_orderkey", written.alias("s")).select("o_orderkey", fn(F.col("s")).alias(column))

    return run


_N, _C, _K = "format_number(o_totalprice, 2)", "CAST(o_custkey AS STRING)", "CAST(o_custkey AS DOUBLE)"
_DAY = "CAST(o_orderdate AS DATE)"
_as = lambda form: f"date_format(o_orderdate, '{form}')"
_first = lambda form, sql: (_as(form), sql)
#: A day past the twelfth can only be a day, so month-first dates are read as such.
_late = f"CASE WHEN day(o_orderdate) > 12 THEN {_DAY} ELSE make_date(CAST(year(o_orderdate) AS INTEGER), CAST(day(o_orderdate) AS INTEGER), CAST(month(o_orderdate) AS INTEGER)) END"

_shaped("fn_value_kind", "kind", [("'yes'", "'boolean'"), (f"'$' || {_C}", "'money'"), (_as("d MMM yyyy"), "'date'"), (f"{_N} || '%'", "'number'"), (f"'abc' || {_C}", "'string'"), ("''", "'string'"), (f"{_C} || ' EUR'", "'money'")], V.kind, "string")
_shaped("prj_cells", "cell", [(f"'{{\"vendor\": \"\", \"vendor_name\": \"Acme ' || {_C} || '\"}}'", "'Acme ' || o_custkey"), (f"'{{\"key_facts\": [{{\"label\": \"Vendor name\", \"value\": \"Foo ' || {_C} || '\"}}]}}'", "'Foo ' || o_custkey"), ("'{}'", "NULL")],
        lambda c: W.cell(c, ["vendor", "vendor_name"]), "string")
_shaped("agg_quality_level", "level", [("CAST((o_custkey % 101) / 100.0 AS STRING)", "CASE WHEN o_custkey % 101 >= 85 THEN 'good' WHEN o_custkey % 101 >= 70 THEN 'fair' ELSE 'poor' END")], lambda c: V.quality_level(c.cast("double")), "string")


@query("fn_vision_gate")
def fn_vision_gate(spark, sf):
    gated = table(spark, sf, "documents").select("doc_id", V.transcript_gate(F.col("text")).alias("g"))
    return gated.select("doc_id", "g.ok", F.round("g.score", 4).alias("score"), "g.reason")


@query("vec_cache_lookup", """WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS hit, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS sim FROM embeddings q, embeddings v
 WHERE q.vec_id % 50 = 0 AND v.vec_id % 3 >= 1 AND v.vec_id % 3 >= v.label % 3), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, hit) AS k FROM s WHERE sim >= 0.3) SELECT qid, hit, sim FROM r WHERE k = 1""")
def vec_cache_lookup(spark, sf):
    """Best helpful stored answer of each question; ids and labels stand in for the helpful counts."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("vid"), F.col("embedding").alias("vec"), (F.col("vec_id") % 3).alias("up"), (F.col("label") % 3).alias("down"))
    hits = R.cosine_topk(v.filter("vid % 50 = 0").select(F.col("vid").alias("qid"), "vec"), v.filter("up >= 1 AND up >= down"), 1)
    return hits.filter("sim >= 0.3").select("qid", F.col("vid").alias("hit"), "sim")


@query("dup_citations", "SELECT doc_id, item_id FROM (SELECT doc_id, item_id, row_number() OVER (PARTITION BY doc_id ORDER BY item_id) AS k FROM documents, benchmark WHERE contains(documents.text, benchmark.text)) WHERE k = 1")
def dup_citations(spark, sf):
    hits = table(spark, sf, "documents").join(F.broadcast(table(spark, sf, "benchmark").select("item_id", F.col("text").alias("item"))), F.col("text").contains(F.col("item")))
    return hits.groupBy("doc_id").agg(F.min("item_id").alias("item_id"))


@query("ret_pool_union", "WITH p AS (SELECT doc_id, 0 AS src, n_chars AS rank FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 1, doc_id FROM documents WHERE lang IN ('de', 'fr')) SELECT doc_id, min(src) AS src FROM p GROUP BY 1")
def ret_pool_union(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    pools = d.filter("lang = 'de'").select("doc_id", F.lit(0).alias("src")).unionByName(d.filter("lang IN ('de', 'fr')").select("doc_id", F.lit(1).alias("src")))
    return pools.groupBy("doc_id").agg(F.min("src").alias("src"))


@query("ret_merge", "WITH h AS (SELECT o_custkey AS chunk, o_totalprice AS score FROM orders UNION ALL SELECT l_suppkey, l_extendedprice * 1.1 FROM lineitem), b AS (SELECT chunk, max(score) AS score FROM h GROUP BY 1) SELECT chunk, round(score, 4) AS score FROM b ORDER BY score DESC, chunk LIMIT 12")
def ret_merge(spark, sf):
    """The best of two ranked lists, each chunk with its better score: orders and lines stand in for hits."""
    first = table(spark, sf, "orders").select(F.col("o_custkey").alias("chunk"), F.col("o_totalprice").alias("score"))
    again = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("chunk"), (F.col("l_extendedprice") * 1.1).alias("score"))
    return R.merged([first, again], 12).withColumn("score", F.round("score", 4))


@query("ret_evidence_block", "SELECT conv_id, string_agg('[E' || (turn + 1) || ' · ' || role || '] ' || substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 240), chr(10) ORDER BY turn) AS block FROM conversations GROUP BY 1")
def ret_evidence_block(spark, sf):
    line = F.format_string("[E%d · %s] %s", F.col("turn") + 1, F.col("role"), F.substring(F.regexp_replace("text", r"\s+", " "), 1, 240))
    per = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("p"))
    return per.select("conv_id", F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("block"))


@query("ent_link_alias", """WITH s AS (SELECT s_suppkey AS k, lower(s_name) AS n FROM supplier) SELECT a.k AS a, b.k AS b, levenshtein(a.n, b.n) AS d FROM s a JOIN s b ON a.k < b.k AND substr(a.n, 1, length(a.n) - 1) = substr(b.n, 1, length(b.n) - 1) AND levenshtein(a.n, b.n) <= 3""")
def ent_link_alias(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.lower("s_name").alias("n")).withColumn("block", F.expr("substring(n, 1, length(n) - 1)"))
    a, b = s.select(F.col("k").alias("a"), F.col("n").alias("na"), "block"), s.select(F.col("k").alias("b"), F.col("n").alias("nb"), "block")
    return a.join(b, "block").filter((F.col("a") < F.col("b")) & names.lev_le(F.col("na"), F.col("nb"), 3)).select("a", "b", F.levenshtein("na", "nb").cast("long").alias("d"))


@query("res_name", "SELECT s_nationkey, arg_max(s_name, (length(s_name), s_name)) AS name FROM supplier WHERE length(s_name) <= 60 GROUP BY 1")
def res_name(spark, sf):
    from ..operators.graph import best_name

    return table(spark, sf, "supplier").groupBy("s_nationkey").agg(best_name(F.col("s_name")).alias("name"))


@query("gr_profile", "SELECT c_custkey AS entity, count(*) AS docs, CAST(min(CAST(o_orderdate AS DATE)) AS DATE) AS first_day, CAST(max(CAST(o_orderdate AS DATE)) AS DATE) AS last_day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def gr_profile(spark, sf):
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_custkey").alias("entity")).agg(
        F.count("*").alias("docs"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("amount"))


@query("ins_all")
def ins_all(spark, sf):
    """Findings of all insights by kind and severity."""
    from . import ledger

    parts = [(k, getattr(ledger, f"ins_{k}")(spark, sf)) for k in ("concentration", "counterparty", "subscription", "category", "continuity")]
    out = None
    for kind, found in parts:
        one = found.groupBy("severity").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "severity", "n")
        out = one if out is None else out.unionByName(one)
    return out
