"""Queries of the answer chain and of writers that run again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answering as A
from ..operators import retrieval as R
from ..operators import sinks
from ..session import shared_path, table
from .registry import query

#: Questions made of what the tables hold, besides all benchmark items.
QUESTIONS = """SELECT 'count ' || c_mktsegment AS qid, 'How many ' || lower(c_mktsegment) || ' customers are there?' AS text FROM customer GROUP BY ALL
 UNION ALL SELECT 'total ' || o_orderpriority, 'How many dollars is the total of ' || o_orderpriority || ' orders?' FROM orders GROUP BY ALL
 UNION ALL SELECT 'have ' || lang, 'Do I have a ' || lang || ' document?' FROM documents WHERE lang IS NOT NULL GROUP BY ALL
 UNION ALL SELECT 'which ' || p_brand, 'Which parts of ' || p_brand || ' are there, and how many?' FROM part GROUP BY ALL
 UNION ALL SELECT 'lost ' || n_name, 'How many ' || lower(n_name) || ' customers are there?' FROM nation
 UNION ALL SELECT 'item ' || item_id, text FROM benchmark"""


def _questions(spark, sf):
    pick = lambda name, column, label, *text: table(spark, sf, name).filter(F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct().select(F.concat(F.lit(f"{label} "), "v").alias("qid"), F.concat(*text).alias("text"))
    low = F.lower("v")
    return (
        pick("customer", "c_mktsegment", "count", F.lit("How many "), low, F.lit(" customers are there?"))
        .unionByName(pick("orders", "o_orderpriority", "total", F.lit("How many dollars is the total of "), F.col("v"), F.lit(" orders?")))
        .unionByName(pick("documents", "lang", "have", F.lit("Do I have a "), F.col("v"), F.lit(" document?")))
        .unionByName(pick("part", "p_brand", "which", F.lit("Which parts of "), F.col("v"), F.lit(" are there, and how many?")))
        .unionByName(pick("nation", "n_name", "lost", F.lit("How many "), low, F.lit(" customers are there?")))
        .unionByName(table(spark, sf, "benchmark").select(F.concat(F.lit("item "), "item_id").alias("qid"), "text"))
    )


@query("qa_chain", f"""WITH q AS ({QUESTIONS}),
money AS (SELECT qid, printf('%.2f', CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE)) AS answer FROM q JOIN orders ON contains(text, o_orderpriority) WHERE regexp_matches(text, '(?i)\\b(total|amount)\\b') GROUP BY 1),
counted AS (SELECT qid, CAST(count(*) AS VARCHAR) AS answer FROM q JOIN customer ON contains(text, ' ' || lower(c_mktsegment) || ' ') WHERE regexp_matches(text, '(?i)\\bhow many\\b') GROUP BY 1),
owned AS (SELECT qid, CASE WHEN count(lang) > 0 THEN 'yes' ELSE 'no' END AS answer FROM q LEFT JOIN documents ON contains(q.text, ' ' || lang || ' ') WHERE regexp_matches(q.text, '(?i)\\bdo i have\\b') GROUP BY 1),
listed AS (SELECT qid, min(p_name) AS answer FROM q JOIN part ON contains(text, p_brand || ' ') WHERE regexp_matches(text, '(?i)\\b(which|list)\\b') GROUP BY 1),
said AS (SELECT 1 AS k, 'possession' AS handler, * FROM owned UNION ALL SELECT 2, 'count', * FROM counted UNION ALL SELECT 3, 'money', * FROM money UNION ALL SELECT 4, 'list', * FROM listed)
SELECT q.qid, arg_min(handler, k) AS handler, arg_min(answer, k) AS answer FROM q LEFT JOIN said ON said.qid = q.qid GROUP BY 1""")
def qa_chain(spark, sf):
    """Counts before money, as the chain has it; a count that finds nothing leaves the question to those after."""
    has = lambda pattern: F.coalesce(F.col("text").rlike(pattern), F.lit(False))

    def looked_up(values, key, said):
        """Questions joined with the few values they may name; each value is looked up once a question."""
        return lambda q: q.join(R.few(values), F.contains("text", key)).select("qid", said)

    segments = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").cast("string").alias("n"))
    totals = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.format_string("%.2f", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")).alias("n"))
    brands = table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_name").alias("n"))
    langs = table(spark, sf, "documents").filter("lang IS NOT NULL").select("lang").distinct()
    owned = lambda q: q.join(R.few(langs), F.contains("text", F.concat(F.lit(" "), "lang", F.lit(" "))), "left").groupBy("qid").agg(F.when(F.count("lang") > 0, "yes").otherwise("no").alias("answer"))
    answer = F.col("n").alias("answer")
    handlers = [
        ("possession", has(r"(?i)\bdo i have\b"), owned),
        ("count", has(r"(?i)\bhow many\b"), looked_up(segments, F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" ")), answer)),
        ("money", has(r"(?i)\b(total|amount)\b"), looked_up(totals, F.col("o_orderpriority"), answer)),
        ("list", has(r"(?i)\b(which|list)\b"), looked_up(brands, F.concat("p_brand", F.lit(" ")), answer)),
        ("never", F.lit(False), lambda q: 1 / 0),
    ]
    return A.answer_chain(_questions(spark, sf), handlers)


@query("sink_chunks", """WITH d AS (SELECT doc_id AS doc, CASE WHEN lang = 'de' THEN replace(text, 'e', 'E') ELSE text END AS text FROM documents WHERE length(text) > 0 AND coalesce(lang, '') <> 'fr')
SELECT doc, CAST(i AS INTEGER) AS idx, sha256(substr(text, CAST(i * 850 + 1 AS BIGINT), 1000)) AS h FROM (SELECT doc, text, unnest(range(CAST(greatest(ceil((length(text) - 150) / 850.0), 1) AS BIGINT))) AS i FROM d)""")
def sink_chunks(spark, sf):
    """All documents written, those in German again with each e a capital, those in French again with nothing left."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text", "lang")
    path = shared_path(spark, "chunks")
    cut_up = lambda d: R.windows(d).select("doc", "idx", "text")
    sinks.write_chunks(docs, cut_up(docs), path)
    again = docs.filter("lang IN ('de', 'fr')").withColumn("text", F.when(F.col("lang") == "de", F.replace("text", F.lit("e"), F.lit("E"))))
    sinks.write_chunks(again, cut_up(again), path)
    return spark.read.parquet(path).select("doc", "idx", F.sha2("text", 256).alias("h"))
