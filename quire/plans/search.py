"""Queries over embeddings, chunks and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..session import table
from .registry import query


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("vid"), F.col("embedding").alias("vec"), "label")


@query("vec_cosine_topk", """
WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS vid, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS sim FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vid) AS rank FROM s) SELECT qid, vid, sim, rank FROM r WHERE rank <= 10""")
def vec_cosine_topk(spark, sf):
    v = _vectors(spark, sf)
    return R.cosine_topk(v.filter("vid % 50 = 0").select(F.col("vid").alias("qid"), "vec"), v, 10)


@query("vec_cosine_py", "SELECT a.vec_id AS vid, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec_cosine_py(spark, sf):
    v = _vectors(spark, sf)
    n = v.select((F.col("vid") - 1).alias("vid"), F.col("vec").alias("other"))
    return v.join(n, "vid").select("vid", F.round(R.cosine(F.col("vec"), F.col("other")), 6).alias("sim"))


@query("vec_centroid_update", """
WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT label, i AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean, count(*) AS n FROM x GROUP BY 1, 2""")
def vec_centroid_update(spark, sf):
    c = R.centroids(_vectors(spark, sf)).select("label", "n", F.posexplode("vec").alias("pos", "x"))
    return c.select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("mean"), "n")


CENTROID = """WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM x GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS vec FROM m GROUP BY 1),
s AS (SELECT vec_id AS vid, c.label AS nearest, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), vec), 6) AS sim FROM embeddings, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY sim DESC, nearest) AS rank FROM s) """


@query("vec_centroid_match", CENTROID + "SELECT vid, nearest, sim FROM r WHERE rank = 1 AND sim >= 0.2")
def vec_centroid_match(spark, sf):
    v = _vectors(spark, sf)
    c = R.few(R.centroids(v).select(F.col("label").alias("nearest"), F.col("vec").alias("cv")))
    sims = v.crossJoin(c).select("vid", "nearest", F.round(R.cosine(F.col("vec"), F.col("cv")), 6).alias("sim"))
    return R.top(sims, ["vid"], [F.desc("sim"), F.asc("nearest")], 1).filter("sim >= 0.2").select("vid", "nearest", "sim")


@query("vec_candidates", CENTROID + "SELECT vid, sim FROM s WHERE nearest = 0 AND sim >= 0.3")
def vec_candidates(spark, sf):
    v = _vectors(spark, sf)
    c = R.few(R.centroids(v.filter("label = 0")).select(F.col("vec").alias("cv")))
    return v.crossJoin(c).select("vid", F.round(R.cosine(F.col("vec"), F.col("cv")), 6).alias("sim")).filter("sim >= 0.3")


@query("vec_coerce", "SELECT vec_id AS vid, len(list_resize(embedding, 80, 0)) AS long_dim, len(embedding[1:32]) AS short_dim, round(list_sum(CAST(embedding[1:32] AS DOUBLE[])), 4) AS total FROM embeddings")
def vec_coerce(spark, sf):
    short = R.coerce(F.col("vec"), 32)
    return _vectors(spark, sf).select("vid", F.size(R.coerce(F.col("vec"), 80)).cast("long").alias("long_dim"), F.size(short).cast("long").alias("short_dim"), F.round(F.aggregate(short, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("vec_tokenize", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS n FROM documents")
def vec_tokenize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(R.words(F.col("text"))).cast("long").alias("n"))


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")


BM25 = """
d AS (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS w FROM documents),
p AS (SELECT doc, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc, len(w) AS len, unnest(w) AS term FROM d) GROUP BY 1, 2),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), dfs AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM benchmark),
h AS (SELECT qid, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM q JOIN p USING (term) JOIN dfs USING (term), st GROUP BY 1, 2),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM h) WHERE rank <= 20)"""


def _grams(c):
    return f"list_distinct(flatten(list_transform(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("ret_lexical", f"""WITH {BM25}, dg AS (SELECT doc_id AS doc, {_grams('text')} AS g FROM documents), qg AS (SELECT item_id AS qid, {_grams('text')} AS g FROM benchmark),
sh AS (SELECT qid, doc, count(*) AS n FROM (SELECT doc, unnest(g) AS t FROM dg) JOIN (SELECT qid, unnest(g) AS t FROM qg) USING (t) GROUP BY 1, 2),
s AS (SELECT qg.qid, dg.doc, round(coalesce(h.score, 0) + coalesce(sh.n / greatest(len(dg.g) + len(qg.g) - sh.n, 1), 0), 6) AS score
 FROM qg CROSS JOIN dg LEFT JOIN h ON h.qid = qg.qid AND h.doc = dg.doc LEFT JOIN sh ON sh.qid = qg.qid AND sh.doc = dg.doc)
SELECT qid, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 20""")
def ret_lexical(spark, sf):
    """The 20 best documents of each benchmark item by BM25 and trigrams, documents without a common word included."""
    return R.lexical(_queries(spark, sf), _docs(spark, sf), 20)


def _vector_ranks(spark, sf):
    """A second ranking of documents: embeddings stand in, document and query by their ids."""
    v = _vectors(spark, sf)
    hits = R.cosine_topk(v.join(_queries(spark, sf).select(F.col("qid").alias("vid")), "vid", "left_semi").select(F.col("vid").alias("qid"), "vec"), v, 20)
    return hits.select("qid", F.col("vid").alias("doc"), "rank")


VEC = """c AS (SELECT q.vec_id AS qid, v.vec_id AS doc, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS sim FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
cos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, doc) AS rank FROM c) WHERE rank <= 20)"""
RRF = f"""WITH {BM25}, {VEC}, f AS (SELECT coalesce(l.qid, c.qid) AS qid, coalesce(l.doc, c.doc) AS doc, l.rank AS lex_rank, c.rank AS cos_rank,
 round(coalesce(1.0 / (60 + l.rank), 0.0) + coalesce(1.0 / (60 + c.rank), 0.0), 8) AS score FROM lex l FULL JOIN cos c ON l.qid = c.qid AND l.doc = c.doc)"""


@query("ret_rrf", RRF + " SELECT qid, doc, lex_rank, cos_rank, score FROM f")
def ret_rrf(spark, sf):
    return R.rrf(R.bm25(_queries(spark, sf), _docs(spark, sf), 20), _vector_ranks(spark, sf)).select("qid", "doc", "lex_rank", "cos_rank", "score")


@query("ret_retrieve", RRF + ", r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, lex_rank NULLS LAST, cos_rank NULLS LAST, doc) AS rank FROM f) SELECT qid, doc, score, rank FROM r WHERE rank <= 12")
def ret_retrieve(spark, sf):
    fused = R.rrf(R.bm25(_queries(spark, sf), _docs(spark, sf), 20), _vector_ranks(spark, sf))
    return R.fused_top(fused, 12).select("qid", "doc", "score", "rank")


@query("ret_trgm", """
WITH t AS (SELECT s_suppkey, list_distinct(flatten(list_transform(regexp_extract_all(lower(s_name), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM supplier)
SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(len(list_intersect(a.g, b.g)) * 1.0 / len(list_distinct(list_concat(a.g, b.g))), 4) AS sim FROM t a JOIN t b ON a.s_suppkey % 50 = 0 AND a.s_suppkey <> b.s_suppkey""")
def ret_trgm(spark, sf):
    """Names of every fiftieth supplier against all others."""
    # Each name is taken apart once, not once a pair, and the small table is dealt to all cores for its many pairs.
    s = table(spark, sf, "supplier").repartition(4 * spark.sparkContext.defaultParallelism).select(F.col("s_suppkey").alias("b"), R.trigrams(F.col("s_name")).alias("gb"))
    a = R.few(s.filter("b % 50 = 0").select(F.col("b").alias("a"), F.col("gb").alias("ga")))
    shared = F.size(F.array_intersect("ga", "gb"))
    return s.join(a, F.col("a") != F.col("b")).select("a", "b", shared.alias("n"), (F.size("ga") + F.size("gb")).alias("both")).select("a", "b", F.round(F.col("n") / F.greatest(F.col("both") - F.col("n"), F.lit(1)), 4).alias("sim"))


@query("ret_recency", "SELECT o_orderkey, round(0.5 + 0.5 * pow(0.5, greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01'), 0) / 180.0), 6) AS factor FROM orders")
def ret_recency(spark, sf):
    age = F.datediff(F.lit("1999-01-01"), F.to_date("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(R.recency(age), 6).alias("factor"))


@query("ret_feedback", "WITH n AS (SELECT doc_id, sum(CASE WHEN quality = 1 THEN 1 ELSE -1 END) AS net FROM labels GROUP BY 1) SELECT doc_id, round(1 + 0.15 * tanh(net / 3.0), 6) AS factor FROM n")
def ret_feedback(spark, sf):
    n = table(spark, sf, "labels").groupBy("doc_id").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(-1)).alias("net"))
    return n.select("doc_id", F.round(R.feedback(F.col("net")), 6).alias("factor"))


@query("ret_sigmoid", "SELECT event_id, round(1 / (1 + exp(-greatest(-30, least(30, value)))), 6) AS p FROM events")
def ret_sigmoid(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(R.sigmoid(F.col("value")), 6).alias("p"))


CHUNKS = "c AS (SELECT doc_id AS doc, idx, idx * 850 AS start, substr(text, idx * 850 + 1, 1000) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 150) / 850.0) AS BIGINT), 1))) AS idx FROM documents WHERE length(text) > 0))"


@query("chk_window", f"WITH {CHUNKS} SELECT doc, idx, start, length(text) AS len, sha256(text) AS h FROM c")
def chk_window(spark, sf):
    return R.windows(_docs(spark, sf)).select("doc", "idx", "start", F.length("text").alias("len"), F.sha2("text", 256).alias("h"))


@query("ret_expand", f"WITH {CHUNKS} SELECT a.doc, a.idx, sha256(substr(string_agg(b.text, chr(10) || chr(10) ORDER BY b.idx), 1, 2400)) AS h FROM c a JOIN c b ON a.doc = b.doc AND b.idx BETWEEN a.idx - 1 AND a.idx + 1 GROUP BY 1, 2")
def ret_expand(spark, sf):
    chunks = R.windows(_docs(spark, sf))
    return R.expand(chunks.select("doc", "idx"), chunks).select("doc", "idx", F.sha2("text", 256).alias("h"))


@query("agg_chunk_stats", f"WITH {CHUNKS} SELECT doc, count(*) AS n, count(*) FILTER (WHERE length(text) < 1000) AS short, round(avg(length(text)), 2) AS mean_len, min(length(text)) AS min_len, max(length(text)) AS max_len FROM c GROUP BY 1")
def agg_chunk_stats(spark, sf):
    n = F.length("text")
    return R.windows(_docs(spark, sf)).groupBy("doc").agg(F.count("*").alias("n"), F.count_if(n < 1000).alias("short"), F.round(F.avg(n), 2).alias("mean_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"))


@query("ret_fairness", """
WITH tok AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM benchmark), w AS (SELECT doc_id AS doc, source, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) AS term FROM documents),
s AS (SELECT qid, source, doc, count(*) AS shared FROM tok JOIN w USING (term) GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY shared DESC, doc) AS k FROM s) SELECT qid, source, doc, shared FROM r WHERE k = 1""")
def ret_fairness(spark, sf):
    pick = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{2,}"), F.lit(0)))
    asked, docs = _queries(spark, sf), table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "source", "text")
    terms = asked.select("qid", F.explode(pick(F.col("text"))).alias("term"))
    held = docs.select("doc", "source", F.explode(pick(F.col("text"))).alias("term")).join(R.few(terms.select("term").distinct(), 200_000), "term", "left_semi")
    shared = R.by_document(held, docs, asked).join(R.few(terms, 200_000), "term").groupBy("qid", "source", "doc").agg(F.count("*").alias("shared"))
    return R.top(shared, ["qid", "source"], [F.desc("shared"), F.asc("doc")], 1).select("qid", "source", "doc", "shared")


@query("win_distinct_on", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1")
def win_distinct_on(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return R.top(d, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 1).drop("rank")


@query("win_rank_lists", f"WITH {BM25} SELECT doc, min(rank) AS best, count(*) AS lists FROM lex GROUP BY 1")
def win_rank_lists(spark, sf):
    return R.bm25(_queries(spark, sf), _docs(spark, sf), 20).groupBy("doc").agg(F.min("rank").alias("best"), F.count("*").alias("lists"))


@query("sink_metrics", "SELECT item_id, substr(md5(lower(text)), 1, 16) AS query_hash FROM benchmark")
def sink_metrics(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.substring(F.md5(F.lower("text")), 1, 16).alias("query_hash"))
