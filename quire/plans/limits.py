"""Queries over usage caps, plans, chunk versions and small text forms."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import retrieval as R
from ..operators import search as S
from ..operators import usage
from ..session import table
from .registry import query


@query("st_free_hour", """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT event_id, user_id, k, t AS start, 1 AS n FROM e WHERE k = 1
 UNION ALL SELECT e.event_id, e.user_id, e.k, CASE WHEN e.t >= w.start + 3600 THEN e.t ELSE w.start END, CASE WHEN e.t >= w.start + 3600 THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id, event_id, n, n > 1 AS rejected FROM w""")
def st_free_hour(spark, sf):
    return usage.rate_limit(table(spark, sf, "events"), ["user_id"], "ts", 1, 3600)


PLANS = "(VALUES (0, 'free', 20), (1, 'pro', 70), (2, 'team', NULL)) t(slot, plan, cap)"


@query("mt_usage", f"WITH u AS (SELECT user_id, count(*) AS used FROM events GROUP BY 1) SELECT user_id, plan, used, cap, coalesce(used >= cap, false) AS over FROM u JOIN (SELECT * FROM {PLANS}) ON user_id % 3 = slot")
def mt_usage(spark, sf):
    used = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("used"))
    plans = F.broadcast(spark.sql(f"SELECT * FROM {PLANS}"))
    return used.join(plans, F.col("user_id") % 3 == F.col("slot")).select("user_id", "plan", "used", "cap", F.coalesce(F.col("used") >= F.col("cap"), F.lit(False)).alias("over"))


@query("st_trial", "SELECT o_custkey, CASE WHEN max(o_orderdate) >= TIMESTAMP '1998-06-01' THEN 'paid' WHEN min(o_orderdate) >= TIMESTAMP '1997-06-01' THEN 'trial' ELSE 'expired' END AS state FROM orders GROUP BY 1")
def st_trial(spark, sf):
    at = lambda s: F.lit(s).cast("timestamp")
    state = F.when(F.max("o_orderdate") >= at("1998-06-01"), "paid").when(F.min("o_orderdate") >= at("1997-06-01"), "trial").otherwise("expired")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(state.alias("state"))


@query("chk_blocks", r"SELECT page_id, len(list_filter(list_transform(string_split_regex(html, '\n[ \t]*\n+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')) AS n FROM pages")
def chk_blocks(spark, sf):
    parts = F.filter(F.transform(F.split("html", r"\n[ \t]*\n+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return table(spark, sf, "pages").select("page_id", F.size(parts).cast("long").alias("n"))


@query("txt_ctx_prefix", "SELECT doc_id, sha256(CASE WHEN source = 'src1' THEN text ELSE source || chr(10) || chr(10) || text END) AS h FROM documents")
def txt_ctx_prefix(spark, sf):
    context = F.when(F.col("source") != "src1", F.col("source"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.concat_ws("\n\n", context, "text"), 256).alias("h"))


@query("fn_md_table", "SELECT '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, '|', '\\|') || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation")
def fn_md_table(spark, sf):
    row = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), F.replace("n_name", F.lit("|"), F.lit("\\|")), F.lit(" |"))
    rows = table(spark, sf, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))).alias("p"))
    return rows.select(F.concat(F.lit("| key | name |\n| --- | --- |\n"), F.array_join(F.transform("p", lambda x: x["r"]), "\n")).alias("md"))


_STOP = ", ".join(f"'{w}'" for w in S.NAME_STOP)


@query("ret_docname", rf"""WITH q AS (SELECT DISTINCT item_id AS qid, t FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9\-]{{3,}}')) AS t FROM benchmark)
 WHERE (regexp_matches(t, '[0-9]') OR (upper(t) = t AND regexp_matches(t, '[A-Z]')) OR length(t) >= 5) AND lower(t) NOT IN ({_STOP})),
h AS (SELECT DISTINCT qid, page_id FROM q JOIN pages ON contains(lower(url), lower(t))), n AS (SELECT qid, count(*) AS n FROM h GROUP BY 1) SELECT qid, page_id FROM h JOIN n USING (qid) WHERE n <= 4""")
def ret_docname(spark, sf):
    """Pages whose address holds a distinctive word of the question; more than four matches rescue nothing."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.explode(S.distinctive(F.col("text"))).alias("pid"))
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("tid"), F.col("url").alias("text"))
    met = S.containing(asked.select("pid", F.col("pid").alias("pattern")), pages).join(asked, "pid")
    hits = met.select("qid", F.col("tid").alias("page_id")).distinct()
    few = hits.groupBy("qid").count().filter("count <= 4").select("qid")
    return hits.join(few, "qid", "left_semi")


@query("ret_stale", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AND n_chars > 0")
def ret_stale(spark, sf):
    """Documents with a chunk below the current version; the quality label stands in for the version."""
    chunks = R.windows(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")).select(F.col("doc").alias("doc_id"))
    old = table(spark, sf, "labels").filter("quality = 0").select("doc_id")
    return chunks.distinct().join(old, "doc_id", "left_semi")


@query("agg_edit_counts", "SELECT user_id, count(*) AS edits FROM events WHERE event_type = 'click' GROUP BY 1")
def agg_edit_counts(spark, sf):
    return table(spark, sf, "events").filter("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("edits"))


@query("lt_reconcile", """WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label > 0), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM x GROUP BY 1, 2),
c AS (SELECT label, list(x ORDER BY i) AS vec FROM m GROUP BY 1), s AS (SELECT vec_id AS vid, c.label AS nearest, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), vec), 6) AS sim FROM embeddings, c WHERE embeddings.label = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY sim DESC, nearest) AS k FROM s) SELECT vid, CASE WHEN sim >= 0.1 THEN nearest END AS assigned FROM r WHERE k = 1""")
def lt_reconcile(spark, sf):
    """Weakly typed items (label 0) take the type of the nearest centroid when it is near enough."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("vid"), F.col("embedding").alias("vec"), "label")
    c = R.few(R.centroids(v.filter("label > 0")).select(F.col("label").alias("nearest"), F.col("vec").alias("cv")))
    sims = v.filter("label = 0").crossJoin(c).select("vid", "nearest", F.round(R.cosine(F.col("vec"), F.col("cv")), 6).alias("sim"))
    best = R.top(sims, ["vid"], [F.desc("sim"), F.asc("nearest")], 1)
    return best.select("vid", F.when(F.col("sim") >= 0.1, F.col("nearest")).alias("assigned"))


@query("ls_hint", "SELECT event_type, array_to_string(list_slice(list(k ORDER BY n DESC, k), 1, 24), '|') AS hint FROM (SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def ls_hint(spark, sf):
    n = table(spark, sf, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))
    top = n.withColumn("rank", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "k"))).filter("rank <= 24")
    return top.groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "k"))), lambda x: x["k"]), "|").alias("hint"))


@query("ret_artifact_fallback", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
s AS (SELECT doc_id, i, line, len(list_intersect(list_distinct(regexp_extract_all(lower(line), '[a-z0-9]{2,}')), ['license', 'under', 'version'])) AS score FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS k FROM s WHERE score > 0) SELECT doc_id, CAST(score AS BIGINT) AS score, substr(line, 1, 80) AS line FROM r WHERE k <= 3""")
def ret_artifact_fallback(spark, sf):
    """Best lines of each document for a question, by the number of its words they hold."""
    asked = F.array(*map(F.lit, ("license", "under", "version")))
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    scored = lines.withColumn("score", F.size(F.array_intersect(R.words(F.col("line")), asked)).cast("long")).filter("score > 0")
    return R.top(scored, ["doc_id"], [F.desc("score"), F.asc("i")], 3).select("doc_id", "score", F.substring("line", 1, 80).alias("line"))
