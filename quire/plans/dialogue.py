"""Queries over conversations, answers and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import answering as A
from ..operators import usage
from ..session import table
from .registry import query


def _turns(spark, sf):
    return table(spark, sf, "conversations")


def _sq(p):
    return p.replace("'", "''")


@query("ret_route", f"SELECT conv_id, turn, CASE WHEN trim(text) = '' OR regexp_matches(trim(text), '{_sq(A.GREETING)}') OR regexp_matches(text, '{_sq(A.META)}') THEN 'no_retrieval' WHEN regexp_matches(text, '{_sq(A.MULTI)}') THEN 'multi_hop' ELSE 'single_hop' END AS route FROM conversations")
def ret_route(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", A.route(F.col("text")).alias("route"))


@query("qa_followup", f"SELECT conv_id, turn, trim(text) <> '' AND (len(string_split_regex(trim(text), '\\s+')) <= 3 OR regexp_matches(text, '{_sq(A.FOLLOWUP)}')) AS followup FROM conversations")
def qa_followup(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", A.followup(F.col("text")).alias("followup"))


@query("qa_unsupported", f"SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '{_sq(A.DESTRUCTIVE)}')")
def qa_unsupported(spark, sf):
    return _turns(spark, sf).filter(F.col("text").rlike(A.DESTRUCTIVE)).select("conv_id", "turn")


# Questions of many kinds about all parts.
QUESTION = """CASE p_partkey % 12 WHEN 0 THEN 'Compare both ' || p_name WHEN 1 THEN 'list all ' || p_type || ' I have' WHEN 2 THEN 'what is the total of ' || p_name || '?' WHEN 3 THEN 'who is the applicant for ' || p_brand || '?'
 WHEN 4 THEN 'hello!' WHEN 5 THEN 'delete all my ' || p_type WHEN 6 THEN 'what can you do' WHEN 7 THEN 'and the second ' || p_brand || '?' WHEN 8 THEN 'Tell me a story of ' || p_name || ' and seas' WHEN 9 THEN 'how many ' || p_type || ' documents' WHEN 10 THEN 'difference between ' || p_brand || ' and ' || p_name ELSE '' END"""
_Q = f"(SELECT p_partkey, {QUESTION} AS q FROM part) t"


def _asked(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey", f"{QUESTION} AS q")


@query("qa_fragments", f"SELECT p_partkey, concat_ws('|', CASE WHEN regexp_matches(q, '{_sq(A.COMPARE)}') THEN 'compare' END, CASE WHEN regexp_matches(q, '{_sq(A.OF_KIND)}') THEN 'of_kind' END, CASE WHEN regexp_matches(q, '{_sq(A.SINGLE)}') AND NOT regexp_matches(q, '{_sq(A.COMPARE)}') THEN 'single' END, CASE WHEN regexp_matches(q, '{_sq(A.ATTRIBUTE)}') THEN 'attribute' END) AS picks FROM {_Q}")
def qa_fragments(spark, sf):
    return _asked(spark, sf).select("p_partkey", F.array_join(A.fragments(F.col("q")), "|").alias("picks"))


@query("qa_format", f"SELECT p_partkey, CASE WHEN regexp_matches(q, '{_sq(A.COMPARE)}') THEN 'table' WHEN regexp_matches(q, '{_sq(A.OF_KIND)}') THEN 'filtered-list' WHEN regexp_matches(q, '{_sq(A.SINGLE)}') THEN 'one-line' WHEN regexp_matches(q, '{_sq(A.ATTRIBUTE)}') THEN 'attribute' ELSE 'free' END AS format FROM {_Q}")
def qa_format(spark, sf):
    return _asked(spark, sf).select("p_partkey", A.expected_format(F.col("q")).alias("format"))


@query("qa_route_cases", f"SELECT p_partkey, CASE WHEN trim(q) = '' OR regexp_matches(trim(q), '{_sq(A.GREETING)}') OR regexp_matches(q, '{_sq(A.META)}') THEN 'no_retrieval' WHEN regexp_matches(q, '{_sq(A.MULTI)}') THEN 'multi_hop' ELSE 'single_hop' END AS route, trim(q) <> '' AND (len(string_split_regex(trim(q), '\\s+')) <= 3 OR regexp_matches(q, '{_sq(A.FOLLOWUP)}')) AS followup FROM {_Q}")
def qa_route_cases(spark, sf):
    return _asked(spark, sf).select("p_partkey", A.route(F.col("q")).alias("route"), A.followup(F.col("q")).alias("followup"))


@query("qa_is_abst", "SELECT conv_id, turn, starts_with(ltrim(text), 'INSUFFICIENT_EVIDENCE') AS abstained FROM conversations")
def qa_is_abst(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.ltrim("text").startswith(A.SENTINEL).alias("abstained"))


@query("ev_abst", "SELECT conv_id, turn FROM conversations WHERE " + " OR ".join(f"contains(lower(text), '{_sq(m)}')" for m in A.DECLINES))
def ev_abst(spark, sf):
    return _turns(spark, sf).filter(A.declines(F.col("text"))).select("conv_id", "turn")


@query("qa_abstain", "SELECT source, count(*) AS n, max(n_chars) AS top, count(*) < 3 OR max(n_chars) < 9000 AS abstain FROM documents GROUP BY 1")
def qa_abstain(spark, sf):
    return A.abstain(table(spark, sf, "documents"), "source", "n_chars", min_hits=3, floor=9000)


@query("agg_threads", "SELECT conv_id, count(*) AS n, max(turn) AS last_turn, arg_min(substr(text, 1, 60), turn) FILTER (WHERE role = 'user') AS title FROM conversations GROUP BY 1")
def agg_threads(spark, sf):
    first = F.min_by(F.substring("text", 1, 60), F.when(F.col("role") == "user", F.col("turn")))
    return _turns(spark, sf).groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"), first.alias("title"))


@query("ws_history", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3")
def ws_history(spark, sf):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return _turns(spark, sf).withColumn("k", F.row_number().over(w)).filter("k <= 3").select("conv_id", "turn", "role")


@query("cit_attribute")
def cit_attribute(spark, sf):
    t = _turns(spark, sf)
    answers = t.filter("role = 'assistant'").select(F.concat_ws(":", "conv_id", "turn").alias("answer"), "text")
    passages = t.select(F.concat_ws(":", "conv_id", F.col("turn") + 1).alias("answer"), F.col("turn").alias("passage"), "text")
    return A.attribute(answers, passages)


# Evaluation cases of all documents: what was answered, seen, expected and cited, by the id's remainder.
CASE_SQL = """SELECT doc_id AS id, CAST(CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 END AS DOUBLE) AS faithfulness_proxy, CAST(CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.5 END AS DOUBLE) AS answer_correctness_proxy,
 CAST(CASE doc_id % 4 WHEN 0 THEN 0.5 WHEN 2 THEN 1.0 END AS DOUBLE) AS citation_recall, CASE doc_id % 4 WHEN 0 THEN 'answered' WHEN 1 THEN 'correct_abstain' WHEN 2 THEN 'missed_abstain' ELSE 'over_abstain' END AS abstention FROM documents"""


def _evaluated(spark, sf):
    k, i = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    texts = lambda *x: F.array(*(F.lit(t) if isinstance(t, str) else t for t in x)).cast("array<string>")
    pick = lambda *values: F.coalesce(*(F.when(k == n, v) for n, v in enumerate(values)))
    fee, none = F.concat(F.lit("fee: "), i, F.lit(" USD a month")), texts()
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), pick(F.concat(F.lit("The fee is "), i, F.lit(" USD.")), F.lit("It is not stated."), F.lit("Mara Voss signed"), F.lit("No information found")).alias("answer"),
        pick(texts(fee), texts("nothing here"), texts("signed by Mara Voss on 2 May"), none).alias("contexts"), pick(texts(F.concat(i, F.lit(" USD"))), texts("Alder Quinn"), texts("Mara Voss", "2 May"), none).alias("expected"),
        pick(texts("d1"), none, texts("d3"), none).alias("citations"), pick(texts("d1", "d2"), none, texts("d3"), none).alias("must_cite"), k.isin(1, 2).alias("should_abstain"),
    )


@query("ev_case", CASE_SQL)
def ev_case(spark, sf):
    return A.score_cases(_evaluated(spark, sf)).select("id", "faithfulness_proxy", "answer_correctness_proxy", "citation_recall", "abstention")


@query("agg_eval", f"""SELECT round(avg(faithfulness_proxy), 4) AS faithfulness, round(avg(answer_correctness_proxy), 4) AS correctness, round(avg(citation_recall), 4) AS citation, count(*) FILTER (WHERE abstention = 'correct_abstain') AS correct_abstain,
 count(*) FILTER (WHERE abstention = 'missed_abstain') AS missed_abstain, count(*) FILTER (WHERE abstention = 'over_abstain') AS over_abstain FROM ({CASE_SQL})""")
def agg_eval(spark, sf):
    return A.summary(A.score_cases(_evaluated(spark, sf)))


def _events(spark, sf):
    return table(spark, sf, "events")


@query("st_ratelimit", """
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT event_id, user_id, event_type, k, t AS start, 1 AS n FROM e WHERE k = 1
 UNION ALL SELECT e.event_id, e.user_id, e.event_type, e.k, CASE WHEN e.t >= w.start + 86400 THEN e.t ELSE w.start END, CASE WHEN e.t >= w.start + 86400 THEN 1 ELSE w.n + 1 END
 FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.k = w.k + 1)
SELECT user_id, event_type, event_id, n, n > 2 AS rejected FROM w""")
def st_ratelimit(spark, sf):
    return usage.rate_limit(_events(spark, sf), ["user_id", "event_type"], "ts", 2, 86400)


@query("st_costcap", "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events")
def st_costcap(spark, sf):
    return usage.running_count(_events(spark, sf), ["user_id"], "hour", "ts", "event_id").select("event_id", "n")


@query("st_apirpm", "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def st_apirpm(spark, sf):
    return _events(spark, sf).groupBy("user_id", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n")).filter("n > 1")


@query("st_retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def st_retention(spark, sf):
    return usage.trailing(_events(spark, sf).select("event_id", "ts"), "ts", 10).select("event_id")


@query("st_7d", "SELECT event_type, count(*) AS n, round(100.0 * count(*) FILTER (WHERE value < 10) / count(*), 1) AS pct FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def st_7d(spark, sf):
    e = usage.trailing(_events(spark, sf), "ts", 7)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("value") < 10) / F.count("*"), 1).alias("pct"))


@query("agg_cache_paths", "WITH g AS (SELECT event_type AS path, count(*) AS n FROM events GROUP BY 1) SELECT path, n, round(100.0 * n / sum(n) OVER (), 1) AS pct FROM g")
def agg_cache_paths(spark, sf):
    g = _events(spark, sf).groupBy(F.col("event_type").alias("path")).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


@query("agg_activity", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg_activity(spark, sf):
    return _events(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("agg_rollup_read", "SELECT CAST(ts AS DATE) AS day, event_type AS label, user_id AS user, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY GROUPING SETS ((CAST(ts AS DATE), event_type), (CAST(ts AS DATE), event_type, user_id))")
def agg_rollup_read(spark, sf):
    e = _events(spark, sf).withColumn("v", F.col("value").cast("decimal(18,4)"))
    return usage.rollup(e, F.to_date("ts"), "event_type", "user_id", "v").withColumn("total", F.col("total").cast("double"))


@query("agg_usage_month", "SELECT user_id, count(*) AS n FROM events WHERE ts >= date_trunc('month', (SELECT max(ts) FROM events)) GROUP BY 1")
def agg_usage_month(spark, sf):
    e = _events(spark, sf).select("user_id", "ts")
    start = e.agg(F.date_trunc("month", F.max("ts")).alias("start"))
    return e.join(F.broadcast(start)).filter("ts >= start").groupBy("user_id").agg(F.count("*").alias("n"))


@query("agg_having_reprocess", "SELECT user_id, count(*) AS kinds FROM (SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING count(*) > 10) GROUP BY 1")
def agg_having_reprocess(spark, sf):
    return _events(spark, sf).groupBy("user_id", "event_type").count().filter("count > 10").groupBy("user_id").agg(F.count("*").alias("kinds"))


@query("st_monthcap", "SELECT user_id, date_trunc('month', ts) AS month, count(*) AS used, count(*) >= 60 AS capped FROM events GROUP BY 1, 2")
def st_monthcap(spark, sf):
    return _events(spark, sf).groupBy("user_id", F.date_trunc("month", "ts").alias("month")).agg(F.count("*").alias("used"), (F.count("*") >= 60).alias("capped"))


@query("st_reaper", "SELECT event_id FROM events WHERE event_type = 'view' AND ts < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE")
def st_reaper(spark, sf):
    e = _events(spark, sf).select("event_id", "event_type", "ts")
    latest = e.agg(F.max("ts").alias("latest"))
    return e.join(F.broadcast(latest)).filter("event_type = 'view' AND ts < latest - INTERVAL 30 MINUTES").select("event_id")


@query("mt_cost", "SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN 0.5 * (user_id + event_id) / 1e6 ELSE (user_id * 0.25 + event_id * 1.25) / 1e6 END, 9) AS cost FROM events")
def mt_cost(spark, sf):
    price = lambda x: F.when(F.col("event_id") % 3 != 0, x)
    return _events(spark, sf).select("event_id", F.round(usage.cost(F.col("user_id"), F.col("event_id"), price(0.25), price(1.25), F.lit(0.5)), 9).alias("cost"))


@query("fn_status3", "SELECT event_id, CASE WHEN value BETWEEN 10 AND 50 THEN 'Normal' WHEN value BETWEEN 8.5 AND 57.5 THEN 'Borderline' ELSE 'Abnormal' END AS status FROM events")
def fn_status3(spark, sf):
    v = F.col("value")
    return _events(spark, sf).select("event_id", F.when(v.between(10, 50), "Normal").when(v.between(8.5, 57.5), "Borderline").otherwise("Abnormal").alias("status"))


@query("win_latest_point", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS latest, count(*) AS points FROM events GROUP BY 1, 2 HAVING count(*) >= 2")
def win_latest_point(spark, sf):
    last = F.max(F.struct("ts", "event_id", "value"))["value"]
    return _events(spark, sf).groupBy("user_id", "event_type").agg(last.alias("latest"), F.count("*").alias("points")).filter("points >= 2")


@query("fn_classify_value", "SELECT event_id, CASE WHEN lower(k) IN ('true', 'false', 'yes', 'no') THEN 'boolean' WHEN regexp_full_match(k, '-?[0-9]+(\\.[0-9]+)?') THEN 'number' ELSE 'string' END AS kind FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)")
def fn_classify_value(spark, sf):
    k = F.get_json_object("props", "$.k")
    return _events(spark, sf).select("event_id", F.when(F.lower(k).isin("true", "false", "yes", "no"), "boolean").when(k.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number").otherwise("string").alias("kind"))


@query("agg_feedback_updown", "SELECT quality, count(*) FILTER (WHERE toxic = 0) AS up, count(*) FILTER (WHERE toxic = 1) AS down FROM labels GROUP BY 1")
def agg_feedback_updown(spark, sf):
    return table(spark, sf, "labels").groupBy("quality").agg(F.count_if(F.col("toxic") == 0).alias("up"), F.count_if(F.col("toxic") == 1).alias("down"))


@query("agg_overview", "SELECT lang, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, lang LIMIT 20")
def agg_overview(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(20)


@query("agg_dashboard", "SELECT lang, source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 3) AS mean_chars FROM documents GROUP BY 1, 2")
def agg_dashboard(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 3).alias("mean_chars"))
