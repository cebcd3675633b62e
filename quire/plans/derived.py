"""Queries over per-document operators and small rule ladders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import documents as D
from ..operators import records as X
from ..session import small_batches, table
from ..sources import readers
from .registry import query


def _docs(spark, sf):
    """All documents, handed to Python in small batches."""
    small_batches(spark)
    return table(spark, sf, "documents")


def _v(spark, values):
    return spark.sql(f"SELECT * FROM {values}")


@query("txt_nfkc", "SELECT doc_id, sha256(nfc_normalize(text)) AS h FROM documents WHERE text = nfc_normalize(text)")
def txt_nfkc(spark, sf):
    same = D.normalise(_docs(spark, sf), "doc_id", "text")
    return same.select("doc_id", F.sha2("text", 256).alias("h"))


@query("pii_redact")
def pii_redact(spark, sf):
    out = D.redact(_docs(spark, sf), "doc_id", "text")
    return out.select("doc_id", "text", F.to_json("counts").alias("counts"), F.size("mapping").alias("n_values"))


@query("pii_vault", r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b\d{3}-\d{2}-\d{4}\b'))) AS value FROM documents")
def pii_vault(spark, sf):
    out = D.redact(_docs(spark, sf), "doc_id", "text", kinds={"ssn"})
    key = F.lit("0123456789abcdef")
    vault = out.select("doc_id", F.explode("mapping").alias("token", "value")).select("doc_id", "token", F.aes_encrypt("value", key).alias("cipher"))
    return vault.select("doc_id", F.try_aes_decrypt("cipher", key).cast("string").alias("value"))


@query("pii_detokenize", "SELECT doc_id, sha256(text) AS h FROM documents")
def pii_detokenize(spark, sf):
    out = D.redact(_docs(spark, sf), "doc_id", "text")
    entries = F.transform(F.map_entries("mapping"), lambda e: F.struct((-F.length(e["key"])).alias("o"), e["key"].alias("k"), e["value"].alias("v")))
    back = F.aggregate(F.array_sort(entries), F.col("text"), lambda t, e: F.replace(t, e["k"], e["v"]))
    return out.select("doc_id", F.sha2(back, 256).alias("h"))


@query("vec_hash_embed")
def vec_hash_embed(spark, sf):
    return D.embed(_docs(spark, sf), "doc_id", "text", 64)


@query("chk_doc_pages")
def chk_doc_pages(spark, sf):
    return D.chunks(_docs(spark, sf), "doc_id", "text")


#: White space as Python has it; all of a block's is one blank.
_BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query("chk_page", rf"""WITH b AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n[ \t]*\n+'), lambda x: CAST(length(trim(regexp_replace(x, '{_BLANKS}', ' ', 'g'), ' ')) AS BIGINT)), lambda n: n > 0) AS n FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_reduce(n, lambda a, n: CASE
 WHEN n > 1000 THEN {{'at': a.at + n + 1, 'first': -1::BIGINT, 'last': -1::BIGINT, 'upto': -1::BIGINT, 'out': a.out || CASE WHEN a.first >= 0 THEN [{{'s': a.first, 'e': a.upto}}] ELSE [] END
  || list_transform(range(greatest(CAST(ceil((n - 1000) / 850.0) AS BIGINT), 0) + 1), lambda k: {{'s': a.at + 850 * k, 'e': a.at + least(850 * k + 1000, n)}})}}
 WHEN a.first >= 0 AND a.upto - a.first + 1 + n > 1000 THEN {{'at': a.at + n + 1, 'first': CASE WHEN a.upto - a.last <= 150 AND a.upto - a.last + 1 + n <= 1000 THEN a.last ELSE a.at END, 'last': a.at, 'upto': a.at + n, 'out': a.out || [{{'s': a.first, 'e': a.upto}}]}}
 ELSE {{'at': a.at + n + 1, 'first': CASE WHEN a.first >= 0 THEN a.first ELSE a.at END, 'last': a.at, 'upto': a.at + n, 'out': a.out}} END,
 {{'at': 0::BIGINT, 'first': -1::BIGINT, 'last': -1::BIGINT, 'upto': -1::BIGINT, 'out': CAST([] AS STRUCT(s BIGINT, e BIGINT)[])}}) AS a FROM b),
c AS (SELECT doc_id, a.out || CASE WHEN a.first >= 0 THEN [{{'s': a.first, 'e': a.upto}}] ELSE [] END AS c FROM f)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, CAST(c[i].s AS INTEGER) AS start, CAST(c[i].e AS INTEGER) AS end FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM c)""")
def chk_page(spark, sf):
    """The chunks of all texts, as they are: whole blocks up to 1,000 characters, longer ones in windows."""
    return D.chunks(_docs(spark, sf), "doc_id", "text", threshold=None, normal=False).select("doc_id", "idx", "start", "end")


@query("dup_greedy")
def dup_greedy(spark, sf):
    kept = D.chunks(_docs(spark, sf), "doc_id", "text", target=300, overlap=0, threshold=0.9)
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("src_markdown_ir")
def src_markdown_ir(spark, sf):
    return readers.blocks(_docs(spark, sf), "doc_id", "text")


@query("txt_toc", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
h AS (SELECT doc_id, i, substr(trim(regexp_extract(line, '(?i)^\s*([A-Z][A-Z\s/&]{5,80}?)\s*$', 1)), 1, 120) AS title FROM l WHERE i <= 2000 AND regexp_matches(line, '(?i)^\s*([A-Z][A-Z\s/&]{5,80}?)\s*$')),
f AS (SELECT doc_id, arg_min(title, i) AS title, min(i) AS i FROM h WHERE length(title) >= 5 GROUP BY doc_id, lower(title)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f) SELECT doc_id, k, title FROM r WHERE k <= 40""")
def txt_toc(spark, sf):
    rx = r"(?i)^\s*([A-Z][A-Z\s/&]{5,80}?)\s*$"
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).filter((F.col("i") < 2000) & F.col("line").rlike(rx))
    titled = lines.select("doc_id", "i", F.substring(F.trim(F.regexp_extract("line", rx, 1)), 1, 120).alias("title")).filter(F.length("title") >= 5)
    first = titled.groupBy("doc_id", F.lower("title").alias("l")).agg(F.min(F.struct("i", "title")).alias("x")).select("doc_id", "x.*")
    return first.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))).filter("k <= 40").select("doc_id", F.col("k").cast("long").alias("k"), "title")


#: How many characters of a script a text holds; in the ranges that the library counts.
_held = lambda c, span: f"length(regexp_replace({c}, '[^{span}]', '', 'g'))"
_COUNTS = "[" + ", ".join(_held("s", span) for span in T.SCRIPTS.values()) + "]"


@query("fn_mixed_script", f"""WITH two AS (SELECT doc_id, unnest([{{'part': 0, 's': text}}, {{'part': 1, 's': text || repeat('д', CAST(length(text) // 12 AS INTEGER)) || repeat('漢', CAST(length(text) // 30 AS INTEGER))}}], recursive := true) FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
c AS (SELECT doc_id, part, {_COUNTS} AS n FROM two) SELECT doc_id, part, len(list_filter(n, lambda x: list_sum(n) > 0 AND x / greatest(list_sum(n), 1) >= 0.1)) >= 2 AS mixed FROM c""")
def fn_mixed_script(spark, sf):
    """All whole texts as they are, and with a twelfth of Cyrillic and a thirtieth of Han behind them."""
    text, n = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))
    more = F.concat(text, F.repeat(F.lit("д"), F.floor(n / 12).cast("int")), F.repeat(F.lit("漢"), F.floor(n / 30).cast("int")))
    return _docs(spark, sf).select("doc_id", F.posexplode(F.array(text, more)).alias("part", "s")).select("doc_id", "part", T.mixed_script(F.col("s")).alias("mixed"))


@query("fn_best_transcript")
def fn_best_transcript(spark, sf):
    """The cleanest of each source's texts by page quality, the smallest id among equals."""
    d = _docs(spark, sf).select("source", "doc_id", T.page_quality(F.col("text"))["score"].alias("score"))
    return d.groupBy("source").agg(F.max("score").alias("score"), F.max(F.struct("score", (-F.col("doc_id")).alias("k")))["k"].alias("k")).select("source", "score", (-F.col("k")).alias("doc_id"))


@query("sink_markdown", "SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY 1")
def sink_markdown(spark, sf):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    joined = table(spark, sf, "conversations").groupBy("conv_id").agg(parts.alias("p"))
    return joined.select("conv_id", F.sha2(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"), 256).alias("h"))


@query("sink_strip_empty_rows", r"SELECT p_partkey, '| ' || p_name || ' | ' || p_size || ' |' || chr(10) || '| --- | --- |' || CASE WHEN p_partkey % 3 = 2 THEN chr(10) || '| 1 |  |' ELSE '' END AS cleaned FROM part")
def sink_strip_empty_rows(spark, sf):
    last = F.when(F.col("p_partkey") % 3 == 2, F.lit("\n| 1 |  |")).when(F.col("p_partkey") % 3 == 1, F.lit("\n|   |  |\n||  |")).otherwise("")
    v = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("| "), "p_name", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |\n| --- | --- |\n|  |  |"), last).alias("s"))
    return v.select("p_partkey", T.strip_empty_rows(F.col("s")).alias("cleaned"))


@query("win_islands", """WITH r AS (SELECT *, sum(CASE WHEN role = 'user' AND turn % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations)
SELECT conv_id AS doc, min(turn) AS first, max(turn) AS last, count(*) AS pages FROM r GROUP BY conv_id, run""")
def win_islands(spark, sf):
    """Turns stand in for pages; every third turn, where the user speaks, starts a part."""
    v = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), ((F.col("role") == "user") & (F.col("turn") % 3 == 0)).alias("starts"))
    return readers.segments(v, "doc", "page", F.col("starts"))


@query("src_sniff", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/gzip' END AS kind FROM documents")
def src_sniff(spark, sf):
    """All texts as bytes, three quarters of them behind the first bytes of a known type."""
    head = F.when(F.col("doc_id") % 4 == 0, F.lit(bytearray(b"%PDF-1.7"))).when(F.col("doc_id") % 4 == 1, F.lit(bytearray(b"\x89PNG\r\n\x1a\n"))).when(F.col("doc_id") % 4 == 2, F.lit(bytearray(b"\x1f\x8b\x08"))).otherwise(F.lit(bytearray(b" ")))
    return _docs(spark, sf).select("doc_id", readers.sniff(F.concat(head, F.encode("text", "UTF-8"))).alias("kind"))


@query("q_kind_expected", """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'email' WHEN 1 THEN 'date' WHEN 2 THEN 'percent' WHEN 3 THEN 'money' WHEN 5 THEN 'money' WHEN 6 THEN 'date' END AS kind FROM part""")
def q_kind_expected(spark, sf):
    stem = F.element_at(F.array(*map(F.lit, ("vendor_email_", "due_date_", "interest_rate_", "total_", "holder_", "fee_", "Valid_Until_"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", X.kind_expected(F.concat(stem, "p_size")).alias("kind"))


@query("val_balance", """WITH t AS (SELECT l_orderkey AS id, sum(CAST(CASE l_returnflag WHEN 'R' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2))) AS net FROM lineitem GROUP BY 1),
 b AS (SELECT id, 100 + CAST(net AS DOUBLE) AS expected, CASE WHEN id % 3 = 0 THEN 2 * (100 + CAST(net AS DOUBLE)) + 50 ELSE 100 + CAST(net AS DOUBLE) + 0.5 END AS closing FROM t)
SELECT id, round(expected, 2) AS expected, abs(expected - closing) <= greatest(abs(closing) * 0.01, 1.0) AS ok FROM b""")
def val_balance(spark, sf):
    """Lines of an order as transactions, returned ones going out; every third closing balance is off."""
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    net = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(F.when(F.col("l_returnflag") == "R", -amount).otherwise(amount)).cast("double").alias("net"))
    off = F.when(F.col("id") % 3 == 0, 2 * (100 + F.col("net")) + 50).otherwise(100 + F.col("net") + 0.5)
    v = X.balanced(net.select("id", F.lit(100.0).alias("opening"), "net", off.alias("closing")))
    return v.select("id", F.round("expected", 2).alias("expected"), "ok")


@query("db_compare", """WITH t AS (SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) AS assets, sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F') AS liabilities, sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'O') AS equity FROM orders)
SELECT CAST(assets AS DOUBLE) AS assets, CAST(liabilities AS DOUBLE) AS liabilities, CAST(equity AS DOUBLE) AS equity, abs(assets - liabilities - equity) <= 1 AS balanced FROM t""")
def db_compare(spark, sf):
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    part = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, amount))
    t = table(spark, sf, "orders").agg(F.sum(amount).alias("assets"), part("F").alias("liabilities"), part("O").alias("equity"))
    ok = (F.abs(F.col("assets") - F.col("liabilities") - F.col("equity")) <= 1).alias("balanced")
    return t.select(*(F.col(c).cast("double").alias(c) for c in t.columns), ok)


@query("db_heatmap", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def db_heatmap(spark, sf):
    p = table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).count()
    return p.select("user_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("click", "view", "purchase")))


@query("fn_health_status", "SELECT event_id, CASE WHEN value > 50 THEN 'High' WHEN value < 10 THEN 'Low' ELSE 'Normal' END AS status FROM events")
def fn_health_status(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.when(v > 50, "High").when(v < 10, "Low").otherwise("Normal").alias("status"))


@query("fn_range", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN value WHEN 2 THEN value END AS low, CASE event_id % 5 WHEN 0 THEN round(value + 1, 2) WHEN 1 THEN value WHEN 3 THEN value END AS high FROM events""")
def fn_range(spark, sf):
    v, k = F.format_string("%.2f", "value"), F.col("event_id") % 5
    said = F.when(k == 0, F.concat(v, F.lit(" - "), F.format_string("%.2f", F.col("value") + 1))).when(k == 1, F.concat(F.lit("up to "), v)).when(k == 2, F.concat(F.lit("> "), v)).when(k == 3, F.concat(F.lit("<"), v)).otherwise("n/a")
    found = table(spark, sf, "events").select("event_id", T.reference_range(said).alias("r"))
    return found.select("event_id", "r.low", F.round("r.high", 2).alias("high"))


@query("fn_walk_path", "SELECT event_id, json_extract_string(props, '$.k') AS v, json_extract_string(props, '$.a.b') AS missing FROM events")
def fn_walk_path(spark, sf):
    p = F.parse_json("props")
    return table(spark, sf, "events").select("event_id", F.try_variant_get(p, "$.k", "string").alias("v"), F.try_variant_get(p, "$.a.b", "string").alias("missing"))


@query("set_ordered_union", "WITH u AS (SELECT doc_id, 1 AS src FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 2 FROM documents WHERE n_chars > 3000) SELECT doc_id, min(src) AS src FROM u GROUP BY 1")
def set_ordered_union(spark, sf):
    d = _docs(spark, sf)
    a = d.filter("lang = 'de'").select("doc_id", F.lit(1).alias("src"))
    return a.unionByName(d.filter("n_chars > 3000").select("doc_id", F.lit(2).alias("src"))).groupBy("doc_id").agg(F.min("src").alias("src"))


@query("set_intersect", "SELECT doc_id FROM documents WHERE lang = 'de' INTERSECT SELECT doc_id FROM documents WHERE n_chars > 3000")
def set_intersect(spark, sf):
    d = _docs(spark, sf)
    return d.filter("lang = 'de'").select("doc_id").intersect(d.filter("n_chars > 3000").select("doc_id"))


@query("srt_multi", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS pos FROM orders ORDER BY pos LIMIT 50")
def srt_multi(spark, sf):
    order = [F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2), F.desc("o_totalprice"), F.asc("o_orderkey")]
    top = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy(*order).limit(50)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias("pos"))


@query("agg_dominant_currency", "SELECT o_custkey, mode(o_orderpriority ORDER BY o_orderpriority) AS currency FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1")
def agg_dominant_currency(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.mode("o_orderpriority").alias("currency"), F.countDistinct("o_orderpriority").alias("n")).filter("n = 1").drop("n")


@query("agg_corpus_profile", "SELECT lang, count(*) AS n, array_to_string(list_sort(list_distinct(list(source)))[1:5], '|') AS sources FROM documents GROUP BY 1")
def agg_corpus_profile(spark, sf):
    return _docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("source")), 1, 5), "|").alias("sources"))


@query("agg_token_counts", "SELECT event_type, json_extract_string(props, '$.k') AS label, count(*) AS n FROM events GROUP BY 1, 2")
def agg_token_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("label")).agg(F.count("*").alias("n"))


@query("agg_portfolio", "SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, count(*) FILTER (WHERE n_chars < 100) AS attention FROM documents GROUP BY 1")
def agg_portfolio(spark, sf):
    return _docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.count_if(F.col("n_chars") < 100).alias("attention"))


@query("flt_scope", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'")
def flt_scope(spark, sf):
    from ..session import Scope

    return Scope("en", frozenset({"src1", "src2"})).apply(_docs(spark, sf), tenant="lang", vendor="source").select("doc_id")


@query("flt_disabled", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def flt_disabled(spark, sf):
    return _docs(spark, sf).select("doc_id").join(table(spark, sf, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("flt_point_in_bbox", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <= 4 AND s_suppkey % 10 + 3 >= 4 AND s_suppkey // 10 <= 5 AND s_suppkey // 10 + 2 >= 5")
def flt_point_in_bbox(spark, sf):
    box = F.struct((F.col("s_suppkey") % 10).alias("x0"), (F.col("s_suppkey") % 10 + 3).alias("x1"), F.floor(F.col("s_suppkey") / 10).alias("y0"), (F.floor(F.col("s_suppkey") / 10) + 2).alias("y1"))
    s = table(spark, sf, "supplier").select("s_suppkey", box.alias("b"))
    return s.filter("4 BETWEEN b.x0 AND b.x1 AND 5 BETWEEN b.y0 AND b.y1").select("s_suppkey")


@query("dup_upload_sha", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(coalesce(text, ''))")
def dup_upload_sha(spark, sf):
    """Uploads taken in: those whose content no earlier id has."""
    return _docs(spark, sf).groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("dup_identifier", """WITH i AS (SELECT DISTINCT doc_id, lang, unnest(list_distinct(regexp_extract_all(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}'))) AS id FROM documents)
SELECT a.doc_id AS a, b.doc_id AS b, 0.92 AS confidence FROM i a JOIN i b ON a.lang = b.lang AND a.id = b.id AND a.doc_id < b.doc_id GROUP BY 1, 2""")
def dup_identifier(spark, sf):
    i = _docs(spark, sf).select("doc_id", "lang", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{3}-[0-9]{2}-[0-9]{4}"), F.lit(0)))).alias("id"))
    met = i.alias("a").join(i.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.id") == F.col("b.id")) & (F.col("a.doc_id") < F.col("b.doc_id")))
    return met.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), F.lit(0.92).alias("confidence")).distinct()


@query("mt_pages", "SELECT doc_id, CAST(ceil(n_chars / 3000.0) AS BIGINT) <= 3 AS allowed FROM documents")
def mt_pages(spark, sf):
    return _docs(spark, sf).select("doc_id", (F.ceil(F.col("n_chars") / 3000.0) <= 3).alias("allowed"))


@query("lt_register", "SELECT source AS slug, count(*) AS seen_count, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def lt_register(spark, sf):
    return _docs(spark, sf).groupBy(F.col("source").alias("slug")).agg(F.count("*").alias("seen_count"), F.min("doc_id").alias("first_doc"))


@query("ct_categorize", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_partkey % 7 = 0 THEN 'income' ELSE 'Other' END AS category FROM part")
def ct_categorize(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    cache = p.filter("p_size < 10").select("p_partkey", F.lit("small").alias("known"))
    fallback = F.when(F.col("p_partkey") % 7 == 0, "income").otherwise("Other")
    return p.join(cache, "p_partkey", "left").select("p_partkey", F.coalesce("known", fallback).alias("category"))


@query("ws_key", "SELECT conv_id, concat_ws(':', conv_id, role) AS key, count(*) AS n FROM conversations GROUP BY 1, 2")
def ws_key(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id", F.concat_ws(":", F.col("conv_id").cast("string"), "role").alias("key")).agg(F.count("*").alias("n"))


@query("dc_excerpt", "SELECT conv_id, substr(string_agg(text, chr(10) ORDER BY turn), 1, 200) AS excerpt FROM conversations GROUP BY 1")
def dc_excerpt(spark, sf):
    parts = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return parts.select("conv_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").substr(1, 200).alias("excerpt"))


@query("fn_rel_when", "WITH o AS (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1996-06-15' AS INTEGER) AS d FROM orders) SELECT o_orderkey, CASE WHEN d < 0 THEN (-d) || ' days ago' WHEN d = 0 THEN 'today' WHEN d < 60 THEN 'in ' || d || ' days' ELSE 'in ' || (d // 30) || ' months' END AS said FROM o")
def fn_rel_when(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.relative_day(F.datediff(F.to_date("o_orderdate"), F.lit("1996-06-15"))).alias("said"))


@query("th_health", "WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_type AS marker, value AS latest, CASE WHEN value > 50 THEN 'High' WHEN value < 10 THEN 'Low' ELSE 'Normal' END AS status FROM r WHERE k = 1")
def th_health(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("marker")).agg(F.max(F.struct("ts", "event_id", "value"))["value"].alias("latest"))
    return last.withColumn("status", F.when(F.col("latest") > 50, "High").when(F.col("latest") < 10, "Low").otherwise("Normal"))


@query("qa_types", "SELECT lang AS type, doc_id FROM documents WHERE lower(lang) IN ('de', 'fr')")
def qa_types(spark, sf):
    return _docs(spark, sf).filter(F.lower("lang").isin("de", "fr")).select(F.col("lang").alias("type"), "doc_id")


@query("qa_compare", "WITH o AS (SELECT *, lead(o_orderkey) OVER w AS b, lead(o_orderstatus) OVER w AS status, lead(o_orderpriority) OVER w AS priority FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_orderkey AS a, b, CAST(o_orderstatus <> status AS INT) + CAST(o_orderpriority <> priority AS INT) AS differing FROM o WHERE b IS NOT NULL")
def qa_compare(spark, sf):
    """Each order beside its customer's next one, field by field."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    fields = ("o_orderstatus", "o_orderpriority")
    o = table(spark, sf, "orders").select("o_orderkey", *fields, F.lead("o_orderkey").over(w).alias("b"), *(F.lead(f).over(w).alias(f"next_{f}") for f in fields))
    return o.filter("b IS NOT NULL").select(F.col("o_orderkey").alias("a"), "b", sum((F.col(f) != F.col(f"next_{f}")).cast("int") for f in fields).alias("differing"))