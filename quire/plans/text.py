"""Queries over text columns: names, money, dates, cleaning, quality, entities, PII counts, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, text
from ..session import table
from .registry import query

# Names in many shapes, over all customers.
NAME_OF = """CASE c_custkey % 13 WHEN 0 THEN 'Mr. Alder ' || c_mktsegment WHEN 1 THEN '[PERSON_1] ' || c_name WHEN 2 THEN 'Mara Voss' || c_custkey || ' (Primary)' WHEN 3 THEN 'N/A' WHEN 4 THEN CAST(c_custkey + 10000 AS STRING)
 WHEN 5 THEN 'A' WHEN 6 THEN c_mktsegment || ' Corp Inc' WHEN 7 THEN c_mktsegment || ' LLC' WHEN 8 THEN 'Quinn  ' || c_mktsegment WHEN 9 THEN '. Kalo ' || c_name || ';' WHEN 10 THEN CAST(NULL AS STRING)
 WHEN 11 THEN 'one two three four five six seven ' || c_mktsegment ELSE 'X ' || c_custkey END"""
NAMES = f"(SELECT c_custkey, {NAME_OF} AS s FROM customer) t".replace("STRING", "VARCHAR")
CLEAN = r"""trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(s, '(?i)\[[a-z][a-z_]*\d*\]', ' ', 'g'))),
 '^(mr|mrs|ms|miss|dr|prof|sir|madam|mx|mr\.|mrs\.|ms\.|dr\.|prof\.)\s+', ''), '\s+', ' ', 'g'), '\([^)]*\)\s*$', '')), '^[^\p{L}\p{N}_]+', ''), '[.,;:]+$', ''))"""
VALID = """(length(c) >= 2 AND regexp_matches(c, '[a-z]') AND NOT (regexp_full_match(c, '[a-z]?\\d[\\d\\W a-z]*') AND len(regexp_extract_all(c, '[a-z]{2,}')) < 2)
 AND len(string_split_regex(trim(c), '\\s+')) <= 7 AND c NOT IN ('na','n/a','none','null','nil','unknown','tbd','not applicable','category','ategory','name','self','applicant','holder','customer'))"""
CANON = f"WITH v AS (SELECT c_custkey, {CLEAN} AS c FROM {NAMES}), k AS (SELECT c_custkey, CASE WHEN {VALID} THEN c ELSE '' END AS c FROM v) "


def _named(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey", f"{NAME_OF} AS s")


def _either(name, column, pairs, fn, base="customer", key="c_custkey", cast="VARCHAR"):
    """A query over a whole table: texts written in turn in several ways (the same in both dialects), beside what each becomes."""
    cases = lambda i: " ".join(f"WHEN {n} THEN {pair[i]}" for n, pair in enumerate(pairs))

    @query(name, f"SELECT {key}, CAST(CASE {key} % {len(pairs)} {cases(1)} END AS {cast}) AS {column} FROM {base}")
    def run(spark, sf):
        return table(spark, sf, base).selectExpr(key, f"CASE {key} % {len(pairs)} {cases(0)} END AS s").select(key, fn(F.col("s")).alias(column))

    return run


@query("fn_canon_name", CANON + "SELECT c_custkey, c AS canonical FROM k")
def fn_canon_name(spark, sf):
    return _named(spark, sf).select("c_custkey", names.canon_name(F.col("s")).alias("canonical"))


@query("fn_valid_name", f"WITH v AS (SELECT c_custkey, lower(s) AS c FROM {NAMES}) SELECT c_custkey, coalesce({VALID}, false) AS valid FROM v")
def fn_valid_name(spark, sf):
    return _named(spark, sf).select("c_custkey", names.valid_name(F.lower("s")).alias("valid"))


@query("fn_canon_name_sorted", CANON + "SELECT c_custkey, array_to_string(list_sort(string_split(c, ' ')), ' ') AS canonical FROM k")
def fn_canon_name_sorted(spark, sf):
    return _named(spark, sf).select("c_custkey", names.canon_name_sorted(F.col("s")).alias("canonical"))


@query("fn_canon_org", CANON + r"SELECT c_custkey, trim(regexp_replace(c, '\s+(pte ltd|pvt ltd|ltd|inc|llc|gmbh|sa|bv|pte|plc|corp|co)\.?$', '')) AS canonical FROM k")
def fn_canon_org(spark, sf):
    return _named(spark, sf).select("c_custkey", names.canon_org(F.col("s")).alias("canonical"))


@query("fn_canon_org_suppliers", r"SELECT s_name, trim(regexp_replace(lower(s_name), '\s+(pte ltd|pvt ltd|ltd|inc|llc|gmbh|sa|bv|pte|plc|corp|co)\.?$', '')) AS canonical FROM supplier")
def fn_canon_org_suppliers(spark, sf):
    return table(spark, sf, "supplier").select("s_name", names.canon_org(F.col("s_name")).alias("canonical"))


_both = "'Alder ' || c_custkey || 'x{}Mara Voss'"
_either("fn_split_people", "people", [(_both.format(sep), "'Alder ' || c_custkey || 'x|Mara Voss'") for sep in (" / ", " & ", " and ", " and/or ")]
        + [("'Jack and Jill Party ' || c_custkey",) * 2, ("'Anderson'",) * 2, ("'Alder Quinn and Bo'",) * 2, ("''", "''")], lambda c: F.array_join(names.split_people(c), "|"))

@query("fn_money_canonical", """SELECT o_orderkey, printf('%.2f USD', o_totalprice) AS canonical FROM orders""")
def fn_money_canonical(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("s"))
    return o.select("o_orderkey", names.money_canonical(F.col("s")).alias("canonical"))


@query("fn_lev_le", "SELECT a.s_name AS a, b.s_name AS b, levenshtein(a.s_name, b.s_name) <= 1 AS near FROM supplier a JOIN supplier b ON a.s_suppkey + 1 = b.s_suppkey OR a.s_suppkey + 10 = b.s_suppkey")
def fn_lev_le(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    a = s.select(F.explode(F.array(F.col("s_suppkey") + 1, F.col("s_suppkey") + 10)).alias("s_suppkey"), F.col("s_name").alias("a"))
    return a.join(s.select("s_suppkey", F.col("s_name").alias("b")), "s_suppkey").select("a", "b", names.lev_le(F.col("a"), F.col("b"), 1).alias("near"))


@query("fn_levenshtein", "SELECT a.s_name AS a, b.s_name AS b, levenshtein(a.s_name, b.s_name) AS d FROM supplier a JOIN supplier b ON a.s_suppkey + 7 = b.s_suppkey")
def fn_levenshtein(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    a = s.select((F.col("s_suppkey") + 7).alias("s_suppkey"), F.col("s_name").alias("a"))
    return a.join(s.select("s_suppkey", F.col("s_name").alias("b")), "s_suppkey").select("a", "b", F.levenshtein("a", "b").cast("long").alias("d"))


# Pairs of canonical forms and whether they name the same thing; w and v are words of eight letters and digits.
_w, _v = "substr(md5(CAST(c_custkey AS STRING)), 1, 8)", "substr(md5(CAST(c_custkey + 500000 AS STRING)), 1, 8)"
IDENTITIES = [("person", "{w} || ' ' || {v}", "{v} || ' ' || {w}", True), ("person", "{w} || ' quinn'", "{v} || ' quinn'", False), ("person", "{w} || ' mara voss'", "{v} || ' mara voss'", False), ("person", "{w} || ' quinn ' || {v}", "{w} || ' quinn'", True),
              ("person", "{w}", "{v}", False), ("person", "{w} || ' quinn'", "{w} || ' quinm'", True), ("money", "{w} || ' USD'", "{w} || ' SGD'", False), ("money", "{w}", "{w}", True), ("org", "''", "''", True), ("org", "''", "{w}", False),
              ("org", "{w} || ' trading'", "{w} || ' trading house berlin branch'", True), ("person", "{w} || '11111111'", "{w} || '11111111222'", True)]
#: Every pair for every customer, with the number of its form.
_PAIRS = ", ".join(f"{{'form': {n}, 'kind': '{k}', 'a': {a}, 'b': {b}}}" for n, (k, a, b, _) in enumerate(IDENTITIES)).replace("{w}", _w).replace("{v}", _v).replace("STRING", "VARCHAR")


@query("res_same", rf"""WITH p AS (SELECT c_custkey, unnest([{_PAIRS}], recursive := true) FROM customer UNION ALL SELECT a.s_suppkey, 100, 'org', lower(a.s_name), lower(b.s_name) FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1
 UNION ALL SELECT a.doc_id, 101, 'person', lower(left(a.text, 30)), lower(left(b.text, 30)) FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL),
t AS (SELECT *, list_distinct(regexp_extract_all(lower(a), '[a-z0-9]+')) AS ta, list_distinct(regexp_extract_all(lower(b), '[a-z0-9]+')) AS tb FROM p),
n AS (SELECT *, len(list_intersect(ta, tb)) AS shared, len(list_distinct(list_concat(ta, tb))) AS whole, least(len(ta), len(tb)) AS small, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS short, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS long FROM t)
SELECT c_custkey, form, a = b OR (a <> '' AND b <> '' AND kind IN ('person', 'org') AND small > 0 AND ((shared = small AND shared >= least(2, small)) OR (shared >= 2 AND shared / whole > 0.5)
 OR (contains(long, short) AND length(short) / greatest(length(long), 1) >= 0.55) OR (shared >= 1 AND levenshtein(a, b) <= 3))) AS same FROM n""")
def res_same(spark, sf):
    """Pairs of canonical forms in every shape, neighbouring suppliers, and openings of neighbouring documents."""
    fill = lambda x: F.expr(x.replace("{w}", _w).replace("{v}", _v))
    forms = F.explode(F.array(*(F.struct(F.lit(n).alias("form"), F.lit(k).alias("kind"), fill(a).alias("a"), fill(b).alias("b")) for n, (k, a, b, _) in enumerate(IDENTITIES))))
    pairs = table(spark, sf, "customer").select("c_custkey", forms.alias("x")).select("c_custkey", "x.*")

    def neighbours(name, key, said, form, kind):
        t = table(spark, sf, name).filter(F.col(said).isNotNull()).select(F.col(key).alias("k"), F.lower(F.substring(said, 1, 30)).alias("s"))
        after = t.select((F.col("k") - 1).alias("k"), F.col("s").alias("b"))
        return t.join(after, "k").select(F.col("k").alias("c_custkey"), F.lit(form).alias("form"), F.lit(kind).alias("kind"), F.col("s").alias("a"), "b")

    pairs = pairs.unionByName(neighbours("supplier", "s_suppkey", "s_name", 100, "org")).unionByName(neighbours("documents", "doc_id", "text", 101, "person"))
    return pairs.select("c_custkey", "form", names.same_identity(F.col("kind"), F.col("a"), F.col("b")).alias("same"))


@query("res_canon_for", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN lower(c_mktsegment) || ' corp' WHEN 1 THEN 'mara ' || lower(c_mktsegment) WHEN 2 THEN c_custkey || ' usd' WHEN 3 THEN 'kept ' || c_custkey ELSE '' END AS best FROM customer""")
def res_canon_for(spark, sf):
    kind = F.expr("CASE c_custkey % 5 WHEN 0 THEN 'org' WHEN 1 THEN 'person' WHEN 2 THEN 'money' WHEN 3 THEN 'org' ELSE 'person' END")
    said = F.expr("CASE c_custkey % 5 WHEN 0 THEN c_mktsegment || ' Corp Inc' WHEN 1 THEN 'Dr. Mara ' || c_mktsegment WHEN 2 THEN ' ' || c_custkey || ' USD ' ELSE 'x' END")
    stored = F.expr("CASE c_custkey % 5 WHEN 1 THEN '' WHEN 3 THEN 'kept ' || c_custkey END")
    return table(spark, sf, "customer").select("c_custkey", names.canon_for(kind, said, stored).alias("best"))


@query("fn_clean_merchant", r"""SELECT p_partkey, CASE WHEN c = '' THEN trim(p_name) ELSE c END AS cleaned FROM (
 SELECT p_partkey, p_name, trim(array_to_string(list_filter(string_split_regex(trim(replace(p_name, '*', ' ')), '\s+'), lambda w: length(regexp_replace(w, '[^0-9]', '', 'g')) < 3), ' '), ' _-.') AS c FROM part)""")
def fn_clean_merchant(spark, sf):
    return table(spark, sf, "part").select("p_partkey", names.clean_merchant(F.col("p_name")).alias("cleaned"))


@query("fn_norm_alnum", "SELECT doc_id, length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS n FROM documents")
def fn_norm_alnum(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(names.norm_alnum(F.col("text"))).cast("long").alias("n"))


@query("fn_slugify", "SELECT url, trim(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM pages")
def fn_slugify(spark, sf):
    return table(spark, sf, "pages").select("url", names.slug(F.col("url")).alias("slug"))


@query("fn_human_size", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%d B', n_chars) ELSE printf('%.1f KB', n_chars / 1024.0) END AS size FROM documents")
def fn_human_size(spark, sf):
    return table(spark, sf, "documents").select("doc_id", names.human_size(F.col("n_chars")).alias("size"))


@query("fn_tokens", "SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n FROM documents")
def fn_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(names.tokens(F.col("text"))).cast("long").alias("n"))


@query("fn_content_tokens", "SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda t: length(t) > 1 AND t NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP) + "))), ' ') AS toks FROM conversations")
def fn_content_tokens(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(text.content_tokens(F.col("text"))), " ").alias("toks"))


@query("txt_sanitize", r"SELECT doc_id, sha256(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) AS h FROM documents")
def txt_sanitize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.sanitize(F.col("text")), 256).alias("h"))


@query("chk_sentences", r"SELECT doc_id, len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '')) AS n FROM documents")
def chk_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n"))


@query("src_html", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS txt FROM pages""")
def src_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_text(F.col("html")).alias("txt"))


@query("fn_scripts", "SELECT doc_id, round(CASE WHEN lat + cyr + han = 0 THEN 0 ELSE lat * 1.0 / (lat + cyr + han) END, 3) AS latin, lat + cyr + han AS counted FROM (SELECT doc_id, length(regexp_replace(text, '[^\\x{0041}-\\x{024F}]', '', 'g')) AS lat, length(regexp_replace(text, '[^\\x{0400}-\\x{04FF}]', '', 'g')) AS cyr, length(regexp_replace(text, '[^\\x{4E00}-\\x{9FFF}]', '', 'g')) AS han FROM documents)")
def fn_scripts(spark, sf):
    counts = text.script_counts(F.col("text"))
    total = sum(counts[k] for k in ("latin", "cyrillic", "cjk"))
    share = F.when(total == 0, 0.0).otherwise(F.round(counts["latin"] / total, 3))
    return table(spark, sf, "documents").select("doc_id", share.alias("latin"), total.cast("long").alias("counted"))


@query("fn_page_quality", r"""
WITH b AS (SELECT doc_id, text, length(text) AS n, regexp_replace(text, '\s', '', 'g') AS ns, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS toks FROM documents),
m AS (SELECT doc_id, trim(text) = '' AS blank, length(ns) AS nns, (length(text) - length(replace(text, chr(65533), ''))) * 1.0 / greatest(n, 1) AS repl,
  1.0 - length(regexp_replace(text, '[^\p{C}]|\s', '', 'g')) * 1.0 / greatest(n, 1) AS printable, length(regexp_replace(ns, '[^\p{L}\p{N}]', '', 'g')) * 1.0 / greatest(length(ns), 1) AS alnum,
  coalesce(list_sum(list_transform(toks, lambda t: length(t))) * 1.0 / len(toks), 0) AS avg_tok, len(list_filter(toks, lambda t: length(t) > 30)) * 1.0 / greatest(len(toks), 1) AS long_tok FROM b)
SELECT doc_id, CAST(CASE WHEN blank THEN 0.0 WHEN nns < 10 THEN 0.1 ELSE round(greatest(0, least(1, 1.0
 - CASE WHEN repl > 0.005 THEN least(0.6, repl * 4) ELSE 0 END - CASE WHEN printable < 0.98 THEN least(0.5, (1 - printable) * 3) ELSE 0 END
 - CASE WHEN alnum < 0.55 THEN least(0.5, (0.55 - alnum) * 1.8) ELSE 0 END - CASE WHEN long_tok > 0.1 THEN least(0.35, long_tok * 1.2) ELSE 0 END
 - CASE WHEN avg_tok < 1.6 THEN 0.2 ELSE 0 END)), 4) END AS DOUBLE) AS score FROM m""")
def fn_page_quality(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.page_quality(F.col("text"))["score"].alias("score"))


@query("fn_low_conf")
def fn_low_conf(spark, sf):
    q = text.page_quality(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", q["score"].alias("score"), F.array_join(q["flags"], "|").alias("flags")).filter("score < 0.55")


@query("agg_ocr_summary")
def agg_ocr_summary(spark, sf):
    scored = table(spark, sf, "documents").select("source", text.page_quality(F.col("text"))["score"].alias("score"))
    return scored.groupBy("source").agg(F.count("*").alias("pages_scored"), F.count_if(F.col("score") < 0.55).alias("low_pages"), F.min("score").alias("min_score"), F.max(F.col("score") < 0.55).alias("flagged"))


@query("ent_regex", r"""
WITH m AS (SELECT doc_id, trim(unnest(regexp_extract_all(text, '(?i)\b(?:USD\s*)?\$?\s*(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(?:USD|million|M|K|billion|B)?\b')), ' ' || chr(9) || chr(10) || chr(12) || chr(13)) AS value FROM documents),
e AS (
 SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS value FROM documents
 UNION ALL SELECT doc_id, 'percent', unnest(regexp_extract_all(text, '\b\d{1,3}(?:\.\d+)?\s*%')) FROM documents
 UNION ALL SELECT doc_id, 'date', unnest(regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b')) FROM documents
 UNION ALL SELECT doc_id, 'date', unnest(regexp_extract_all(text, '\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}\b')) FROM documents
 UNION ALL SELECT doc_id, 'control_id', replace(upper(unnest(regexp_extract_all(text, '(?i)\b(?:CC\d+(?:\.\d+)?|REQ-\d+|A\.\d+(?:\.\d+)?(?:\.\d+)?|HIPAA|PCI-DSS(?:\s*v\d+)?|NIST\s+\d+-\d+|SOC\s*2(?:\s+Type\s*II)?|GDPR|CMMC)\b'))), '  ', ' ') FROM documents
 UNION ALL SELECT doc_id, 'money', value FROM m WHERE regexp_matches(lower(value), '\$|usd|million|billion|[mkb]$')
 UNION ALL SELECT doc_id, 'standard', unnest(regexp_extract_all(text, '\bISO/IEC\s+\d{4,5}(?::\d{4})?\b')) FROM documents)
SELECT DISTINCT doc_id, kind, trim(value) AS value, CASE WHEN kind = 'standard' THEN 'ISO/IEC' END AS family, CASE WHEN kind = 'standard' THEN regexp_extract(value, '\d{4,5}') END AS number,
 CASE WHEN kind = 'standard' THEN nullif(regexp_extract(value, ':(\d{4})$', 1), '') END AS year, CASE WHEN kind = 'date' AND regexp_matches(value, '^\d{4}-') THEN 'iso' END AS format
FROM e WHERE trim(value) <> ''""")
def ent_regex(spark, sf):
    """Entities of all kinds, by ASCII words as in the SQL."""
    patterns = tuple((k, text.ascii_only(p)) for k, p in text.ENTITIES)
    return text.entities(table(spark, sf, "documents"), "doc_id", "text", patterns).distinct()


@query("ent_regex_all")
def ent_regex_all(spark, sf):
    return text.entities(table(spark, sf, "documents"), "doc_id", "text")


@query("pii_detect", r"""SELECT doc_id, len(regexp_extract_all(text, '\b\d{3}-\d{2}-\d{4}\b')) AS ssn, len(regexp_extract_all(text, '\b(?:25[0-5]|2[0-4]\d|[01]?\d\d?)(?:\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)){3}\b')) AS ip_v4,
 len(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS email, len(regexp_extract_all(text, '\+\d{1,3}[ -]?\(?\d{1,4}\)?[ -]?\d{2,4}[ -]?\d{2,9}')) AS phone_e164 FROM documents""")
def pii_detect(spark, sf):
    kinds = ("ssn", "ip_v4", "email", "phone_e164")
    return table(spark, sf, "documents").select("doc_id", *(text.pii_count(F.col("text"), k).alias(k) for k in kinds))


@query("fn_luhn", r"""WITH c AS (SELECT DISTINCT doc_id, regexp_replace(unnest(regexp_extract_all(text, '\b(?:\d[ -]?){13,19}\b')), '[^0-9]', '', 'g') AS digits FROM documents),
d AS (SELECT doc_id, digits, list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(digits), i, 1) AS INT) ELSE (CAST(substr(reverse(digits), i, 1) AS INT) * 2) // 10 + (CAST(substr(reverse(digits), i, 1) AS INT) * 2) % 10 END)) AS s FROM c WHERE length(digits) BETWEEN 13 AND 19)
SELECT doc_id, digits, s % 10 = 0 AS ok FROM d""")
def fn_luhn(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b(?:\d[ -]?){13,19}\b"), F.lit(0))).alias("c"))
    digits = F.regexp_replace("c", "[^0-9]", "")
    return found.select("doc_id", digits.alias("digits")).distinct().filter(F.length("digits").between(13, 19)).withColumn("ok", F.expr("luhn_check(digits)"))


@query("fn_fingerprint", "SELECT doc_id, sha256(text) AS h FROM documents")
def fn_fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))


@query("dup_sha", """WITH g AS (SELECT sha256(text) AS h, doc_id FROM documents) SELECT h, count(*) AS n, min(doc_id) AS first_doc FROM g GROUP BY 1 HAVING count(*) > 1""")
def dup_sha(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("dup_shingles", """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS n FROM t""")
def dup_shingles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.shingles(F.col("text"))).cast("long").alias("n"))


@query("src_blob", "SELECT doc_id, sha256(text) AS sha, octet_length(encode(text)) AS bytes FROM documents")
def src_blob(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"), F.octet_length("text").cast("long").alias("bytes"))


@query("src_strategy", """SELECT doc_id, pages, CASE WHEN pages >= 300 THEN 'huge' WHEN pages >= 100 THEN 'large' WHEN pages >= 30 THEN 'medium' ELSE 'small' END AS strategy FROM (SELECT doc_id, CAST(ceil(n_chars / 3000.0) AS BIGINT) AS pages FROM documents)""")
def src_strategy(spark, sf):
    pages = F.ceil(F.col("n_chars") / 3000.0)
    return table(spark, sf, "documents").select("doc_id", pages.alias("pages"), text.size_strategy(pages).alias("strategy"))


@query("art_strategy", "SELECT doc_id, CASE WHEN n_chars <= 80000 THEN 'full' WHEN n_chars <= 200000 THEN 'reduced' WHEN n_chars <= 600000 THEN 'summary' ELSE 'skipped' END AS strategy FROM documents")
def art_strategy(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", F.when(n <= 80000, "full").when(n <= 200000, "reduced").when(n <= 600000, "summary").otherwise("skipped").alias("strategy"))


@query("src_link_classify", "SELECT page_id, CASE WHEN contains(lower(url), 'drive.google.com') AND contains(lower(url), '/folders/') THEN 'drive_folder' WHEN (contains(lower(url), 'dropbox.com') AND (contains(lower(url), '/sh/') OR contains(lower(url), '/scl/fo/'))) OR ends_with(lower(url), '.zip') THEN 'zip' ELSE 'single_file' END AS kind FROM pages")
def src_link_classify(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.link_kind(F.col("url")).alias("kind"))


@query("fn_sanitize_filename", """SELECT page_id, CASE WHEN n = '' THEN 'upload.bin' ELSE substr(n, 1, 200) END AS name FROM (SELECT page_id, trim(regexp_replace(regexp_extract(url, '[^/]*$'), '["\\x00-\\x1f;]', '', 'g'), ' .') AS n FROM pages)""")
def fn_sanitize_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.safe_filename(F.col("url")).alias("name"))


@query("flt_substring", "SELECT doc_id FROM documents WHERE text ILIKE '%license%'")
def flt_substring(spark, sf):
    return table(spark, sf, "documents").filter(F.col("text").ilike("%license%")).select("doc_id")


@query("flt_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def flt_json_path(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).filter("k IS NOT NULL")


@query("prj_snippet", "SELECT doc_id, substr(text, greatest(1, p - 30), 30 + 7 + 80) AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'license') AS p FROM documents) WHERE p > 0")
def prj_snippet(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.expr("locate('license', lower(text))").alias("p")).filter("p > 0")
    return d.select("doc_id", F.expr("substring(text, greatest(1, p - 30), 117)").alias("snippet"))
