"""Queries that read values out of strings: all orders, their numbers and days written in every form, and all words of documents that hold a digit.

The SQL reads the same strings by its own means; no answer is typed in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import names
from ..functions import values as V
from ..operators import records as X
from ..session import table
from .registry import query

#: (Spark, DuckDB) of what the forms are made from.
NUMBER = ("format_number(o_totalprice, 2)", "format('{:,.2f}', o_totalprice)")
COUNT = ("CAST(o_custkey AS STRING)",) * 2


def day(spark: str, sql: str) -> tuple[str, str]:
    return f"date_format(o_orderdate, '{spark}')", f"strftime(o_orderdate, '{sql}')"


ISO, SLASHED, AMERICAN, DASHED = day("yyyy-MM-dd", "%Y-%m-%d"), day("dd/MM/yyyy", "%d/%m/%Y"), day("MM/dd/yyyy", "%m/%d/%Y"), day("d-M-yyyy", "%-d-%-m-%Y")
SHORT, LONG, COMMA, MONTH = day("d MMM yyyy", "%-d %b %Y"), day("d MMMM yyyy", "%-d %B %Y"), day("MMM d, yyyy", "%b %-d, %Y"), day("MMMM d, yyyy", "%B %-d, %Y")


def form(pattern: str, *parts: tuple[str, str]) -> tuple[str, str]:
    """A string with parts in place of {}, in both dialects."""
    return tuple(pattern.format(*(p[i] for p in parts)) for i in (0, 1))


def read(name: str, column: str, forms: list[tuple[str, str]], fn, sql: str, words: bool = True, also: tuple = ()) -> None:
    """Registers (id, form, ``column``): ``fn`` of every form of every order, and of every word with a digit, beside ``sql`` over s.

    ``also`` names one more column with its function and SQL.
    """
    columns = [(column, fn, sql), *([also] if also else [])]
    rows = ", ".join(f"{{'form': {i}, 's': {f[1]}}}" for i, f in enumerate(forms))
    said = f"SELECT o_orderkey AS id, unnest([{rows}], recursive := true) FROM orders"
    if words:
        said += r" UNION ALL SELECT doc_id, CAST(generate_subscripts(regexp_extract_all(text, '\S*[0-9]\S*'), 1) + 99 AS INTEGER), unnest(regexp_extract_all(text, '\S*[0-9]\S*')) FROM documents"

    @query(name, f"WITH strings AS ({said}) SELECT id, form, {', '.join(f'{q} AS {c}' for c, _, q in columns)} FROM strings")
    def run(spark, sf):
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("form"), F.expr(f[0]).alias("s")) for i, f in enumerate(forms))))
        rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), each.alias("x")).select("id", "x.form", "x.s")
        if words:
            found = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.regexp_extract_all("text", F.lit(r"\S*[0-9]\S*"), F.lit(0))).alias("form", "s"))
            rows = rows.unionByName(found.withColumn("form", F.col("form") + 100))
        return rows.select("id", "form", *(f(F.col("s")).alias(c) for c, f, _ in columns))


PLAIN = r"TRY_CAST(regexp_replace({0}, '[^0-9.\-]', '', 'g') AS DOUBLE)"
AMOUNTS = [form("{} || 'SGD'", NUMBER), form("'(' || {} || ')'", NUMBER), form("' (' || {} || ') '", COUNT), form("'S$' || {}", COUNT), ("'-'",) * 2, ("''",) * 2, form("'USD ' || {}", NUMBER), form("{} || '-2'", COUNT), form("'-' || {}", NUMBER), ("CAST(NULL AS STRING)",) * 2]
read("fn_parse_money", "amount", AMOUNTS, V.theme_money, rf"CASE WHEN regexp_matches(trim(s), '^\(.*\)$') THEN -abs({PLAIN.format('s')}) ELSE {PLAIN.format('s')} END")
read("fn_money_float", "amount", AMOUNTS, V.plain_money, PLAIN.format("s"))

LARGEST = r"""coalesce(list_max(list_transform(list_filter(regexp_extract_all({0}, '\d[\d,]*\.?\d*'), lambda t: regexp_matches(t, '[,.]')), lambda t: TRY_CAST(replace(t, ',', '') AS DOUBLE))),
 list_max(list_transform(regexp_extract_all({0}, '\d[\d,]*\.?\d*'), lambda t: TRY_CAST(replace(t, ',', '') AS DOUBLE))))"""
read("fn_parse_amount_max", "amount", [*AMOUNTS, form("{} || ' (VAT 8%)'", NUMBER), form("'$' || {} || ' x 2'", COUNT), form("{} || ' of ' || {}", COUNT, NUMBER), ("'none'",) * 2], V.largest_amount, LARGEST.format("s"))
_json = [form("'{{\"total\": \"' || {} || '\", \"amount\": \"99\"}}'", NUMBER), form("'{{\"amount\": \"' || {} || '\"}}'", COUNT), form("'{{\"grand_total\": \"-\", \"amount_due\": \"' || {} || ' of 7\"}}'", NUMBER), ("'{}'",) * 2]
read("fn_doc_amount", "amount", _json, V.document_amount, "coalesce(" + ", ".join(LARGEST.format(f"(s ->> '$.{k}')") for k in V.AMOUNTS) + ")", words=False)

_code = f"upper(regexp_extract(s, '{V.CODES}', 1))"
_marks = "CASE " + " ".join(f"WHEN contains(s, '{m}') THEN '{c}'" for m, c in reversed(V.SYMBOLS.items())) + " END"
CURRENCIES = [form("'total ' || {} || ' sgd'", COUNT), form("'£' || {}", COUNT), COUNT, form("'$' || {} || ' EUR'", COUNT), form("'€$' || {}", NUMBER), form("{} || 'usd'", COUNT), ("''",) * 2]
read("fn_doc_currency", "currency", CURRENCIES, V.currency, f"CASE WHEN {_code} <> '' THEN {_code} ELSE {_marks} END")

_starts = lambda value: " ".join(f"WHEN starts_with(lower(trim(s)), '{m}') THEN {value(m, c)}" for m, c in names.PREFIXES)
_ends = lambda value: " ".join(f"WHEN ends_with(lower(trim(s)), '{m}') THEN {value(m, c)}" for m, c in names.SUFFIX_MARKS)
_rest = f"CASE {_starts(lambda m, c: f'substr(trim(s), {len(m) + 1})')} {_ends(lambda m, c: f'left(trim(s), length(trim(s)) - {len(m)})')} ELSE trim(s) END"
PAID = [form("'S$' || {}", NUMBER), form("'$' || {}", NUMBER), form("'-$' || {}", NUMBER), form("'$-' || {}", NUMBER), ("'not money'",) * 2, form("{} || ' EUR'", NUMBER), form("'US$ ' || {}", NUMBER), form("'Rs' || {} || ' INR'", COUNT), form("{} || '£'", COUNT), ("' '",) * 2]
_found = rf"regexp_extract(regexp_replace({_rest}, '[, ]', '', 'g'), '-?\d+(\.\d+)?')"
_named = f"CASE {_starts(lambda m, c: repr(c))} {_ends(lambda m, c: repr(c))} END"
read("fn_canon_money", "amount", PAID, lambda c: names.money(c)["amount"], f"TRY_CAST(nullif({_found}, '') AS DOUBLE)", also=("currency", lambda c: names.money(c)["currency"], f"CASE WHEN trim(s) <> '' THEN {_named} END"))


def dates(text: str, *formats: str) -> str:
    return f"CAST(coalesce({', '.join(f'try_strptime({text}, {f!r})' for f in formats)}) AS DATE)"


DAYS = [ISO, SLASHED, AMERICAN, DASHED, SHORT, LONG, COMMA, MONTH, form("{} || ' x'", SLASHED), day("yyyy/M/d", "%Y/%-m/%-d"), ("'soon'",) * 2, ("'31-02-2026'",) * 2, form("'[' || {} || ']'", ISO), day("yyyy-99-99", "%Y-99-99"), day("1826-MM-dd", "1826-%m-%d"), day("yyyy-MM-31", "%Y-%m-31"), ("CAST(NULL AS STRING)",) * 2]
_DMY, _MDY = "%d/%m/%Y", "%m/%d/%Y"
FACT = ("%Y-%m-%d", _DMY, _MDY, "%d-%m-%Y", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%d-%b-%y")
read("fn_parse_date_theme", "day", DAYS, V.theme_date, dates("substr(trim(s), 1, 10)", "%Y-%m-%d", _DMY, _MDY, "%d-%m-%Y", "%Y/%m/%d"))
read("fn_parse_date_facts", "day", DAYS, V.fact_date, dates("trim(s)", *FACT))
_turned = "replace(substr(trim(s), 1, 10), '/', '-')"
read("fn_parse_date_watch", "day", DAYS, V.watch_date, rf"CASE WHEN regexp_matches({_turned}, '^(19|20)\d{{2}}-[01]?\d-[0-3]?\d$') THEN {dates(_turned, '%Y-%m-%d')} WHEN regexp_matches({_turned}, '^[0-3]?\d-[01]?\d-(19|20)\d{{2}}$') THEN {dates(_turned, '%d-%m-%Y')} END")
#: Spark's date letters in DuckDB's.
_LETTERS = {"yyyy": "%Y", "MMMM": "%B", "MMM": "%b", "MM": "%m", "M": "%m", "dd": "%d", "d": "%d", "yy": "%y"}


def translated(pattern: str) -> str:
    out = pattern
    for i, letters in enumerate(_LETTERS):
        out = out.replace(letters, f"<{i}>")
    for i, mark in enumerate(_LETTERS.values()):
        out = out.replace(f"<{i}>", mark)
    return out


read("fn_parse_date_alert", "day", DAYS, lambda c: V.dates(c, *X.DEADLINE_FORMATS), dates("s", *map(translated, X.DEADLINE_FORMATS)))
_bare = r"regexp_replace(regexp_replace(trim(s), '^[\[\]]+', ''), '[\[\]]+$', '')"
read("fn_canon_date", "iso", DAYS, names.canon_date, rf"CASE WHEN regexp_matches({_bare}, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN {_bare} WHEN s IS NULL THEN '' ELSE coalesce(strftime({dates(_bare, '%Y-%m-%d', *map(translated, names.DATE_FORMATS))}, '%Y-%m-%d'), '') END")
read("flt_regex_date", "d", DAYS, lambda c: F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd")), rf"CASE WHEN regexp_matches(s, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN {dates('s', '%Y-%m-%d')} END")

_pair = [form("'{{\"effective_date\": \"' || {} || '\", \"expiry_date\": \"1995-07-01\"}}'", d) for d in (ISO, SLASHED, SHORT)] + [form("'{{\"effective_date\": \"1990-01-01\", \"expiry_date\": \"' || {} || '\"}}'", d) for d in (SLASHED, COMMA)] + [("'{}'",) * 2, form("'{{\"effective_date\": \"' || {} || '\"}}'", ISO)]
_at = lambda c, key: V.fact_date(F.get_json_object(c, f"$.{key}"))
_of = lambda key: dates(f"trim(s ->> '$.{key}')", *FACT)
read("val_dates", "ok", _pair, lambda c: ~F.coalesce(_at(c, "effective_date") > _at(c, "expiry_date"), F.lit(False)), f"NOT coalesce({_of('effective_date')} > {_of('expiry_date')}, false)", words=False)
_ends_on = [form("'{{\"expiry_date\": \"' || {} || '\"}}'", d) for d in (ISO, LONG)] + [form("'{{\"valid_until\": \"' || {} || '\"}}'", d) for d in (SLASHED, DASHED)] + [("'{}'",) * 2, form("'{{\"expiry_date\": \"never\", \"valid_until\": \"' || {} || '\"}}'", ISO)]
read("val_expired", "expired", _ends_on, lambda c: F.coalesce(V.fact_date(F.coalesce(F.get_json_object(c, "$.expiry_date"), F.get_json_object(c, "$.valid_until"))) < F.lit("1995-06-15").cast("date"), F.lit(False)), f"coalesce({dates('''trim(coalesce(s ->> '$.expiry_date', s ->> '$.valid_until'))''', *FACT)} < DATE '1995-06-15', false)", words=False)

_slug = "regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(s, ''))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '^(the|a|an)_', '')"
LABELLED = [("'The Int. Rate'",) * 2, ("'Amt'",) * 2, ("' Ref No '",) * 2, form("'Vendor-Name ' || {}", COUNT), ("'!!'",) * 2, form("{} || ' an ' || {}", COUNT, COUNT), ("lower(o_orderpriority)",) * 2, form("repeat('Long label ', 9) || {}", COUNT)]
_aliases = f"CASE {_slug} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.LABELS.items()) + f" ELSE {_slug} END"
read("fn_canon_label", "label", LABELLED, V.label, f"CASE WHEN {_slug} <> '' THEN left({_aliases}, 64) END")
PEOPLE = [form("'MR. B H Goda' || {}", COUNT), ("'Mr. Dr. Ann Lee'",) * 2, form("'Lee' || {} || ', Ann'", COUNT), form("' prof.  ' || lower(o_orderpriority) || ' O''Hara ' || {}", COUNT), ("'Mrs.'",) * 2, ("''",) * 2]
_untitled = r"regexp_replace(trim(s), '(?i)^((mr|mrs|ms|miss|dr|prof|mdm|madam|sir)\.?\s+)+', '')"
read("fn_person_key", "key", PEOPLE, V.person_key, f"array_to_string(list_sort(regexp_extract_all(lower({_untitled}), '[a-z0-9]+')), ' ')")
SHOPS = [form("lower(o_orderpriority) || '.com/bill 8001861087 IE'"), form("'Simba*' || {}", COUNT), ("'Grab  ' || o_orderpriority || ' SG'",) * 2, ("''",) * 2, ("'Shop 123'",) * 2, form("'Store #' || {}", COUNT), form("'7-11 ' || {} || ' x' || {} || ' US'", COUNT, NUMBER)]
read("fn_merchant_canon", "merchant", SHOPS, names.merchant, r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim(s)), '[*#].*$', ''), '\b\d{4,}\b', '', 'g'), '\s+(SG|US|IE|UK|IN|MY|AU|CA|HK|JP|TH|PH)$', ''), '\s+', ' ', 'g'))")
