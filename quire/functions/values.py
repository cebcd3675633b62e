"""Values as they stand in records: money, dates, labels and their kinds, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names
from .text import let

# Aliases of field labels.
LABELS = {
    "rate": "interest_rate", "int_rate": "interest_rate", "acct_number": "account_number", "acct_no": "account_number", "account_no": "account_number",
    "ref_no": "reference_number", "ref": "reference_number", "dob": "date_of_birth", "amt": "amount", "total_amount": "total", "amount_due": "total_due",
}
# Fields that may hold a document's amount, in the order they are tried.
AMOUNTS = ("grand_total", "total", "total_due", "total_amount", "amount_due", "invoice_total", "amount")
# Currency symbols and codes.
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₩": "KRW"}
CODES = r"(?i)\b(USD|EUR|GBP|SGD|JPY|CNY|INR|AUD|CAD|CHF|HKD|NZD|KRW|MYR|THB|AED)\b"
# Openings by which a transcript refuses.
REFUSALS = ("i'm sorry", "i cannot", "i can't", "unable to", "error:", "please provide", "i am not able", "as an ai", "i apologize", "sorry,", "i'm unable")


def dates(c: Column, *formats: str) -> Column:
    return names.first_day(c, *formats)


def theme_date(c: Column) -> Column:
    """First ten characters, days before months."""
    return dates(F.substring(F.trim(c), 1, 10), "yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "yyyy/M/d")


def fact_date(c: Column) -> Column:
    return dates(F.trim(c), "yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "d-MMM-yy")


def watch_date(c: Column) -> Column:
    """Dates of 19xx and 20xx, ISO or day first, with - or /."""
    s = F.regexp_replace(F.substring(F.trim(c), 1, 10), "/", "-")
    iso = F.when(s.rlike(r"^(19|20)\d{2}-[01]?\d-[0-3]?\d$"), F.try_to_date(s, "yyyy-M-d"))
    return F.coalesce(iso, F.when(s.rlike(r"^[0-3]?\d-[01]?\d-(19|20)\d{2}$"), F.try_to_date(s, "d-M-yyyy")))


def plain_money(c: Column) -> Column:
    """Number of a text with all but digits, stops and signs dropped; null where none is left."""
    return F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")


def theme_money(c: Column) -> Column:
    """``plain_money``, negative where the text stands in parentheses."""
    s = F.trim(c)
    return F.when(s.rlike(r"^\(.*\)$"), -F.abs(plain_money(s))).otherwise(plain_money(s))


def largest_amount(c: Column) -> Column:
    """The largest number written with a comma or a stop, else the largest number."""
    found = F.regexp_extract_all(c, F.lit(r"\d[\d,]*\.?\d*"), F.lit(0))
    value = lambda t: F.regexp_replace(t, ",", "").try_cast("double")
    shaped = F.filter(found, lambda t: t.rlike("[,.]"))
    return F.coalesce(F.array_max(F.transform(shaped, value)), F.array_max(F.transform(found, value)))


def document_amount(fields: Column) -> Column:
    """First amount among AMOUNTS in a JSON object."""
    return F.coalesce(*(largest_amount(F.get_json_object(fields, f"$.{k}")) for k in AMOUNTS))


def currency(c: Column) -> Column:
    """Code in a text, else its symbol's code."""
    code = F.upper(F.regexp_extract(c, CODES, 1))
    out = F.lit(None).cast("string")
    for mark, name in SYMBOLS.items():
        out = F.when(c.contains(mark), name).otherwise(out)
    return F.when(code != "", code).otherwise(out)


def label(c: Column) -> Column:
    """Snake-case label without a leading article, aliases folded, 64 characters at most; null if empty."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", ""), "^(the|a|an)_", "")
    known = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.when(s != "", F.substring(F.coalesce(F.try_element_at(known, s), s), 1, 64))


def kind(c: Column) -> Column:
    """boolean, money, date, number or string."""
    s = F.trim(F.coalesce(c, F.lit("")))
    m = names.money(s)
    paid = m["amount"].isNotNull() & (m["currency"].isNotNull() | s.rlike("[$€£₹¥]"))
    number = s.rlike(r"^-?\d{1,3}(?:,\d{3})*(?:\.\d+)?%?$") | s.rlike(r"^-?\d+(?:\.\d+)?%?$")
    return (
        F.when(s == "", "string").when(F.lower(s).isin("yes", "no", "true", "false", "y", "n"), "boolean").when(paid, "money")
        .when(names.canon_date(s) != "", "date").when(number, "number").otherwise("string")
    )


def person_key(c: Column) -> Column:
    """Words of a name without titles, sorted."""
    bare = F.regexp_replace(F.trim(c), r"(?i)^((mr|mrs|ms|miss|dr|prof|mdm|madam|sir)\.?\s+)+", "")
    return F.array_join(F.array_sort(F.filter(F.split(F.regexp_replace(F.lower(bare), "[^a-z0-9 ]", " "), " +"), lambda t: t != "")), " ")


def transcript_gate(c: Column) -> Column:
    """struct(ok, score, reason): is a machine transcript worth keeping?"""
    said = lambda ok, score, why: F.struct(F.lit(ok).alias("ok"), score.alias("score"), F.lit(why).alias("reason"))
    run = lambda line, n, most: F.struct(line.alias("line"), n.alias("n"), most.alias("most"))

    def refuses(s: Column) -> Column:
        return let(F.substring(F.lower(s), 1, 150), lambda head: F.exists(F.array(*map(F.lit, REFUSALS)), lambda mark: F.contains(head, mark)))

    def most(lines: Column) -> Column:
        """How often the commonest line stands there: the longest run of the sorted lines."""
        step = lambda at, x: let(F.when(at["line"] == x, at["n"] + 1).otherwise(1), lambda n: run(x, n, F.greatest(at["most"], n)))
        return F.aggregate(F.array_sort(lines), run(F.lit(None).cast("string"), F.lit(0), F.lit(0)), step, lambda at: at["most"])

    def repeats(s: Column) -> Column:
        lines = F.filter(F.transform(F.split(s, "\n"), lambda x: F.trim(x)), lambda x: x != "")
        return let(lines, lambda a: F.when(F.size(a) >= 5, most(a) / F.size(a) > 0.6).otherwise(False))

    def gate(s: Column) -> Column:
        readable = F.length(F.regexp_replace(s, r"""[^\p{L}\p{N}\s.,;:!?()\[\]{}#*|\-–—_'"/>&%$@+=~₹€£¥]""", "")) / F.greatest(F.length(s), F.lit(1))
        whole = lambda words: let(readable, lambda r: F.when(r < 0.75, said(False, r, "garbled")).when(repeats(s), said(False, F.lit(0.3), "repetitive")).otherwise(said(True, 0.5 * r + 0.5 * F.least(words / 200.0, F.lit(1.0)), "ok")))
        long = let(F.size(F.split(s, r"\s+")), lambda words: F.when(words < 10, said(False, F.lit(0.2), "too_few_words")).otherwise(whole(words)))
        return F.when(s == "", said(False, F.lit(0.0), "empty")).when(F.length(s) < 30, said(False, F.lit(0.1), "too_short")).when(refuses(s), said(False, F.lit(0.05), "refusal")).otherwise(long)

    # Each step is bound once: a text is read by each pattern once, and only as far as the steps before let it.
    return let(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")), gate)


def quality_level(score: Column) -> Column:
    """good from 0.85, fair from 0.70, else poor."""
    return F.when(score >= 0.85, "good").when(score >= 0.70, "fair").otherwise("poor")
