"""Small rules over names, tables, questions and scores, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import tokens

# What a question says that tries to turn the assistant around, and what asks for a list or for the whole library.
INJECTION = r"(?i)(ignore (all |the |your |any )?(previous|prior|above|earlier) (instruction|prompt|rule)|disregard (the|your|all|any) (instruction|prompt|rule)|you are now\b|act as (?:a |an )?(?:dan|jailbreak)|reveal (your |the )?(system )?(prompt|instructions)|what (is|are) your (system )?(prompt|instructions)|print (your|the) (system )?(prompt|instructions)|do anything now|developer mode|jailbreak)"
LISTING = r"(?i)\b(list|share|show|give me|display|table of|tabulate)\b"
OVERVIEW = r"(?i)summari[sz]e\s+(?:(?:all|my|the|these)\s+)*(?:documents?|files?|records?|library|everything|stuff|data)\b|\b(overview|inventory|how many\s+(of\s+(my|the|your|these)\s+)?(documents?|files?|records?|papers?|things|types?|kinds?)|what (do i have|documents|files)|all (my |the )?(docs|documents|files|of them)|everything)\b"
ANALYTICAL = r"(?i)\b(?:compan|organi[sz]|expir|consisten|contradict|mismatch|renew|convert|transaction)|\b(?:people|persons?|whose|biggest|largest|smallest|highest|lowest|most|least|total|sum|combined|average|spend|spent|amount|balance|compare|comparison|versus|timeline|due|overdue|conflict|match|rank|action|exposure|missing|mention)\b"
NOISE = r"^(\s*\[[A-Z0-9_]+\]\s*)+$"
# Keys that may hold a record's own date, in the order they are tried.
PRIMARY_DATES = ("primary_date", "date", "invoice_date", "issue_date", "statement_date", "event_date", "transaction_date", "date_of_issue")
# Currency symbols and their codes, in the order they are tried.
CURRENCIES = (("S$", "SGD"), ("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"))
MRZ = r"[A-Z0-9<]{30,44}"


def listing_of(question: Column, kinds: list[str]) -> Column:
    """The longest of ``kinds`` a question asks to list; null if it asks for none."""
    low = F.lower(question)
    out = F.lit(None).cast("string")
    for kind in sorted(kinds, key=lambda k: (len(k), k)):
        out = F.when(low.contains(kind), kind).otherwise(out)
    return F.when(question.rlike(LISTING), out)


def broad_overview(question: Column) -> Column:
    qualified = question.rlike(r"(?i)\b(of|for|about|named|belonging to|owned by|related to)\s+(?!them\b|these\b|those\b|the\b|my\b|it\b|us\b|you\b|me\b|each\b|any\b|all\b)[a-z0-9]")
    return question.rlike(OVERVIEW) & ~qualified & ~question.rlike(ANALYTICAL)


def noise_name(c: Column) -> Column:
    """Only bracketed tokens, or one word with a digit."""
    n = F.trim(F.coalesce(c, F.lit("")))
    return (n == "") | n.rlike(NOISE) | (~n.contains(" ") & n.rlike(r"\d"))


def name_tokens(c: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"'s\b", "")
    return F.filter(F.split(F.trim(F.regexp_replace(low, "[^a-z0-9 ]+", "")), r"\s+"), lambda t: t != "")


def names_match(asked: Column, holder: Column) -> Column:
    """The same words, or the same first word with one name's words all in the other's."""
    q, d = name_tokens(asked), name_tokens(holder)
    q_in, d_in = F.size(F.array_except(q, d)) == 0, F.size(F.array_except(d, q)) == 0
    return (F.size(q) > 0) & (F.size(d) > 0) & ((q_in & d_in) | ((F.get(q, F.lit(0)) == F.get(d, F.lit(0))) & (q_in | d_in)))


def token_overlap(a: Column, b: Column) -> Column:
    """At least two words shared, and all those of the shorter side."""
    ta, tb = tokens(a), tokens(b)
    shared = F.size(F.array_intersect(ta, tb))
    return (shared >= 2) & (shared >= F.least(F.size(ta), F.size(tb)))


def primary_date(fields: Column, created: Column) -> Column:
    """Ten characters of the first date key that is filled, else the day of creation."""
    held = [F.trim(F.get_json_object(fields, f"$.{k}")) for k in PRIMARY_DATES]
    return F.coalesce(*(F.when(v != "", F.substring(v, 1, 10)) for v in held), F.date_format(created, "yyyy-MM-dd"))


def inferred_currency(*candidates: Column) -> Column:
    """A code of three capitals in the first text that has one or a symbol; '' if none has."""
    out = F.lit("")
    for c in reversed(candidates):
        code = F.regexp_extract(c, r"\b([A-Z]{3})\b", 1)
        marked = F.lit(None).cast("string")
        for mark, name in reversed(CURRENCIES):
            marked = F.when(c.contains(mark), name).otherwise(marked)
        found = F.when(code != "", code).otherwise(marked)
        out = F.coalesce(found, out)
    return out


def header_row(cells: Column) -> Column:
    """Whether most filled cells of a row are short labels rather than numbers or dates."""
    held = F.filter(cells, lambda c: F.coalesce(c, F.lit("")) != "")
    labels = F.size(F.filter(held, lambda c: ~c.rlike(r"^[\s$€£₹]*[\d.,/-]") & (F.length(c) <= 40)))
    return (F.size(held) >= 2) & (labels >= F.greatest(F.lit(2), F.floor((F.size(held) + 1) / 2)))


def mrz_span(text: Column) -> Column:
    """struct(start, end) of two or three lines of a machine-readable zone less than ten characters apart."""
    found = F.regexp_extract(text, rf"(?s){MRZ}.{{0,9}}?{MRZ}(?:.{{0,9}}?{MRZ})?", 0)
    start = F.instr(text, found) - 1
    return F.when(found != "", F.struct(start.alias("start"), (start + F.length(found)).alias("end")))


def risk(score: Column) -> Column:
    return F.when(score >= 0.85, "low").when(score >= 0.70, "medium").otherwise("high")


def consistency(total: Column, lines: Column) -> Column:
    """What a total says about its lines: +.10 where it covers them, else -.15."""
    return F.when(total >= lines, 0.10).otherwise(-0.15)


def box_overlap(a: Column, b: Column) -> Column:
    """Share of box ``a`` (x0, y0, x1, y1) that lies in ``b``."""
    wide = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    high = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return F.when(area > 0, wide * high / area).otherwise(0.0)


def position_score(overlap: Column) -> Column:
    return F.when(overlap <= 0, -0.15).when(overlap > 0.8, 0.10).when(overlap > 0.5, 0.05).otherwise(-0.05)


def balance_sheet_ok(assets: Column, liabilities: Column, equity: Column) -> Column:
    """Assets are liabilities and equity within 1 % or 1; null where one is missing."""
    return F.abs(assets - (liabilities + equity)) <= F.greatest(F.lit(1.0), assets * 0.01)


def identity_status(days: Column, soon: int = 180) -> Column:
    return F.when(days.isNull(), "—").when(days < 0, "Expired").when(days < soon, "Expiring soon").otherwise("Valid")


def token_cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Price of a call from rates for a million tokens."""
    return (tokens_in * rate_in + tokens_out * rate_out) / 1e6


def promo(active: Column, expires: Column, now: Column, used: Column, most: Column) -> Column:
    """Why a code does not hold, or ok."""
    return F.when(~F.coalesce(active, F.lit(False)), "promo_invalid").when(now > expires, "promo_expired").when(used >= most, "promo_used").otherwise("ok")


def vector_literal(v: Column) -> Column:
    """Text of a vector with six decimals, ties of the binary value to even; a float times a million is exact in a double below 2^33."""
    six = lambda x: F.when(F.abs(x) < 2.0**33, F.rint(x * 1e6) / 1e6).otherwise(x)
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string("%.6f", six(x))), ","), F.lit("]"))


def calendar_event(uid: Column, day: Column, title: Column) -> Column:
    """An iCalendar all-day event; commas, semicolons, backslashes and line ends are escaped."""
    safe = F.regexp_replace(F.regexp_replace(title, r"([\\,;])", r"\\$1"), "\n", r"\\n")
    return F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(day, "yyyyMMdd")), F.concat(F.lit("SUMMARY:"), safe), F.lit("END:VEVENT"))


def field_matches(value: Column, boxed: Column) -> Column:
    """Whether a value is the boxed text, or stands in it with five letters or digits or more."""
    norm = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    v, t = norm(value), norm(boxed)
    return (F.length(t) >= 3) & (v != "") & ((v == t) | ((F.length(v) >= 5) & t.contains(v)))


def label_matches(label: Column, key: Column) -> Column:
    """Equal once normalised, or one in the other for keys of four characters or more."""
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    a, k = norm(label), norm(key)
    return (F.length(k) >= 3) & (a != "") & ((a == k) | ((F.length(k) >= 4) & (a.contains(k) | k.contains(a))))


def date_variants(day: Column) -> Column:
    """Printed forms of a day to look for in a text."""
    return F.array(*(F.date_format(day, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")))
