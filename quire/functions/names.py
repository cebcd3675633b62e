"""Canonical forms of names, organisations, money and dates, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings that never are a name.
NAME_JUNK = ("na", "n/a", "none", "null", "nil", "unknown", "tbd", "not applicable", "category", "ategory", "name", "self", "applicant", "holder", "customer")
# Titles before a name and corporate suffixes after one.
TITLES = "mr|mrs|ms|miss|dr|prof|sir|madam|mx|mr\\.|mrs\\.|ms\\.|dr\\.|prof\\."
SUFFIXES = "pte ltd|pvt ltd|ltd|inc|llc|gmbh|sa|bv|pte|plc|corp|co"
# Currency marks, the longer before the shorter they contain, and their codes.
PREFIXES = (("us$", "USD"), ("usd", "USD"), ("sgd", "SGD"), ("inr", "INR"), ("eur", "EUR"), ("gbp", "GBP"), ("jpy", "JPY"), ("s$", "SGD"), ("rs", "INR"), ("$", "USD"), ("₹", "INR"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"))
SUFFIX_MARKS = (("$", "USD"), ("us$", "USD"), ("usd", "USD"), ("s$", "SGD"), ("sgd", "SGD"), ("₹", "INR"), ("rs", "INR"), ("inr", "INR"), ("€", "EUR"), ("eur", "EUR"), ("£", "GBP"), ("gbp", "GBP"), ("¥", "JPY"), ("jpy", "JPY"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda that names an outer expression would redo it for each element."""
    return F.transform(F.array(value), body)[0]


def valid_name(c: Column) -> Column:
    """Plausible cleaned name: two characters, a letter, not id-like, at most 7 words, not junk."""
    idlike = c.rlike(r"^[a-z]?\d[\d\W a-z]*$") & (F.regexp_count(c, F.lit("[a-z]{2,}")) < 2)
    words = F.size(F.split(F.trim(c), r"\s+"))
    return F.coalesce((F.length(c) >= 2) & c.rlike("[a-z]") & ~idlike & (words <= 7) & ~c.isin(*NAME_JUNK), F.lit(False))


def clean_name(c: Column) -> Column:
    """Lower-cased name without placeholders, one title, a closing parenthesis, leading marks and trailing stops."""
    out = F.lower(F.trim(F.regexp_replace(c, r"(?i)\[[a-z][a-z_]*\d*\]", " ")))
    out = F.regexp_replace(F.regexp_replace(out, rf"^({TITLES})\s+", ""), r"\s+", " ")
    out = F.trim(F.regexp_replace(out, r"\([^)]*\)\s*$", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"^[^\p{L}\p{N}_]+", ""), r"[.,;:]+$", ""))


def canon_name(c: Column) -> Column:
    return let(clean_name(c), lambda out: F.when(valid_name(out), out).otherwise(""))


def canon_name_sorted(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(canon_name(c), " ")), " ")


def canon_org(c: Column) -> Column:
    """A canonical name less one corporate suffix."""
    return F.trim(F.regexp_replace(canon_name(c), rf"\s+({SUFFIXES})\.?$", ""))


def split_people(c: Column) -> Column:
    """Array of the persons a joint name holds, or of the whole where a part is no full name."""
    raw = F.trim(c)
    whole = F.array(raw)
    out = whole
    for sep in (r"\s+and\s+", r"\s*&\s*", r"\s*/\s*", r"\s*&?/or\s*", r"\s+and/or\s+"):
        parts = F.transform(F.split(raw, "(?i)" + sep), lambda p: F.trim(p))
        names = F.filter(parts, lambda p: ~p.rlike(r"(?i)^\[[a-z][a-z_]*\d*\]$"))
        good = F.forall(names, lambda p: (F.size(F.split(p, r"\s+")) >= 2) & (canon_name(p) != "")) & ~F.exists(parts, lambda p: p == "")
        out = F.when((F.size(parts) >= 2) & (F.size(names) > 0) & good, names).otherwise(out)
    # Without any of the separators there is nothing to split.
    out = F.when(raw.rlike(r"(?i)\sand\s|[&/]"), out).otherwise(whole)
    return F.when(raw.isNull() | (raw == ""), F.array().cast("array<string>")).otherwise(out)


def money(c: Column) -> Column:
    """struct(amount, currency): mark by prefix, else suffix, then the first number."""
    none = F.struct(F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("currency"))

    def parted(raw: Column, low: Column) -> Column:
        """struct(code, rest) by the first mark that fits."""
        out = None
        for marks, at, start, end in ((PREFIXES, low.startswith, lambda m: len(m) + 1, lambda m: F.length(raw)), (SUFFIX_MARKS, low.endswith, lambda m: 1, lambda m: F.length(raw) - len(m))):
            for mark, cur in marks:
                rest = F.struct(F.lit(cur).alias("code"), raw.substr(F.lit(start(mark)), end(mark)).alias("rest"))
                out = F.when(at(mark), rest) if out is None else out.when(at(mark), rest)
        return out.otherwise(F.struct(F.lit(None).cast("string").alias("code"), raw.alias("rest")))

    def valued(m: Column) -> Column:
        amount = let(F.regexp_extract(F.regexp_replace(m["rest"], "[, ]", ""), r"-?\d+(\.\d+)?", 0), lambda d: F.when(d != "", d.try_cast("double")))
        return F.struct(amount.alias("amount"), m["code"].alias("currency"))

    said = let(F.trim(c), lambda raw: let(F.lower(raw), lambda low: let(parted(raw, low), valued)))
    return F.when(c.isNotNull() & (F.trim(c) != ""), said).otherwise(none)


def money_canonical(c: Column) -> Column:
    return let(money(c), lambda m: F.when(m["amount"].isNull(), "").otherwise(F.format_string("%.2f %s", m["amount"], F.coalesce(m["currency"], F.lit("?")))))


# Date formats in the order they are tried.
DATE_FORMATS = ("d-MMM-yyyy", "d MMM yyyy", "d MMMM yyyy", "d-M-yyyy", "M/d/yyyy", "d/M/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d-MMMM-yyyy")


# What may stand for the letters of a date format, and never less than Spark takes.
DATE_PARTS = {"yyyy": r"[+-]?\d{4,}", "yy": r"[+-]?\d+", "MMMM": r"\p{L}+", "MMM": r"\p{L}+", "M": r"\+?0*(?:1[0-2]|[1-9])", "d": r"\+?0*(?:[12]\d|3[01]|[1-9])"}


def day(c: Column, pattern: str) -> Column:
    """The date a text is in one format, else null; a text of another shape is not parsed, which costs far more than to look at it."""
    shape = re.sub("|".join(DATE_PARTS), lambda m: DATE_PARTS[m[0]], pattern)
    return F.when(c.contains(re.sub("[A-Za-z]", "", pattern)[0]) & c.rlike(f"^{shape}$"), F.try_to_date(c, pattern))


def first_day(c: Column, *patterns: str) -> Column:
    """The date a text is in the first format it fits."""
    return F.coalesce(*(day(c, p) for p in patterns))


def canon_date(c: Column) -> Column:
    """ISO date, months before days in slashed dates; an ISO-shaped text passes unchecked; else ''."""
    bare = F.trim(c)
    raw = F.when(bare.contains("[") | bare.contains("]"), F.regexp_replace(bare, r"^[\[\]]+|[\[\]]+$", "")).otherwise(bare)
    parsed = lambda x: F.date_format(first_day(x, "yyyy-M-d", *DATE_FORMATS), "yyyy-MM-dd")
    return let(raw, lambda x: F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x).otherwise(F.coalesce(parsed(x), F.lit(""))))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def word_pairs(words: Column) -> Column:
    """All pairs of different words of a list as structs (u, v), in the order of the list."""
    at = F.sequence(F.lit(1), F.size(words) - 1)
    pairs = F.flatten(F.transform(at, lambda i: F.transform(F.slice(words, i + 1, F.size(words) - i), lambda v: F.struct(F.element_at(words, i).alias("u"), v.alias("v")))))
    return F.when(F.size(words) >= 2, F.transform(pairs, lambda p: F.struct(F.least(p["u"], p["v"]).alias("u"), F.greatest(p["u"], p["v"]).alias("v"))))


def lev_le(a: Column, b: Column, k: int) -> Column:
    return F.levenshtein(a, b, k) >= 0


def same_identity(kind: Column, a: Column, b: Column) -> Column:
    """Do two canonical forms of one kind name the same thing?"""
    ta, tb = tokens(a), tokens(b)
    shared, union = F.size(F.array_intersect(ta, tb)), F.size(F.array_union(ta, tb))
    small = F.least(F.size(ta), F.size(tb))
    subset = (shared == small) & (shared >= F.least(F.lit(2), small))
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    inside = long.contains(short) & (F.length(short) / F.greatest(F.length(long), F.lit(1)) >= 0.55)
    fuzzy = (small > 0) & (subset | ((shared >= 2) & (shared / F.greatest(union, F.lit(1)) > 0.5)) | inside | ((shared >= 1) & lev_le(a, b, 3)))
    a0, b0 = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return (a0 == b0) | ((a0 != "") & (b0 != "") & kind.isin("person", "org") & F.coalesce(fuzzy, F.lit(False)))


def canon_for(kind: Column, text: Column, canonical: Column) -> Column:
    """The stored canonical form, or one derived by kind."""
    derived = F.when(kind == "org", canon_org(text)).when(kind == "person", canon_name(text)).otherwise(F.lower(F.trim(text)))
    return F.when(canonical.isNotNull() & (canonical != ""), canonical).otherwise(F.coalesce(derived, F.lit("")))


def merchant(c: Column) -> Column:
    """Upper-cased merchant cut at * or #, long digit runs and a closing country tag dropped."""
    out = F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"[*#].*$", ""), r"\b\d{4,}\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+(SG|US|IE|UK|IN|MY|AU|CA|HK|JP|TH|PH)$", ""), r"\s+", " "))


def clean_merchant(c: Column) -> Column:
    """Words with three digits or more dropped; the original where nothing is left."""
    words = F.filter(F.split(F.trim(F.regexp_replace(c, r"\*", " ")), r"\s+"), lambda w: F.length(F.regexp_replace(w, r"[^0-9]", "")) < 3)
    out = F.regexp_replace(F.array_join(words, " "), r"^[ _.-]+|[ _.-]+$", "")
    return F.when(out == "", F.trim(c)).otherwise(out)


def norm_alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def human_size(c: Column) -> Column:
    """Bytes as B, KB, MB or GB, ties to even."""
    scaled = lambda power: F.format_string("%.1f", F.bround(c / float(1024**power), 1))
    return (
        F.when(c < 1024, F.format_string("%d B", c.cast("long"))).when(c < 1024**2, F.concat(scaled(1), F.lit(" KB")))
        .when(c < 1024**3, F.concat(scaled(2), F.lit(" MB"))).otherwise(F.concat(scaled(3), F.lit(" GB")))
    )
