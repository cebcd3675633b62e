"""Text cleaning, quality, tokens, entities and PII patterns, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import let

# Words that carry no content.
STOP = tuple(
    "the a an of to in on at for and or but is are was were be been being this that "
    "these those it its as by with from into your you i we they he she his her their "
    "there here will would can could should may might do does did have has had not no "
    "yes if then else than so such which who whom whose what when where why how".split()
)
# Unicode ranges of scripts.
SCRIPTS = {
    "latin": r"\x{0041}-\x{024F}",
    "cjk": r"\x{4E00}-\x{9FFF}",
    "hiragana": r"\x{3040}-\x{309F}",
    "katakana": r"\x{30A0}-\x{30FF}",
    "hangul": r"\x{AC00}-\x{D7AF}",
    "arabic": r"\x{0600}-\x{06FF}",
    "devanagari": r"\x{0900}-\x{097F}",
    "thai": r"\x{0E00}-\x{0E7F}",
    "cyrillic": r"\x{0400}-\x{04FF}",
}
# Entity patterns; money needs a mark, checked apart.
ENTITIES = (
    ("money", r"(?i)\b(?:USD\s*)?\$?\s*(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(?:USD|million|M|K|billion|B)?\b"),
    ("standard", r"\bISO/IEC\s+\d{4,5}(?::\d{4})?\b"),
    ("date", r"\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}\b"),
    ("date", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("control_id", r"(?i)\b(?:CC\d+(?:\.\d+)?|REQ-\d+|A\.\d+(?:\.\d+)?(?:\.\d+)?|HIPAA|PCI-DSS(?:\s*v\d+)?|NIST\s+\d+-\d+|SOC\s*2(?:\s+Type\s*II)?|GDPR|CMMC)\b"),
    ("percent", r"\b\d{1,3}(?:\.\d+)?\s*%"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
)
# What a text must hold to have an entity of a kind; to look for that costs far less than the patterns.
MARKS = {"money": "[0-9]", "standard": "ISO/IEC", "date": "[0-9]{4}", "control_id": "(?iu)[0-9]|HIPAA|GDPR|CMMC", "percent": "%", "email": "@"}
# PII patterns in the order they are tried.
PII = {
    "credit_card": r"\b(?:\d[ -]?){13,19}\b",
    "nric": r"\b[STFGM]\d{7}[A-Z]\b",
    "aadhaar": r"\b\d{4}\s\d{4}\s\d{4}\b",
    "pan_in": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "gstin_in": r"\b\d{2}[A-Z]{5}\d{4}[A-Z]\d{1}Z[A-Z\d]\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "ein": r"\b\d{2}-\d{7}\b",
    "uk_nino": r"\b[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]\b",
    "passport": r"\b[A-Z]\d{6,9}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "email": r"\b[\w._%+-]+@[\w.-]+\.[A-Za-z]{2,}\b",
    "phone_e164": r"\+\d{1,3}[ -]?\(?\d{1,4}\)?[ -]?\d{2,4}[ -]?\d{2,9}",
    "phone_us": r"\b\(?\d{3}\)?[ -]\d{3}[ -]\d{4}\b",
    "dob": r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b",
    "dob_eu": r"\b(?:0[1-9]|[12]\d|3[01])/(?:0[1-9]|1[0-2])/(?:19|20)\d{2}\b",
    "ip_v4": r"\b(?:25[0-5]|2[0-4]\d|[01]?\d\d?)(?:\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)){3}\b",
}


def extract(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def sanitize(c: Column) -> Column:
    """Control characters dropped, tab, newline and return kept."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def content_tokens(c: Column) -> Column:
    """Distinct words of letters and digits, longer than one character, that are no stop words."""
    found = F.array_distinct(extract(F.lower(F.coalesce(c, F.lit(""))), "[a-z0-9]+"))
    return F.filter(F.array_except(found, F.array(*map(F.lit, STOP))), lambda t: F.length(t) > 1)


def sentences(c: Column) -> Column:
    """Trimmed sentences: cut after . ! ? and white space, and at newlines."""
    parts = F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\n"), "\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def shingles(c: Column, n: int = 3) -> Column:
    """Distinct word n-grams; fewer words give one joined shingle, none an empty array."""

    def of(words: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) < n, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(grams))

    return let(extract(F.lower(F.coalesce(c, F.lit(""))), "[a-z0-9]+"), of)


def html_text(c: Column) -> Column:
    """Scripts and styles dropped whole, tags as blanks, common entities decoded, white space collapsed."""
    out = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " "), "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def script_counts(c: Column) -> dict[str, Column]:
    return {name: F.length(F.regexp_replace(c, f"[^{span}]+", "")) for name, span in SCRIPTS.items()}


def mixed_script(c: Column, least: float = 0.1) -> Column:
    """At least two scripts with ``least`` of the counted characters each."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    many = lambda a, t: (t > 0) & (F.size(F.filter(a, lambda n: n / F.greatest(t, F.lit(1)) >= least)) >= 2)
    # Each script is counted once: the array and its sum are bound before they are read again.
    return F.transform(F.array(F.array(*script_counts(c).values())), lambda a: F.transform(F.array(total(a)), lambda t: many(a, t))[0])[0]


def page_quality(c: Column) -> Column:
    """struct(score, flags): cleanliness of a page's text from 0 to 1."""
    c = F.coalesce(c, F.lit(""))
    n = F.greatest(F.length(c), F.lit(1))
    solid = F.regexp_replace(c, r"\s", "")
    words = F.filter(F.split(c, r"\s+"), lambda t: t != "")
    share = lambda x: x / n
    broken = share(F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit(""))))
    printable = 1.0 - share(F.length(F.regexp_replace(c, r"[^\p{C}]|\s", "")))
    alnum = F.length(F.regexp_replace(solid, r"[^\p{L}\p{N}]", "")) / F.greatest(F.length(solid), F.lit(1))
    count = F.greatest(F.size(words), F.lit(1))
    mean = F.aggregate(words, F.lit(0), lambda a, t: a + F.length(t)) / count
    long_ = F.size(F.filter(words, lambda t: F.length(t) > 30)) / count
    rules = (
        ("replacement_chars", broken > 0.005, F.least(F.lit(0.6), broken * 4)),
        ("non_printable", printable < 0.98, F.least(F.lit(0.5), (1 - printable) * 3)),
        ("low_alpha", alnum < 0.55, F.least(F.lit(0.5), (0.55 - alnum) * 1.8)),
        ("run_on_tokens", long_ > 0.10, F.least(F.lit(0.35), long_ * 1.2)),
        ("fragmented", mean < 1.6, F.lit(0.2)),
    )
    score = F.lit(1.0)
    for _, when, cut in rules:
        score = score - F.when(when, cut).otherwise(0.0)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)
    flags = F.array_compact(F.array(*(F.when(when, name) for name, when, _ in rules)))
    blank, near = F.trim(c) == "", F.length(solid) < 10
    return F.struct(
        F.when(blank, 0.0).when(near, 0.1).otherwise(score).alias("score"),
        F.when(blank, F.array(F.lit("empty"))).when(near, F.array(F.lit("near_empty"))).otherwise(flags).alias("flags"),
    )


def ascii_only(pattern: str) -> str:
    """A pattern whose word boundaries and white space are those of ASCII letters, as RE2 has them; Java's go by Unicode and take a vertical tab.

    Where case does not count, RE2 takes the signs of Unicode that fold to a letter as well, but not for the letters of a word.
    """
    word = "[0-9A-Za-z_]"
    if "(?i)" in pattern:
        pattern, word = pattern.replace("(?i)", "(?iu)"), f"(?-iu:{word})"
    # Before a digit or a letter, and behind the word at the end, one side is known.
    pattern = re.sub(r"^\\b(?=\\d|[A-Za-z])", f"(?<!{word})", pattern)
    pattern = f"{pattern[:-2]}(?!{word})" if pattern.endswith(r"\b") and not re.search(r"\\s\*\(\?:[^()]*\)\?\\b$", pattern) else pattern
    return pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))").replace(r"\s", r"[\t\n\f\r ]")


def entities(df: DataFrame, key: str, column: str, patterns: tuple[tuple[str, str], ...] = ENTITIES) -> DataFrame:
    """(key, kind, value, family, number, year, format): distinct entities of each row; money only with a currency mark or a magnitude.

    A standard has its family, number and year, an ISO day its format; else these are null.
    """
    lists = []
    for kind, pattern in patterns:
        # trim itself would be given the place in the list as the characters to trim.
        mark = MARKS.get(kind, "")
        there = F.col(column).rlike(mark) if re.search(r"[^\w@%/]", mark) else F.contains(column, F.lit(mark))
        found = F.when(there, extract(F.col(column), pattern)).otherwise(F.array().cast("array<string>"))
        found = F.transform(found, lambda v: F.trim(v, F.lit(" \t\n\f\r")))
        if kind == "money":
            found = F.filter(found, lambda v: F.lower(v).rlike(r"\$|usd|million|billion|[mkb]$"))
        if kind == "control_id":
            found = F.transform(found, lambda v: F.replace(F.upper(v), F.lit("  "), F.lit(" ")))
        lists.append(_tagged(found, kind))
    out = df.select(key, F.explode(F.array_distinct(F.flatten(F.array(*lists)))).alias("e"))
    standard = lambda c: F.when(F.col("kind") == "standard", c)
    number, year = F.regexp_extract("value", r"\d{4,5}", 0), F.regexp_extract("value", r":(\d{4})$", 1)
    iso = F.when((F.col("kind") == "date") & F.col("value").rlike(r"^\d{4}-"), "iso")
    return out.select(key, "e.kind", "e.value").filter("value <> ''").select("*", standard(F.lit("ISO/IEC")).alias("family"), standard(number).alias("number"), standard(F.nullif(year, F.lit(""))).alias("year"), iso.alias("format"))


def _tagged(values: Column, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def pii_count(c: Column, kind: str) -> Column:
    pattern = PII[kind] if kind != "email" else ENTITIES[-1][1]
    return F.size(extract(c, pattern)).cast("long")


def size_strategy(pages: Column) -> Column:
    return F.when(pages >= 300, "huge").when(pages >= 100, "large").when(pages >= 30, "medium").otherwise("small")


def link_kind(url: Column) -> Column:
    """Which puller a share link needs; folder shares win over single files."""
    u = F.lower(url)
    return (
        F.when(u.contains("drive.google.com") & u.contains("/folders/"), "drive_folder")
        .when((u.contains("dropbox.com") & (u.contains("/sh/") | u.contains("/scl/fo/"))) | u.endswith(".zip"), "zip")
        .otherwise("single_file")
    )


def safe_filename(c: Column, fallback: str = "upload.bin") -> Column:
    """Last path part without control, quote and separator characters, 200 characters at most."""
    last = F.regexp_extract(F.replace(c, F.lit("\\"), F.lit("/")), "[^/]*$", 0)
    name = F.regexp_replace(F.regexp_replace(last, r"[\p{Cntrl}\"\r\n;]", ""), r"^[ .]+|[ .]+$", "")
    return F.when(F.coalesce(name, F.lit("")) == "", fallback).otherwise(F.substring(name, 1, 200))


def strip_empty_rows(c: Column) -> Column:
    """A Markdown text without table rows whose cells are all empty."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda r: ~r.rlike(r"^\|(\s*\|)+\s*$")), "\n")


def reference_range(c: Column) -> Column:
    """struct(low, high) of a written range: a - b, > a, < b or up to b."""
    number = lambda rx: F.regexp_extract(c, rx, 1).try_cast("double")
    both = c.rlike(r"^\s*[0-9.]+\s*-\s*[0-9.]+")
    low = F.when(both, number(r"([0-9.]+)\s*-")).when(c.rlike(r"^\s*>"), number("([0-9.]+)"))
    high = F.when(both, number(r"-\s*([0-9.]+)")).when(F.lower(c).rlike(r"^\s*(<|up to)"), number("([0-9.]+)"))
    return F.struct(low.alias("low"), high.alias("high"))


def relative_day(days: Column) -> Column:
    """A number of days from today in words."""
    ahead = F.when(days < 60, F.concat(F.lit("in "), days.cast("string"), F.lit(" days"))).otherwise(F.concat(F.lit("in "), F.floor(days / 30).cast("string"), F.lit(" months")))
    return F.when(days < 0, F.concat((-days).cast("string"), F.lit(" days ago"))).when(days == 0, "today").otherwise(ahead)
