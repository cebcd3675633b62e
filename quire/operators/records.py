"""Records extracted from documents: field access, confidence, trust, alerts, views and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.values import dates, watch_date

# Name parts that hint at a field's kind, tried in this order.
HINTS = (
    ("email", ("email", "e-mail")),
    ("date", ("date", "expiry", "expire", "expiration", "issued", "issue", "dob", "valid", "born", "renewal", "effective")),
    ("percent", ("percent", "rate", "apr", "interest")),
    ("money", ("amount", "total", "price", "due", "balance", "sum", "paid", "premium", "salary", "fee", "cost", "value", "limit", "coverage")),
)
DATE_SHAPE = r"(?i)(\d{1,4}[-/.\s]\d{1,2}[-/.\s]\d{1,4})|((jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2})"
# Keys that may hold a deadline, in the order they are tried.
DEADLINES = (
    "expiry_date", "valid_until", "valid_thru", "valid_till", "expiration_date", "date_of_expiry", "expires_on",
    "policy_end_date", "coverage_end_date", "end_date", "due_date", "payment_due_date", "due",
)
# Date formats of deadlines, days before months.
DEADLINE_FORMATS = ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yy", "d-MMMM-yy")


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def kind_expected(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit(None).cast("string")
    for kind, hints in reversed(HINTS):
        hit = F.lit(False)
        for h in hints:
            hit = hit | low.contains(h)
        out = F.when(hit, kind).otherwise(out)
    return out


def kind_match(value: Column, kind: Column) -> Column:
    v = F.trim(value)
    digit = v.rlike(r"\d")
    return (
        F.when(kind == "email", v.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")).when(kind == "date", v.rlike(DATE_SHAPE))
        .when(kind == "percent", digit & (v.contains("%") | F.lower(v).contains("percent"))).when(kind == "money", digit).otherwise(True)
    )


def field_score(name: Column, value: Column, grounded: Column, base: Column) -> Column:
    """Confidence of one field value: base, plus grounding, plus or minus its shape; 0 if empty."""
    kind = kind_expected(name)
    shape = F.when(kind.isNull(), 0.0).when(kind_match(value, kind), 0.1).otherwise(-0.3)
    return F.when(value.isNull() | (F.trim(value) == ""), 0.0).otherwise(clamp(base + F.when(grounded, 0.15).otherwise(0.0) + shape))


def unpivot(docs: DataFrame, key: str = "doc_id", fields: str = "fields") -> DataFrame:
    """(key, name, value) of the scalar, non-empty fields of JSON objects."""
    pairs = docs.select(key, F.explode(F.from_json(fields, "map<string,string>")).alias("name", "value"))
    return pairs.filter("value IS NOT NULL AND trim(value) <> '' AND NOT (value LIKE '[%' OR value LIKE '{%')")


def trust(docs: DataFrame) -> DataFrame:
    """Adds score, level and state from status, type, confidence, low pages, uncertain fields and review."""
    status, kind, conf = F.coalesce("status", F.lit("")), F.col("doc_type"), F.col("confidence")
    score = F.coalesce(conf, F.lit(0.7)) - F.when(kind.isNull() | (kind == "unclassified"), 0.25).otherwise(0.0)
    score = score - F.when(F.col("low_pages") > 0, F.least(F.lit(0.3), 0.1 + 0.05 * F.col("low_pages"))).otherwise(0.0)
    score = F.round(clamp(score - F.least(F.lit(0.3), 0.05 * F.coalesce("uncertain", F.lit(0)))), 3)
    ready, reviewed = status == "ready", F.coalesce("review", F.lit("")) == "reviewed"
    score = F.when(~ready, 0.0).when(reviewed, 1.0).otherwise(score)
    level = F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")
    state = (
        F.when(~ready, "unprocessed").when(reviewed, "verified").when(F.coalesce("n_fields", F.lit(0)) == 0, "unstructured")
        .when(level == "high", "trusted").when(level == "medium", "review").otherwise("needs_review")
    )
    return docs.select("*", score.alias("score"), level.alias("level"), state.alias("state"))


def deadline(fields: Column) -> Column:
    """struct(date, key): the first key of DEADLINES whose text is a date, days before months; a record is parsed once."""
    held = lambda m: F.filter(F.transform(F.array(*map(F.lit, DEADLINES)), lambda k: F.struct(k.alias("key"), F.try_element_at(m, k).alias("raw"))), lambda x: x["raw"].isNotNull())
    told = F.transform(let(F.from_json(fields, "map<string,string>", {"allowUnquotedControlChars": "true"}), held), lambda x: F.struct(dates(x["raw"], *DEADLINE_FORMATS).alias("date"), x["key"].alias("key")))
    return F.get(F.filter(told, lambda x: x["date"].isNotNull()), F.lit(0))


def alerts(docs: DataFrame, as_of: str, soon: int = 30, low: float = 0.6) -> DataFrame:
    """(doc_id, type, severity, days) of documents (doc_id, status, doc_type, confidence, low_pages, fields)."""
    docs, due = docs.withColumn("_due", deadline(F.col("fields"))), F.col("_due")
    days = F.datediff(due["date"], F.lit(as_of))
    pay = F.coalesce(due["key"].rlike("due|payment"), F.lit(False))
    alert = lambda kind, severity, d=None: F.struct(kind.alias("type") if isinstance(kind, Column) else F.lit(kind).alias("type"), F.lit(severity).alias("severity"), (F.lit(None).cast("int") if d is None else d).alias("days"))
    ready = F.col("status") == "ready"
    weak = F.col("doc_type").isNull() | (F.col("doc_type") == "unclassified")
    rules = F.array_compact(F.array(
        F.when(F.col("status") == "failed", alert("ingestion_failed", "high")),
        F.when(ready & (days < 0), alert(F.when(pay, "overdue").otherwise("expired"), "high", days)),
        F.when(ready & days.between(0, soon), alert(F.when(pay, "due_soon").otherwise("expiring_soon"), "warn", days)),
        F.when(ready & weak, alert("unclassified", "review")),
        F.when(ready & ~weak & (F.col("confidence") < low), alert("low_confidence", "review")),
        F.when(ready & (F.col("low_pages") > 0), alert("low_ocr_confidence", "review")),
    ))
    # A plain explode would first filter by the size of the rules, with the deadline worked out anew for each mention of it.
    return docs.select("doc_id", F.explode_outer(rules).alias("a")).filter("a IS NOT NULL").select("doc_id", "a.type", "a.severity", "a.days")


def urgency(days: Column) -> Column:
    return F.when(days < 0, "overdue").when(days <= 7, "urgent").when(days <= 30, "soon").when(days <= 90, "upcoming").otherwise("info")


def export(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Flat table of scalar fields, one column each."""
    return unpivot(docs).groupBy("doc_id").pivot("name", columns).agg(F.first("value"))


def watched(docs: DataFrame, as_of: str, back: int = 45) -> DataFrame:
    """(doc_id, name, kind, days, urgency) of the dated fields worth watching, up to ``back`` days past."""
    f = unpivot(docs.filter("status = 'ready'").select("doc_id", "fields"))
    days = F.datediff(watch_date(F.col("value")), F.lit(as_of))
    kind = F.when(F.col("name").rlike("expir|valid_until|valid_to|expires"), "expiry").when(F.col("name").rlike("payment_due|due_date"), "payment").when(F.col("name").contains("renew"), "renewal")
    w = f.select("doc_id", "name", kind.alias("kind"), days.alias("days")).filter(F.col("kind").isNotNull() & (F.col("days") >= -back))
    return w.withColumn("urgency", urgency(F.col("days")))


def merged_alerts(watch: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, type): watch-list entries in place of their document's own date alerts, and all other alerts."""
    dated = found.filter("days IS NOT NULL").join(watch.select("doc_id").distinct(), "doc_id", "left_anti")
    return watch.select("doc_id", F.col("kind").alias("type")).unionByName(dated.select("doc_id", "type")).unionByName(found.filter("days IS NULL").select("doc_id", "type"))


def balanced(statements: DataFrame) -> DataFrame:
    """Adds expected (opening and net) and ok: within 1 % of the closing balance, or 1."""
    expected = F.col("opening") + F.col("net")
    return statements.select("*", expected.alias("expected"), (F.abs(expected - F.col("closing")) <= F.greatest(F.abs("closing") * 0.01, F.lit(1.0))).alias("ok"))
