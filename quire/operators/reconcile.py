"""Reconciliation of receipts, statement lines and revenue: self, band and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_confidence(days: Column) -> Column:
    return F.when(days.isNull(), 0.55).when(days == 0, 1.00).when(days == 1, 0.90).when(days <= 3, 0.80).otherwise(0.0)


def duplicate_receipts(receipts: DataFrame, days: int = 3) -> DataFrame:
    """Pairs (a < b) of one vendor and amount, equal or both unknown claimants, dates ``days`` apart or unknown.

    ``receipts``: id, vendor, amount, claimant, date.  The equalities are join keys and dates meet within
    buckets of ``days + 1``, so a popular vendor and price does not pair up across the years.
    """
    width = days + 1
    bucket = F.floor(F.datediff("date", F.lit("1970-01-01")) / width)
    a = receipts.select(F.col("id").alias("a"), "vendor", "amount", F.col("claimant").alias("ca"), F.col("date").alias("da"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("k")).filter("da IS NOT NULL")
    b = receipts.select(F.col("id").alias("b"), "vendor", "amount", F.col("claimant").alias("cb"), F.col("date").alias("db"), bucket.alias("k")).filter("db IS NOT NULL")
    dated = a.join(b, ["vendor", "amount", "k"]).filter((F.col("a") < F.col("b")) & F.col("ca").eqNullSafe(F.col("cb")))
    dated = dated.withColumn("gap", F.abs(F.datediff("da", "db"))).filter(F.col("gap") <= days).select("a", "b", "gap")
    all_ = receipts.select(F.col("id").alias("b"), "vendor", "amount", F.col("claimant").alias("cb"), F.col("date").alias("db"))
    none = receipts.filter("date IS NULL").select(F.col("id").alias("a"), "vendor", "amount", F.col("claimant").alias("ca"))
    undated = none.join(all_, ["vendor", "amount"]).filter((F.col("a") != F.col("b")) & F.col("ca").eqNullSafe(F.col("cb")))
    undated = undated.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(None).cast("int").alias("gap")).distinct()
    return dated.unionByName(undated).withColumn("confidence", duplicate_confidence(F.col("gap")))


def signals(gap: Column, claimant: Column) -> Column:
    """What speaks for a duplicate, as an array in fixed order."""
    party = F.when(claimant.isNotNull(), "claimant_match").otherwise("no_claimant_on_either")
    dated = F.when(gap == 0, "date_match").when(gap <= 3, F.concat(F.lit("date_within_"), gap.cast("string"), F.lit("d"))).otherwise("date_unknown")
    return F.array(F.lit("vendor_match"), F.lit("amount_match"), party, dated)


def payment_confidence(days: Column) -> Column:
    return F.when(days.isNull(), 0.70).when(days <= 1, 1.00).when(days <= 3, 0.95).when(days <= 5, 0.85).otherwise(0.0)


def match_payments(receipts: DataFrame, lines: DataFrame, days: int = 5, share: float = 0.05, floor: float = 0.50) -> DataFrame:
    """Receipts and statement lines of one currency and vendor, the line 0 to ``days`` days later or undated,
    the amounts equal or within the larger of ``share`` of the receipt and ``floor``.

    ``receipts``/``lines``: id, vendor, currency, amount, date.  Amounts meet through logarithmic buckets
    wide enough that matches are at most one bucket apart; small amounts share the lowest bucket.
    """
    step = 0.11

    def bucket(x: Column) -> Column:
        return F.floor(F.log(F.greatest(x, F.lit(10.0))) / step)

    r = receipts.select(F.col("id").alias("receipt"), "vendor", "currency", F.col("amount").alias("ra"), F.col("date").alias("rd"), F.explode(F.array(bucket(F.col("amount")) - 1, bucket(F.col("amount")), bucket(F.col("amount")) + 1)).alias("k"))
    t = lines.select(F.col("id").alias("line"), F.col("vendor").alias("tv"), F.col("currency").alias("tc"), F.col("amount").alias("ta"), F.col("date").alias("td"), bucket(F.col("amount")).alias("tk"))
    met = r.join(t, (F.col("k") == F.col("tk")) & F.col("vendor").eqNullSafe(F.col("tv")) & (F.col("currency") == F.col("tc")))
    gap = F.datediff("td", "rd")
    near = F.abs(F.col("ra") - F.col("ta")) <= F.greatest(F.col("ra") * share, F.lit(floor))
    met = met.filter(near & (gap.isNull() | gap.between(0, days))).withColumn("gap", gap).withColumn("exact", F.col("ra") == F.col("ta"))
    base = payment_confidence(F.col("gap"))
    return met.select("receipt", "line", "gap", "exact", F.when(F.col("exact"), base).otherwise(F.greatest(F.lit(0.55), base - 0.15)).alias("confidence"))


def revenue_confidence(days: Column) -> Column:
    return F.when(days.isNull(), 0.65).when(days <= 1, 1.00).when(days <= 7, 0.95).when(days <= 15, 0.88).when(days <= 30, 0.78).otherwise(0.0)


def match_revenue(invoices: DataFrame, credits: DataFrame, days: int = 30) -> DataFrame:
    """Invoices and credit lines of one customer and exact amount, the credit 0 to ``days`` days later."""
    i = invoices.select(F.col("id").alias("invoice"), "customer", "amount", F.col("date").alias("issued"))
    c = credits.filter("direction = 'credit'").select(F.col("id").alias("credit"), "customer", "amount", F.col("date").alias("paid"))
    met = i.join(c, ["customer", "amount"]).withColumn("gap", F.datediff("paid", "issued")).filter(F.col("gap").isNull() | F.col("gap").between(0, days))
    return met.select("invoice", "credit", "gap", revenue_confidence(F.col("gap")).alias("confidence"))


def replace_run(earlier: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, src, dst, confidence, status) after a run: what it found is proposed, what someone confirmed before stays.

    Edges of the run before that nobody confirmed go unless found again; an edge confirmed and found again
    keeps its confirmation and takes the new confidence.
    """
    key = ["kind", "src", "dst"]
    kept = earlier.filter("status = 'confirmed'").select(*key, F.col("confidence").alias("was"), F.col("status").alias("before"))
    both = found.select(*key, "confidence").join(kept, key, "full")
    return both.select(*key, F.coalesce("confidence", "was").alias("confidence"), F.coalesce("before", F.lit("proposed")).alias("status"))
