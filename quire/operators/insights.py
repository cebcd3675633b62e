"""Audit insights over ledgers: concentration, both-side parties, drift, outliers and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def severity(value: Column, high: float, medium: float) -> Column:
    return F.when(value >= high, "high").when(value >= medium, "medium").otherwise("low")


def shares(df: DataFrame, key: str, amount: str) -> DataFrame:
    """Total and share of the whole for each key; a grand total of zero gives shares of zero.

    Totals are summed by key first, so the sum over everything runs on one row a key.
    """
    per = df.groupBy(key).agg(F.sum(amount).alias("total"))
    grand = per.agg(F.sum("total").alias("grand"))
    return per.join(F.broadcast(grand)).withColumn("share", F.when(F.col("grand") > 0, F.col("total") / F.col("grand")).otherwise(0.0))


def concentration(df: DataFrame, key: str, amount: str, threshold: float = 0.25) -> DataFrame:
    found = shares(df, key, amount).filter(F.col("share") >= threshold)
    return found.select(key, "total", "share", severity(F.col("share"), 0.50, 0.35).alias("severity"))


def counterparties(expense: DataFrame, revenue: DataFrame, party: str, doc: str) -> DataFrame:
    """Parties on both sides of the books, with the number of documents on each."""
    e = expense.groupBy(party).agg(F.countDistinct(doc).alias("expense_docs"))
    r = revenue.groupBy(party).agg(F.countDistinct(doc).alias("revenue_docs"))
    return e.join(r, party).withColumn("severity", severity(F.col("expense_docs") + F.col("revenue_docs"), 6, 3))


def subscription_drift(df: DataFrame, party: str, date: str) -> DataFrame:
    """Recurring parties that fell silent (3 or more payments, over 60 days ago), and one-off parties."""
    per = df.groupBy(party).agg(F.count("*").alias("occurrences"), F.max(date).alias("last_seen"))
    latest = per.agg(F.max("last_seen").alias("latest"))
    per = per.join(F.broadcast(latest)).withColumn("gap_days", F.datediff("latest", "last_seen")).drop("latest")
    stopped = (F.col("occurrences") >= 3) & (F.col("gap_days") > 60)
    found = per.filter(stopped | (F.col("occurrences") == 1))
    return found.select(
        party, "occurrences", "gap_days", F.when(stopped, "stopped").otherwise("single").alias("finding"),
        F.when(stopped & (F.col("gap_days") >= 120), "high").when(stopped, "medium").otherwise("low").alias("severity"),
    )


def category_outliers(df: DataFrame, category: str, month: str, amount: str, limit: float = 1.5) -> DataFrame:
    """Latest month's total of each category against its earlier months: |z| of ``limit`` or more.

    Categories need two earlier months and a deviation above zero.
    """
    monthly = df.groupBy(category, month).agg(F.sum(amount).alias("total"))
    latest = monthly.agg(F.max(month).alias("latest"))
    monthly = monthly.join(F.broadcast(latest))
    old = monthly.filter(F.col(month) < F.col("latest")).groupBy(category).agg(F.avg("total").alias("mean"), F.stddev_samp("total").alias("sd"), F.count("*").alias("n"))
    new = monthly.filter(F.col(month) == F.col("latest")).select(category, "total")
    z = new.join(old.filter((F.col("n") >= 2) & (F.col("sd") > 0)), category).withColumn("z", (F.col("total") - F.col("mean")) / F.col("sd"))
    return z.filter(F.abs("z") >= limit).withColumn("severity", severity(F.abs("z"), 3, 2))


def continuity_gaps(df: DataFrame, party: str, month: str, least: int = 3) -> DataFrame:
    """Parties present in ``least`` or more earlier months but absent from the latest."""
    seen = df.select(party, month).distinct()
    latest = seen.agg(F.max(month).alias("latest"))
    seen = seen.join(F.broadcast(latest))
    per = seen.groupBy(party).agg(F.count_if(F.col(month) < F.col("latest")).alias("prior_months"), F.max(F.col(month) == F.col("latest")).alias("current"))
    found = per.filter(~F.col("current") & (F.col("prior_months") >= least))
    return found.select(party, "prior_months", F.when(F.col("prior_months") >= 6, "high").otherwise("medium").alias("severity"))


def drill(facts: DataFrame, findings: DataFrame, key: str, order: list[Column], limit: int = 100) -> DataFrame:
    """Source rows behind findings, at most ``limit`` (a report's length)."""
    return facts.join(findings.select(key).distinct(), key, "left_semi").orderBy(*order).limit(limit)


def running_total(df: DataFrame, amount: str, order: str) -> DataFrame:
    """Running sum over a monthly series; emitted only when there are two points or more."""
    w = Window.orderBy(order)
    out = df.withColumn("cumulative", F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return out.withColumn("points", F.count("*").over(whole)).filter("points >= 2").drop("points")
