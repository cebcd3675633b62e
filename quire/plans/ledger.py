"""Queries over the star schema: insights, reconciliation, validators, dashboards and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import insights, reconcile
from ..session import table
from .registry import query


def _spend(spark, sf):
    """Line amounts with the supplier's nation and region."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    return (
        lines.join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(table(spark, sf, "region").select("r_regionkey", "r_name")), F.col("n_regionkey") == F.col("r_regionkey"))
    )


@query("ins_concentration", """
WITH per AS (SELECT r_name AS party, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name),
s AS (SELECT party, total, total / sum(total) OVER () AS share FROM per)
SELECT party, CAST(total AS DOUBLE) AS total, round(CAST(share AS DOUBLE), 4) AS share,
  CASE WHEN share >= 0.5 THEN 'high' WHEN share >= 0.35 THEN 'medium' ELSE 'low' END AS severity FROM s WHERE share >= 0.1""")
def ins_concentration(spark, sf):
    spend = _spend(spark, sf).select(F.col("r_name").alias("party"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    found = insights.concentration(spend, "party", "amount", threshold=0.1)
    return found.select("party", F.col("total").cast("double").alias("total"), F.round(F.col("share").cast("double"), 4).alias("share"), "severity")


@query("ins_counterparty", """
WITH e AS (SELECT n_name, count(DISTINCT l_orderkey) AS expense_docs FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
r AS (SELECT n_name, count(DISTINCT o_orderkey) AS revenue_docs FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT n_name, expense_docs, revenue_docs, CASE WHEN expense_docs + revenue_docs >= 6 THEN 'high' WHEN expense_docs + revenue_docs >= 3 THEN 'medium' ELSE 'low' END AS severity
FROM e JOIN r USING (n_name)""")
def ins_counterparty(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = F.broadcast(table(spark, sf, "nation").select("n_nationkey", "n_name"))
    revenue = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return insights.counterparties(_spend(spark, sf).select("n_name", F.col("l_orderkey").alias("doc")), revenue.select("n_name", F.col("o_orderkey").alias("doc")), "n_name", "doc")


@query("ins_subscription", """
WITH p AS (SELECT o_custkey AS party, count(*) AS occurrences, max(CAST(o_orderdate AS DATE)) AS last_seen FROM orders GROUP BY 1),
g AS (SELECT party, occurrences, date_diff('day', last_seen, max(last_seen) OVER ()) AS gap_days FROM p)
SELECT party, occurrences, gap_days, CASE WHEN occurrences >= 3 AND gap_days > 60 THEN 'stopped' ELSE 'single' END AS finding,
 CASE WHEN occurrences >= 3 AND gap_days >= 120 THEN 'high' WHEN occurrences >= 3 AND gap_days > 60 THEN 'medium' ELSE 'low' END AS severity
FROM g WHERE occurrences = 1 OR (occurrences >= 3 AND gap_days > 60)""")
def ins_subscription(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("party"), F.to_date("o_orderdate").alias("day"))
    return insights.subscription_drift(orders, "party", "day")


@query("ins_category", """
WITH m AS (SELECT l_returnflag AS category, date_trunc('month', l_shipdate) AS month, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem GROUP BY 1, 2),
l AS (SELECT max(month) AS latest FROM m),
h AS (SELECT category, avg(CAST(total AS DOUBLE)) AS mean, stddev_samp(CAST(total AS DOUBLE)) AS sd, count(*) AS n FROM m, l WHERE month < latest GROUP BY 1)
SELECT category, CAST(total AS DOUBLE) AS total, round(mean, 2) AS mean, round((CAST(total AS DOUBLE) - mean) / sd, 4) AS z,
 CASE WHEN abs((CAST(total AS DOUBLE) - mean) / sd) >= 3 THEN 'high' WHEN abs((CAST(total AS DOUBLE) - mean) / sd) >= 2 THEN 'medium' ELSE 'low' END AS severity
FROM m JOIN l ON month = latest JOIN h USING (category) WHERE n >= 2 AND sd > 0 AND abs((CAST(total AS DOUBLE) - mean) / sd) >= 1.5""")
def ins_category(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("category"), F.date_trunc("month", "l_shipdate").alias("month"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    monthly = lines.groupBy("category", "month").agg(F.sum("amount").cast("double").alias("amount"))
    z = insights.category_outliers(monthly, "category", "month", "amount")
    return z.select("category", "total", F.round("mean", 2).alias("mean"), F.round("z", 4).alias("z"), "severity")


@query("ins_continuity", """
WITH s AS (SELECT DISTINCT o_custkey AS party, date_trunc('month', o_orderdate) AS month FROM orders), l AS (SELECT max(month) AS latest FROM s),
p AS (SELECT party, count(*) FILTER (WHERE month < latest) AS prior_months, bool_or(month = latest) AS now FROM s, l GROUP BY 1)
SELECT party, prior_months, CASE WHEN prior_months >= 6 THEN 'high' ELSE 'medium' END AS severity FROM p WHERE NOT now AND prior_months >= 3""")
def ins_continuity(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("party"), F.date_trunc("month", "o_orderdate").alias("month"))
    return insights.continuity_gaps(orders, "party", "month")


@query("ins_drill", """
WITH c AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 20)
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM c) ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def ins_drill(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    busy = orders.groupBy("o_custkey").count().filter("count >= 20")
    return insights.drill(orders, busy, "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")])


def _receipts(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("vendor"), (F.floor(F.col("o_totalprice") / 20000) * 20000).alias("amount"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("claimant"), F.to_date("o_orderdate").alias("date"))


@query("rec_dup", """
WITH r AS (SELECT o_orderkey AS id, o_custkey AS vendor, floor(o_totalprice / 20000) AS amount, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS claimant, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT a.id AS a, b.id AS b, abs(date_diff('day', a.d, b.d)) AS gap,
 CASE abs(date_diff('day', a.d, b.d)) WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.8 END AS confidence
FROM r a JOIN r b ON a.vendor = b.vendor AND a.amount = b.amount AND a.claimant IS NOT DISTINCT FROM b.claimant AND a.id < b.id AND abs(date_diff('day', a.d, b.d)) <= 3""")
def rec_dup(spark, sf):
    return reconcile.duplicate_receipts(_receipts(spark, sf))


@query("rec_dup_signals", """
WITH v AS (SELECT o_orderkey, o_orderkey % 5 AS gap, CASE WHEN o_custkey % 3 <> 0 THEN o_orderpriority END AS claimant FROM orders)
SELECT o_orderkey, 'vendor_match|amount_match|' || CASE WHEN claimant IS NULL THEN 'no_claimant_on_either' ELSE 'claimant_match' END || '|' ||
 CASE WHEN gap = 0 THEN 'date_match' WHEN gap <= 3 THEN 'date_within_' || gap || 'd' ELSE 'date_unknown' END AS signals FROM v""")
def rec_dup_signals(spark, sf):
    claimant = F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(reconcile.signals(F.col("o_orderkey") % 5, claimant), "|").alias("signals"))


@query("rec_pay", """
WITH r AS (SELECT o_orderkey AS id, o_custkey AS vendor, o_orderpriority AS currency, o_totalprice AS amount, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders),
t AS (SELECT o_orderkey + 1 AS id, o_custkey AS vendor, o_orderpriority AS currency, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE o_totalprice * (0.94 + (o_orderkey % 13) * 0.01) END AS amount, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 8 AS INTEGER) AS d FROM orders),
m AS (SELECT r.id AS receipt, t.id AS line, date_diff('day', r.d, t.d) AS gap, r.amount = t.amount AS exact FROM r JOIN t ON r.vendor IS NOT DISTINCT FROM t.vendor AND r.currency = t.currency
 AND abs(r.amount - t.amount) <= greatest(r.amount * 0.05, 0.5) AND (r.d IS NULL OR t.d IS NULL OR date_diff('day', r.d, t.d) BETWEEN 0 AND 5))
SELECT receipt, line, gap, exact, round(CASE WHEN exact THEN c ELSE greatest(0.55, c - 0.15) END, 2) AS confidence
FROM (SELECT *, CAST(CASE WHEN gap IS NULL THEN 0.70 WHEN gap <= 1 THEN 1.0 WHEN gap <= 3 THEN 0.95 ELSE 0.85 END AS DOUBLE) AS c FROM m)""")
def rec_pay(spark, sf):
    o = table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    receipts = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("vendor"), F.col("o_orderpriority").alias("currency"), F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderkey") % 11 != 0, day).alias("date"))
    paid = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).otherwise(F.col("o_totalprice") * (0.94 + (F.col("o_orderkey") % 13) * 0.01))
    lines = o.select((F.col("o_orderkey") + 1).alias("id"), F.col("o_custkey").alias("vendor"), F.col("o_orderpriority").alias("currency"), paid.alias("amount"), F.date_add(day, (F.col("o_orderkey") % 8).cast("int")).alias("date"))
    return reconcile.match_payments(receipts, lines).withColumn("confidence", F.round("confidence", 2))


@query("rec_rev", """
WITH i AS (SELECT o_orderkey AS id, o_custkey AS customer, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS d FROM orders),
c AS (SELECT o_orderkey + 7 AS id, o_custkey AS customer, o_totalprice AS amount, CASE WHEN o_orderkey % 4 = 0 THEN 'debit' ELSE 'credit' END AS direction, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS d FROM orders)
SELECT i.id AS invoice, c.id AS credit, date_diff('day', i.d, c.d) AS gap,
 CASE WHEN date_diff('day', i.d, c.d) <= 1 THEN 1.0 WHEN date_diff('day', i.d, c.d) <= 7 THEN 0.95 WHEN date_diff('day', i.d, c.d) <= 15 THEN 0.88 ELSE 0.78 END AS confidence
FROM i JOIN c USING (customer, amount) WHERE direction = 'credit' AND date_diff('day', i.d, c.d) BETWEEN 0 AND 30""")
def rec_rev(spark, sf):
    o = table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    base = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("amount"), day.alias("date"))
    credits = o.select((F.col("o_orderkey") + 7).alias("id"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderkey") % 4 == 0, "debit").otherwise("credit").alias("direction"), F.date_add(day, (F.col("o_orderkey") % 40).cast("int")).alias("date"))
    return reconcile.match_revenue(base, credits)


@query("rev_dupset", """
WITH r AS (SELECT o_orderkey AS id, o_custkey AS vendor, floor(o_totalprice / 20000) AS amount, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS claimant, CAST(o_orderdate AS DATE) AS d FROM orders),
p AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.vendor = b.vendor AND a.amount = b.amount AND a.claimant IS NOT DISTINCT FROM b.claimant AND a.id < b.id AND abs(date_diff('day', a.d, b.d)) <= 3)
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT a FROM p UNION ALL SELECT b FROM p)""")
def rev_dupset(spark, sf):
    pairs = reconcile.duplicate_receipts(_receipts(spark, sf))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(ids, "o_orderkey", "left_semi")


@query("val_total", """
WITH t AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_totalprice, CAST(lines AS DOUBLE) AS lines FROM orders JOIN t ON l_orderkey = o_orderkey
WHERE abs(o_totalprice - CAST(lines AS DOUBLE)) > greatest(0.01 * abs(o_totalprice), 1.0)""")
def val_total(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("lines"))
    both = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    off = F.abs(F.col("o_totalprice") - F.col("lines")) > F.greatest(0.01 * F.abs("o_totalprice"), F.lit(1.0))
    return both.filter(off).select("o_orderkey", "o_totalprice", "lines")


@query("val_due", """SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate""")
def val_due(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return lines.join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate < o_orderdate").select("l_orderkey", "l_linenumber")


@query("db_kpi", """SELECT count(*) AS doc_count, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spend, count(DISTINCT o_custkey) AS parties, count(*) FILTER (WHERE o_orderstatus = 'P') AS needs_attention FROM orders""")
def db_kpi(spark, sf):
    return table(spark, sf, "orders").agg(F.count("*").alias("doc_count"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total_spend"), F.countDistinct("o_custkey").alias("parties"), F.count_if(F.col("o_orderstatus") == "P").alias("needs_attention"))


@query("db_donut", """
WITH g AS (SELECT p_brand AS label, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
s AS (SELECT label, total, round(100 * CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE), 1) AS pct FROM g)
SELECT label, CAST(total AS DOUBLE) AS total, pct FROM s ORDER BY total DESC, label LIMIT 8""")
def db_donut(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("label"))
    lines = table(spark, sf, "lineitem").select("l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    s = insights.shares(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), "label", "amount")
    pct = F.round(100 * F.col("total").cast("double") / F.col("grand").cast("double"), 1)
    return s.orderBy(F.desc("total"), "label").limit(8).select("label", F.col("total").cast("double").alias("total"), pct.alias("pct"))


@query("db_bars", """
WITH g AS (SELECT s_name AS label, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
SELECT label, CAST(total AS DOUBLE) AS total, round(100 * CAST(total AS DOUBLE) / CAST(max(total) OVER () AS DOUBLE), 1) AS pct_of_max FROM g ORDER BY total DESC, label LIMIT 10""")
def db_bars(spark, sf):
    suppliers = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("label"))
    lines = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    per = lines.groupBy("l_suppkey").agg(F.sum("amount").alias("part")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("label").agg(F.sum("part").alias("total"))
    top = per.orderBy(F.desc("total"), "label").limit(10)
    return top.select("label", F.col("total").cast("double").alias("total"), F.round(100 * F.col("total").cast("double") / F.max("total").over(Window.partitionBy()).cast("double"), 1).alias("pct_of_max"))


@query("db_trend", """SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 24""")
def db_trend(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.count("*").alias("n"))
    return o.orderBy(F.desc("month")).limit(24)


@query("win_cumulative", """
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * CAST(o_totalprice AS DECIMAL(18,2))) AS net FROM orders GROUP BY 1)
SELECT month, CAST(net AS DOUBLE) AS net, CAST(sum(net) OVER (ORDER BY month) AS DOUBLE) AS cumulative FROM m""")
def win_cumulative(spark, sf):
    sign = F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1)
    m = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(sign * F.col("o_totalprice").cast("decimal(18,2)")).alias("net"))
    return insights.running_total(m, "net", "month").select("month", F.col("net").cast("double").alias("net"), F.col("cumulative").cast("double").alias("cumulative"))


@query("win_first_last", """SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1""")
def win_first_last(spark, sf):
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(at)["o_orderkey"].alias("first_order"), F.max(at)["o_orderkey"].alias("last_order"))


@query("win_latest_month", """
SELECT strftime(o_orderdate, '%Y-%m') = (SELECT max(strftime(o_orderdate, '%Y-%m')) FROM orders) AS is_latest, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1""")
def win_latest_month(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"))
    latest = m.agg(F.max("month").alias("latest"))
    return m.join(F.broadcast(latest)).groupBy((F.col("month") == F.col("latest")).alias("is_latest")).agg(F.sum("n").alias("n"), F.sum("t").cast("double").alias("total"))


@query("top_per_ccy", """SELECT o_orderpriority AS currency, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS high_doc, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS low_doc FROM orders GROUP BY 1""")
def top_per_ccy(spark, sf):
    big, small = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))), F.min(F.struct("o_totalprice", F.col("o_orderkey").alias("k")))
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("currency")).agg(big["o_totalprice"].alias("high"), small["o_totalprice"].alias("low"), (-big["k"]).alias("high_doc"), small["k"].alias("low_doc"))


@query("top_k", """SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM orders GROUP BY 1 ORDER BY spend DESC, o_custkey LIMIT 10""")
def top_k(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend")).orderBy(F.desc("spend"), "o_custkey").limit(10)


@query("set_union_all", """
SELECT src, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total FROM (
 SELECT 'receipt' AS src, o_totalprice AS amount FROM orders UNION ALL SELECT 'statement', l_extendedprice FROM lineitem) GROUP BY 1""")
def set_union_all(spark, sf):
    a = table(spark, sf, "orders").select(F.lit("receipt").alias("src"), F.col("o_totalprice").alias("amount"))
    b = table(spark, sf, "lineitem").select(F.lit("statement").alias("src"), F.col("l_extendedprice").alias("amount"))
    return a.unionByName(b).groupBy("src").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"))


@query("set_except", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def set_except(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("flt_timeframe", """SELECT o_orderkey FROM orders WHERE o_orderdate IS NULL OR o_orderdate >= TIMESTAMP '1997-01-01'""")
def flt_timeframe(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_orderdate").isNull() | (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))).select("o_orderkey")


@query("flt_months", """
WITH c AS (SELECT date_trunc('month', max(o_orderdate)) - INTERVAL 5 MONTH AS cutoff FROM orders)
SELECT o_orderkey FROM orders, c WHERE o_orderdate >= cutoff""")
def flt_months(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    cutoff = o.agg(F.add_months(F.trunc(F.max("o_orderdate"), "MM"), -5).alias("cutoff"))
    return o.join(F.broadcast(cutoff)).filter("o_orderdate >= cutoff").select("o_orderkey")


@query("th_expense", """
SELECT l_shipmode AS category, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS average FROM lineitem GROUP BY 1""" .replace("l_shipmode", "l_returnflag"))
def th_expense(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("category")).agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return g.withColumn("average", F.round(F.col("total") / F.col("n"), 4))


@query("th_financial", """
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS inflow,
 CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus <> 'F') AS DOUBLE) AS outflow FROM orders GROUP BY 1)
SELECT month, coalesce(inflow, 0) AS inflow, coalesce(outflow, 0) AS outflow, round(coalesce(inflow, 0) - coalesce(outflow, 0), 2) AS net FROM m""")
def th_financial(spark, sf):
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    g = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", amount)).cast("double"), F.lit(0.0)).alias("inflow"),
        F.coalesce(F.sum(F.when(F.col("o_orderstatus") != "F", amount)).cast("double"), F.lit(0.0)).alias("outflow"),
    )
    return g.withColumn("net", F.round(F.col("inflow") - F.col("outflow"), 2))


@query("qa_money", """
SELECT o_orderpriority AS currency, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS average,
 max(o_totalprice) AS high, min(o_totalprice) AS low, count(*) FILTER (WHERE o_totalprice > 100000) AS over FROM orders GROUP BY 1""")
def qa_money(spark, sf):
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("currency")).agg(
        F.count("*").alias("n"), total.alias("total"), F.round(total / F.count("*"), 2).alias("average"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.count_if(F.col("o_totalprice") > 100000).alias("over")
    )


@query("agg_filtered_counts", """SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_n, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F'), 0) AS DOUBLE) AS finished_total FROM orders GROUP BY 1""")
def agg_filtered_counts(spark, sf):
    done = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(done).alias("finished"), F.count_if(F.col("o_orderstatus") == "O").alias("open_n"), F.coalesce(F.sum(F.when(done, F.col("o_totalprice").cast("decimal(18,2)"))), F.lit(0)).cast("double").alias("finished_total"))


@query("dup_table_rows", """SELECT count(*) AS n FROM (SELECT DISTINCT l_shipdate, l_extendedprice, l_partkey FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem))""")
def dup_table_rows(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_shipdate", "l_extendedprice", "l_partkey")
    return lines.unionByName(lines).dropDuplicates(["l_shipdate", "l_extendedprice", "l_partkey"]).agg(F.count("*").alias("n"))


@query("q_anomaly", """
SELECT o_orderkey, concat_ws('|', CASE WHEN o_totalprice = 0 THEN 'zero_amount' END, CASE WHEN o_totalprice > 400000 THEN 'large_amount' END, CASE WHEN o_orderdate > TIMESTAMP '1998-08-01' THEN 'future_date' END, CASE WHEN o_orderdate < TIMESTAMP '1992-02-01' THEN 'old_date' END) AS anomalies
FROM orders WHERE o_totalprice = 0 OR o_totalprice > 400000 OR o_orderdate > TIMESTAMP '1998-08-01' OR o_orderdate < TIMESTAMP '1992-02-01'""")
def q_anomaly(spark, sf):
    at = F.col("o_orderdate")
    found = F.array_compact(F.array(F.when(F.col("o_totalprice") == 0, "zero_amount"), F.when(F.col("o_totalprice") > 400000, "large_amount"), F.when(at > F.lit("1998-08-01").cast("timestamp"), "future_date"), F.when(at < F.lit("1992-02-01").cast("timestamp"), "old_date")))
    return table(spark, sf, "orders").select("o_orderkey", found.alias("a")).filter(F.size("a") > 0).select("o_orderkey", F.array_join("a", "|").alias("anomalies"))


@query("rev_auto", """SELECT o_orderkey, o_totalprice < 300000 AND o_orderstatus <> 'P' AS approved FROM orders""")
def rev_auto(spark, sf):
    reasons = F.array_compact(F.array(F.when(F.col("o_totalprice") >= 300000, "large_amount"), F.when(F.col("o_orderstatus") == "P", "partial")))
    return table(spark, sf, "orders").select("o_orderkey", (F.size(reasons) == 0).alias("approved"))
