"""Queries that once lost or changed part of their result, each against its SQL on a small table."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quire import plans
from quire.functions import names, text
from quire.operators import graph


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def compared(spark, folder, query, **tables):
    """Rows of a query's SQL and of the query over ``tables``, (rows, schema) each."""
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    said = con.execute(plans.SQL[query])
    columns = [d[0] for d in said.description]
    return sorted(map(str, said.fetchall())), sorted(str(tuple(r)) for r in plans.QUERIES[query](spark, str(folder)).select(*columns).collect())


def test_values_keep_their_digits_and_ids_may_repeat(spark, tmp_path):
    rows = [(1, "0% 10.5% 21% 2024-01-02 3.33% 1999-12-31"), (2, "a@b.co"), (2, "a@b.co 5%"), (None, "7%"), (None, "7%"), (3, "10,000,000% 1a@b.co")]
    want, got = compared(spark, tmp_path, "ent_regex", documents=(rows, "doc_id long, text string"))
    assert want == got and any(x.startswith("(1, 'percent', '10.5%'") for x in got)


def test_parts_are_trimmed_of_blanks_alone(spark):
    df = spark.createDataFrame([("0 first 0\n 1 second 1 \n2",)], "s string")
    assert df.select(text.sentences(F.col("s"))).first()[0] == ["0 first 0", "1 second 1", "2"]
    assert spark.createDataFrame([("Ann Lee 0 and Bo Marsh 1",)], "s string").select(names.split_people(F.col("s"))).first()[0] == ["Ann Lee 0", "Bo Marsh 1"]


@pytest.mark.parametrize("name", ["res_cluster", "agg_identity_rebuild", "gr_identities"])
def test_parts_of_names_do_not_go_through_the_driver(spark, tmp_path, name, monkeypatch):
    """A name's substrings and quarters are many times the table, which looks small enough to be sent to all tasks."""
    seen, label = [], graph.label_components
    monkeypatch.setattr(graph, "label_components", lambda nodes, pairs: seen.append(pairs) or label(nodes, pairs))
    want, got = compared(spark, tmp_path, name, customer=([(i, i % 25) for i in range(300)], "c_custkey long, c_nationkey int"))
    assert want == got
    # The few frequent words alone may be sent.
    assert plan(seen[0]).count("BroadcastHashJoin") <= 4 and plan(seen[0]).count("SortMergeJoin") > 8


def test_entities_of_all_kinds(spark, tmp_path):
    said = ["pays USD 10,000,000 or\n100 USD, $5 footnote, 3 M, 12 apples, 2026", "ISO/IEC 27001:2013 and ISO/IEC 27002", "3 March 2020 2020-03-03", "soc  2 type ii, cc6.1, PCI-DSS v4, ſoc 2ſ", "8\u212a 1.5billion 9\x0bM", None]
    rows = [*enumerate(said)]
    want, got = compared(spark, tmp_path, "ent_regex", documents=(rows, "doc_id long, text string"))
    assert want == got
    assert {"(0, 'money', '100 USD', None, None, None, None)", "(1, 'standard', 'ISO/IEC 27001:2013', 'ISO/IEC', '27001', '2013', None)", "(2, 'date', '2020-03-03', None, None, None, 'iso')", "(2, 'date', '3 March 2020', None, None, None, None)", "(3, 'control_id', 'CC6.1', None, None, None, None)"} <= {*got}


def test_pages_of_many_chunks(spark, tmp_path):
    rng = random.Random(5)
    block = lambda n: "".join(rng.choice("ab ﬁ é😀\t\n\x0b\x85 ") for _ in range(n))
    texts = [rng.choice(["\n\n", "\n \t\n\n", "\n\n\n"]).join(block(rng.choice([0, 3, 60, 149, 150, 151, 400, 849, 1000, 1001, 1850, 5200])) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    texts += [None, "", " \n\n ", "x" * 1000, "x" * 1001, "\n\n".join(["x" * 150] * 30)]
    want, got = compared(spark, tmp_path, "chk_page", documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert want == got and len(got) > 900


def test_pages_are_laid_out_in_arrow_batches(spark, tmp_path):
    from quire.operators import layout
    from quire.plans import boxes

    rng = random.Random(6)
    texts = ["\n".join(" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(4, 7))) for _ in range(30)) for _ in range(12)] + ["a\x0bb c\n\n ü 漢字 😀x\fy", "", None, " ".join(f"w{i % 7}" for i in range(3000))]
    spark.createDataFrame([*enumerate(texts), (1, "of one id")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = plans.QUERIES["src_pdf_columns"](spark, str(tmp_path))
    assert "MapInArrow" in plan(found) and "transform(" not in plan(found)
    # As the boxes that Spark's own functions make of the texts.
    same = layout.columns(boxes._two_columns(spark, str(tmp_path)), 600.0, headings=0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, same.collect())) and found.count() > 100


def test_entities_of_records_are_told_where_they_stand(spark, tmp_path):
    tables = {
        "nation": ([(0, "FRANCE"), (1, "PERU")], "n_nationkey int, n_name string"),
        "customer": ([(1, "Customer#1", 0), (2, "Ann Lee / Bo Marsh", 1)], "c_custkey long, c_name string, c_nationkey int"),
        "orders": ([(1, 1, "P", "1-URGENT"), (2, 1, "F", "2-HIGH"), (3, 1, None, "1-URGENT"), (4, 1, "O", "5-LOW"), (5, 9, "P", "5-LOW")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "lineitem": ([(k, p, 10.5 * p, 1.0) for k in (1, 2, 3) for p in (7, 7, 8)], "l_orderkey long, l_partkey long, l_extendedprice double, l_quantity double"),
    }
    day = "1995-01-02 03:04:05"
    for again in ([], [(1, 1, "F", "5-LOW"), (2, 1, "P", "2-HIGH")]):  # ids that repeat, pending in one row only
        folder = tmp_path / str(len(again))
        rows, schema = tables["orders"]
        frame = [(*r, day) for r in rows + again]
        spark.createDataFrame(frame, schema + ", d string").selectExpr("*", "CAST(d AS timestamp_ntz) AS o_orderdate").drop("d").coalesce(1).write.parquet(f"{folder}/orders.parquet")
        con = duckdb.connect()
        for name, (rows, schema) in tables.items():
            if name != "orders":
                spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
        found = plans.QUERIES["ent_bootstrap"](spark, str(folder))
        exchanges = [p for p in plan(found).splitlines() if "Exchange hashpartitioning" in p]
        assert sorted(map(tuple, found.collect()), key=str) == sorted(con.execute(plans.SQL["ent_bootstrap"]).fetchall(), key=str)
        # Without repeated ids nothing is shuffled by order but orders and lines, once, and no entities.
        assert len(again) or (sum("orderkey" in p for p in exchanges) == 2 and not any("kind#" in p or "doc#" in p for p in exchanges))


def test_lexical_ranks_by_trigrams_too(spark, tmp_path):
    docs = [(1, "licences of software"), (2, "the license"), (3, "nothing here"), (4, None), (5, ""), (6, "日本 licensed licensed"), (7, "zz 9 9a")]
    asked = [(1, "license of softwares"), (2, "ß?"), (3, "licensing 9"), (4, "here nothing nothing")]
    want, got = compared(spark, tmp_path, "ret_lexical", documents=(docs, "doc_id long, text string"), benchmark=(asked, "item_id long, text string"))
    assert want == got and len(got) == 4 * 7


def test_a_field_is_of_the_same_kind_in_python(spark):
    from quire.operators import mapping

    said = ["Country", "ship_to", "total_due", "AMOUNT", "sku_number", "policy_no", "Vendor", "KIBAN", "", "zip", "line_items", "due_date", "tax_id", "buyer name"]
    rows = spark.createDataFrame([(s,) for s in said], "s string").select("s", mapping.kind_of(F.col("s")).alias("k")).collect()
    assert {r.s: r.k for r in rows} == {s: mapping.said_kind(s) for s in said}
