"""What grows with the input is not shuffled by query and document."""

import os

import pytest

from quire import plans

SF = "/root/testdata/sf0.001"
NAMES = ["ret_lexical", "win_rank_lists", "ret_fairness", "ret_keyword_docs", "ret_graph", "txt_lines_spatial", "ent_reconcile_fields", "ent_bootstrap"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    said = con.execute(plans.SQL[name])
    columns = [d[0] for d in said.description]
    assert sorted(map(str, said.fetchall())) == sorted(str(tuple(r)) for r in plans.QUERIES[name](spark, SF).select(*columns).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["ret_lexical", "win_rank_lists", "ret_fairness"])
def test_no_pairs_of_query_and_document_are_shuffled(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning(qid" in line and "doc#" in line.split("hashpartitioning")[1].split(")")[0] for line in plan.splitlines())


def test_keywords_are_looked_up_where_texts_stand(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quire.operators import search

    texts = spark.range(40).select(F.col("id").alias("tid"), F.concat(F.lit("Some text of "), "id", F.lit("}")).alias("text"))
    asked = spark.createDataFrame([(i, f"{i}}}") for i in range(30)] + [(50, "OF 3"), (51, "some"), (52, "e")], "pid int, pattern string")
    want = {(p, t) for p, x in map(tuple, asked.collect()) for t in range(40) if x.lower() in f"some text of {t}}}"}
    dealt = search.blocks
    for size in (50_000, 4):
        monkeypatch.setattr(search, "blocks", lambda values, n=size: dealt(values, n))
        found = search.containing(asked, texts)
        assert sorted(map(tuple, found.collect())) == sorted(want)
        assert "gram" not in found._jdf.queryExecution().optimizedPlan().toString()
    docs = texts.select(F.col("tid").alias("doc"), F.lit("n").alias("name"), F.lit("k").alias("kind"), F.lit("f").alias("fields"))
    found = search.keyword_documents(asked.select(F.col("pid").alias("qid"), F.col("pattern").alias("text")), docs, texts.select(F.col("tid").alias("doc"), F.lit(0).alias("idx"), "text"))
    assert {(r.qid, r.doc) for r in found.collect()} >= want
    assert "term#" not in found._jdf.queryExecution().executedPlan().toString()


def test_lines_meet_the_chunks_of_their_page_in_one_row(spark):
    from quire.operators import overlap

    kind = "page int, chunks array<struct<chunk:int,kind:string,text:string,y0:double,y1:double>>, lines array<struct<line:int,y0:double,h:double,text:string>>"
    lines = [(i, i / 50, 0.02, t) for i, t in enumerate(["Total", "ab", "", None, "total", "x" * 900, *(f"row {i}" for i in range(44))])]
    chunks = [(0, "text", " the TOTAL, ab " + "x" * 899, None, None), (1, "table", "t", 0.5, 0.52), (2, "table", "t", None, None), (3, None, "total", 0.0, 1.0), (4, "text", "row 1", None, None), (5, "text", "x" * 901, None, None)]
    rows = [(1, chunks, lines), (2, chunks[:1], []), (3, chunks[1:2], None), (4, [], lines)]
    found = overlap.lines_of_pages(spark.createDataFrame(rows, kind))
    got = {(r.page, r.chunk): r.lines for r in found.collect()}
    full = [i for i, *_, t in lines if t]
    near = [i for i in full if (i / 50) + 0.02 >= 0.48 and i / 50 <= 0.54]
    assert got == {(1, 0): [0, 1, 4], (1, 1): near, (1, 2): full, (1, 3): None, (1, 4): [7], (1, 5): [5], (2, 0): None, (3, 1): None}
    if os.path.isdir(SF):
        assert "Exchange" not in plans.QUERIES["txt_lines_spatial"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_each_script_is_counted_once(spark):
    from pyspark.sql import functions as F

    from quire.functions import text as T

    df = spark.createDataFrame([("plain words",), ("слово word",), ("漢字" * 3 + " ab",), ("1 2 !",), ("",), ("aaaaaaaaaaaaaaaaaaaд",)], "s string").select("s", T.mixed_script(F.col("s")).alias("mixed"))
    assert [r.mixed for r in df.collect()] == [False, True, True, False, False, False]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= len(T.SCRIPTS)


def test_a_transcript_is_read_once(spark):
    from pyspark.sql import functions as F

    from quire.functions import values as V

    few, many = "\n".join(f"line {i} of several words here" for i in range(10)), "\n".join(["the same line again"] * 7 + ["another"] * 3)
    df = spark.createDataFrame([(few,), (many,), ("I'm sorry, but nothing here can be read at all, not one word",)], "s string").select(V.transcript_gate(F.col("s")).alias("g")).select("g.ok", "g.score", "g.reason")
    assert [r.reason for r in df.collect()] == ["ok", "repetitive", "refusal"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 2


def test_records_are_read_in_one_pass_with_all_their_oddities(spark):
    from quire.operators import mapping

    docs = [
        (1, '{"a": 1, "a": "twice"}'), (2, '{"payee": NaN}'), (3, '{"payee": "\\u00e9 \\u20ac", "n": ' + "9" * 30 + "}"), (4, '  [{"holder": "x y"}, "bare", ["lost"]]'), (5, '"text"'),
        (6, '{"l1": {"l2": {"l3": {"l4": {"l5": {"l6": {"l7": {"city": "eighth", "l8": {"city": "ninth"}}}}}}}}}'), (7, '{"owners": ' + str([f"n {i}" for i in range(50)]).replace("'", '"') + "}"),
    ]
    found = mapping.leaves(spark.createDataFrame(docs, "doc int, fields string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc, r.field, r.value) for r in found.collect() if r.doc != 7)
    assert got == [(3, "payee", "é €"), (4, "", "bare"), (4, "holder", "x y"), (6, "city", "eighth")]
    assert found.filter("doc = 7").count() == 40
