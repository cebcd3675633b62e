"""The library without its optional subpackage: registry, functions, sources, streams and random checks."""

import os

import pytest
from pyspark.sql import functions as F

from quire import plans
from quire.engine import Engine
from quire.functions import names, text, values
from quire.operators import documents, graph, usage
from quire.session import Scope
from quire.sources import readers
from quire.streaming import streams

SF = "/root/testdata/sf0.001"


def test_every_sql_names_a_query():
    assert set(plans.SQL) <= set(plans.QUERIES) and len(plans.QUERIES) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["ins_concentration", "rec_pay", "fn_page_quality", "ret_retrieve", "st_ratelimit", "gr_traverse"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got = plans.QUERIES[name](spark, SF)
    want = con.sql(plans.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    show = lambda rows, at: sorted(tuple(f"{r[at[c]]:.6g}" if isinstance(r[at[c]], float) else str(r[at[c]]) for c in cols) for r in rows)
    assert show(got.collect(), {c: got.columns.index(c) for c in cols}) == show(want.fetchall(), {c: want.columns.index(c) for c in cols})


def test_scope_closes_on_an_empty_set(spark):
    df = spark.createDataFrame([("t", 1, 1), ("t", 2, 1), ("u", 1, 1)], "tenant_id string, vendor_id long, owner_id long")
    assert Scope("t").apply(df).count() == 2 and Scope("t", frozenset({2})).apply(df).count() == 1
    assert Scope("t", frozenset()).apply(df).count() == 0 and Scope().apply(df).count() == 3


def test_names_with_marks(spark):
    v = spark.createDataFrame([("Dr. ÉLAN Öz",), ("((x))",), ("Foo Pte Ltd Inc",)], "s string")
    got = [tuple(r) for r in v.select(names.canon_name(F.col("s")), names.canon_org(F.col("s"))).collect()]
    assert got[0][0] == "élan öz" and got[2] == ("foo pte ltd inc", "foo pte ltd")


def test_shingles_of_few_words(spark):
    v = spark.createDataFrame([("the quick brown fox",), ("Hello World",), ("",), (None,)], "s string")
    assert [r[0] for r in v.select(text.shingles(F.col("s"))).collect()] == [["the quick brown", "quick brown fox"], ["hello world"], [], []]


def test_transcript_gate(spark):
    cases = {"": "empty", "short": "too_short", "I'm sorry, but there is nothing in this picture to read": "refusal", "a" * 20 + " " + "b" * 20: "too_few_words",
             "one two three four five six seven eight nine ten eleven": "ok", "\n".join(["a b c"] * 12): "repetitive", "\x01\x02 " * 30: "garbled"}
    v = spark.createDataFrame([(c,) for c in cases], "s string")
    assert {r[0]: r[1] for r in v.select("s", values.transcript_gate(F.col("s"))["reason"]).collect()} == cases


def test_redaction_is_undone_and_keeps_one_token_for_a_value():
    text = "Patient: Ann Lee, SSN 123-45-6789 and again 123-45-6789; card 4111 1111 1111 1111 not 4111 1111 1111 1112. Pagoda Goda"
    out, mapping = documents.Redactor((("org", "Goda"),))(text)
    assert out.count("[SSN_1]") == 2 and "[CREDIT_CARD_1]" in out and "1112" in out and "[PERSON_1]" in out and "Pagoda [ORG_1]" in out
    assert documents.restore(out, mapping) == text and documents.restore("[PERSON_99]", mapping) == "[PERSON_99]"
    assert documents.Redactor()(None) == (None, {}) and documents.Redactor()("") == ("", {})


def test_chunks_cover_their_page():
    page = "\n\n".join(["word " * n for n in (5, 30, 400, 3, 2, 60, 61, 1)])
    joined = " ".join(" ".join(b.split()) for b in page.split("\n\n"))
    for target, overlap in ((1000, 150), (200, 20), (50, 49)):
        spans = documents.pack(page, target, overlap)
        assert all(joined[a:b] == t and len(t) <= target for t, a, b in spans)
        assert {i for _, a, b in spans for i in range(a, b)} >= {i for i, c in enumerate(joined) if c != " "}
    assert documents.pack("") == [] and documents.keep_first(["a b c d e", "a b c d f"], 0.5) == [0] and documents.keep_first(["a b c d e", "a b c d f"], 0.99) == [0, 1]
    assert documents.nfkc("１２３ ﬁle\x00\t\n") == "123 file\t\n" and documents.nfkc(None) is None


def test_traversal_counts_a_node_at_each_depth(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long")
    got = {tuple(r) for r in graph.traverse(edges, spark.createDataFrame([(1,)], "node long"), 3, "out").collect()}
    assert got == {(1, 0), (2, 1), (3, 1), (3, 2), (4, 2), (4, 3)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("x;y\n1;  2\n;\n".encode("utf-16"))
    (tmp_path / "b.eml").write_bytes(b"From: a@b.c\r\nSubject: S\r\nContent-Type: text/html\r\n\r\n<p>hi &amp; ho</p>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    found = readers.files(spark, f"file://{tmp_path}")
    pages = {r.path[-5:]: r.text for r in readers.parse(found).collect()}
    assert pages == {"a.csv": "| x | y |\n| --- | --- |\n| 1 | 2 |", "b.eml": "From: a@b.c\nSubject: S\n\nhi & ho"}
    assert {r[0] for r in found.select(readers.sniff(F.col("content"))).collect()} == {None, "application/pdf"}
    assert readers.new_files(found, found.limit(3)).count() == 0
    kinds = [k for k, _ in readers.markdown_blocks("# T\n\n| a |\n| - |\n| 1 |\nName: x\n- p\n- q\nsome words\nmore")]
    assert kinds == ["heading", "table", "key_value", "list", "paragraph"]


def test_stream_limit_equals_batch_limit(spark, tmp_path):
    rows = [(i, i % 3, f"2026-01-01 00:{i // 2:02d}:00") for i in range(100)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    want = {tuple(r) for r in usage.rate_limit(df, ["user_id"], "ts", 2, 300).collect()}
    stream = streams.file_stream(spark, f"{tmp_path}/in", "event_id long, user_id long, ts timestamp")
    q = streams.rate_limit(stream, "user_id", "ts", 2, 300).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("limited").collect()} == want
    done = streams.ingest(stream, lambda d: d.filter("event_id % 2 = 0"), f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/cp")
    done.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50


def test_engine_searches_in_scope_and_takes_hooks(spark):
    engine = Engine(spark, Scope("t"))
    docs = spark.createDataFrame([(1, "t", "red ships sail far"), (2, "t", "green hills"), (3, "u", "red ships")], "doc long, tenant_id string, text string")
    asked = spark.createDataFrame([(7, "red ships")], "qid long, text string")
    hits = engine.search(asked, docs).collect()
    assert [h.doc for h in sorted(hits, key=lambda h: h.rank)] == [1, 2]
    engine.hooks["rerank"] = lambda h: h.limit(0)
    assert engine.search(asked, docs).count() == 0
