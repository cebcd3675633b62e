"""Steps that once cost more than their input: each is held to its result and to how often it is worked out."""

import pytest
from pyspark.sql import functions as F

from quire import plans
from quire.functions import names, shapes
from quire.operators import graph, retrieval, workspace
from quire.operators import records as X

ODD = ["1995-01-02", "02/01/1995", "13/01/1995", "31-02-2026", "3 JANUARY 1995", "May 3, 1995", "3-may-95", "+3-5-1995", "003/005/1995", "+12000-1-1", "-1995-1-1", " 1995-1-1", "1995-01-02\n", "3-MAY-+95", "3 Aprıl 1995", "0-1-1995", "1/+2/1995", "199-1-1", "", "29-2-2023", "29-2-2024", None]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("pattern", sorted({*X.DEADLINE_FORMATS, *names.DATE_FORMATS, "yyyy/M/d"}))
def test_the_shape_of_a_date_turns_no_date_away(spark, pattern):
    rows = spark.createDataFrame([(s,) for s in ODD], "s string").select("s", F.try_to_date("s", pattern).cast("string").alias("a"), names.day(F.col("s"), pattern).cast("string").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)
    assert "RLIKE" in plan(spark.range(1).select(names.day(F.col("id").cast("string"), pattern)))


def test_alerts_parse_a_record_once(spark):
    docs = spark.createDataFrame([(1, "ready", "invoice", 0.9, 0, '{"end_date": "soon", "due": "1/2/1996"}'), (2, "ready", "x", 0.9, 0, '["due"]'), (3, "ready", "x", 0.9, 0, '{"due": "1996-06-20", '), (4, "ready", "x", 0.9, 0, None)], "doc_id long, status string, doc_type string, confidence double, low_pages int, fields string")
    found = X.alerts(docs, "1996-06-15")
    assert [(r["doc_id"], r["type"], r["days"]) for r in found.collect()] == [(1, "overdue", -135)]
    assert plan(found).count("from_json") == 1 and "get_json_object" not in plan(found)


def test_identities_without_a_frequent_word(spark):
    """All pairs of some hundred odd names by ``same_identity``, and one word that a thousand share."""
    import itertools
    import random

    rng = random.Random(3)
    words = ["ann", "lee", "j", "bo", "goda", "marsh", "marsch", "o", "x1", "li"]
    forms = {rng.choice([" ", "-", "  "]).join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(150)} | {"", "日本", "日本 x", "j", "ann-", "lee ann", "ann lee", "a b", "a c", "a-b"}
    m = spark.createDataFrame([(i, kind, f) for i, (kind, f) in enumerate(itertools.product(("person", "date"), sorted(forms)))], "id long, kind string, canonical string")
    a, b = m.select(*(F.col(c).alias(c + "_a") for c in m.columns)), m.select(*(F.col(c).alias(c + "_b") for c in m.columns))
    same = a.join(b, (F.col("kind_a") == F.col("kind_b")) & (F.col("id_a") < F.col("id_b"))).filter(names.same_identity(F.col("kind_a"), F.col("canonical_a"), F.col("canonical_b"))).select(F.col("id_a").alias("x"), F.col("id_b").alias("y"))
    root = {i: i for i in range(m.count())}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in same.collect():
        x, y = sorted((find(x), find(y)))
        root[y] = x
    for often in (0, 2, 64):
        assert {r["id"]: r["root"] for r in graph.cluster(m, often).collect()} == {i: find(i) for i in root}


def test_subsets_are_met_by_their_rarest_words(spark):
    groups = spark.createDataFrame([(f"w{i} j v{i}",) for i in range(3000)] + [(f"v{i} w{i}",) for i in range(3000)] + [("j",), ("j k",), ("k j j",)], "name string")
    found = workspace.merge_name_subsets(groups)
    into = {r["name"]: r["into"] for r in found.collect()}
    assert len(into) == 6003 and all(into[f"v{i} w{i}"] == f"w{i} j v{i}" for i in range(3000)) and into["j"] == "j" and into["k j j"] == "k j j"
    assert workspace.subset_candidates(groups).count() < 20_000


@pytest.mark.parametrize("block", [7, 1 << 14])
def test_blocks_of_vectors_rank_as_pairs_do(spark, block):
    rows = [(i, [float((i * 7 + j * j) % 5 - 2) for j in range(4)]) for i in range(60)]
    rows += [(100, None), (101, [0.0] * 4), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, 2.0]), (104, [float("nan")] * 4), (105, [float("inf"), 0.0, 0.0, 1.0]), (106, []), (107, rows[3][1])]
    v = spark.createDataFrame(rows, "vid long, vec array<float>")
    q = v.filter("vid % 5 = 0 OR vid > 99").select(F.col("vid").alias("qid"), "vec")
    pairs = v.filter("vec IS NOT NULL").crossJoin(q.withColumnRenamed("vec", "qv"))
    want = retrieval.top(pairs.select("qid", "vid", F.round(retrieval.cosine(F.col("vec"), F.col("qv")), 6).alias("sim")), ["qid"], [F.desc("sim"), F.asc("vid")], 5)
    got = retrieval.cosine_topk(q, v, 5, block)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "BroadcastNestedLoopJoin" not in plan(got) and "Cartesian" not in plan(got)


def test_names_are_taken_apart_once_and_paired_on_all_cores(spark, tmp_path):
    spark.createDataFrame([(i, f"Supplier#{i:09d}") for i in range(1, 201)], "s_suppkey long, s_name string").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    found = plans.QUERIES["ret_trgm"](spark, str(tmp_path))
    assert found.count() == 4 * 199
    join = plan(found).split("BroadcastNestedLoopJoin")
    assert "regexp_extract_all" not in join[0] and "REPARTITION_BY_NUM" in join[1]


def test_six_decimals_round_the_binary_value(spark):
    row = spark.sql("SELECT array(cast(0.0000005 as float), cast(pow(2D, -7) as float), cast(3 * pow(2D, -7) as float), cast(-1e-9 as float), cast(12345.678 as float)) AS v").select(shapes.vector_literal(F.transform("v", lambda x: x.cast("double"))).alias("s"), "v").first()
    assert row["s"] == "[" + ",".join(f"{x:.6f}" for x in row["v"]) + "]"


@pytest.mark.parametrize("name", ["pii_redact", "pii_vault", "chk_page", "dup_greedy"])
def test_long_texts_reach_python_in_small_batches(spark, name):
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(size)
    try:
        spark.conf.unset(size)
        plans.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(size).rstrip("b")) <= 16 << 20
    finally:
        spark.conf.set(size, before)


def test_entities_go_by_ascii_words_as_their_sql_does(spark, tmp_path):
    import duckdb

    texts = ["é2024-01-01é 12 Jan 2024", "ж5% 7\x0b% 8 %", "日a@b.co語 ünï@x.de", "éISO/IEC 27001 ISO/IEC\x0b27001", "a2024-01-01", None, "9.5%\n3 March 2020"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, plans.QUERIES["ent_regex"](spark, str(tmp_path)).collect())) == sorted(con.execute(plans.SQL["ent_regex"]).fetchall())
