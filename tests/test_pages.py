"""Pages of words laid out where their document stands: odd texts against the SQL, and plans that shuffle no words."""

import random

import pytest

from quire import plans

ODD = [(1, "a\x0bb c\rd\n\n \t\ne f\x85g h i"), (2, None), (3, ""), (4, " ".join(f"w{i}" for i in range(5000))), (6, "one two\nthree"), (5, "ü 漢字 😀x\fy\n" * 12), (7, "\n".join(f"{'left ' * 9}{i}" for i in range(40)))]


def frame(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def compared(spark, tmp_path, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    said = con.execute(plans.SQL[name])
    columns = [d[0] for d in said.description]
    return sorted(map(str, said.fetchall())), sorted(str(tuple(r)) for r in plans.QUERIES[name](spark, str(tmp_path)).select(*columns).collect())


@pytest.mark.parametrize("name", ["pdf_rows", "pdf_gutter", "q_locate"])
def test_odd_texts_as_in_sql(spark, tmp_path, name):
    rnd = random.Random(1)
    many = [(i, "\n".join(" ".join("w" * rnd.randint(1, 9) for _ in range(rnd.randint(0, 14))) for _ in range(rnd.randint(1, 40)))) for i in range(10, 60)]
    # Of repeated ids the words' order is open, so they are asked for their rows alone.
    same = [] if name == "q_locate" else [(6, "and one more"), (7, "right\nhere\x0band there")]
    frame(spark, tmp_path, ODD + many + same)
    want, got = compared(spark, tmp_path, name)
    assert want == got


@pytest.mark.parametrize("name", ["q_locate", "pdf_rows", "pdf_gutter", "src_pdf_columns"])
def test_no_words_are_shuffled(spark, tmp_path, name):
    frame(spark, tmp_path, ODD)
    plan = plans.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
