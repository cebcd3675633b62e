"""Every query over strings against its SQL on the smallest tables, and the forms that the dialects write alike."""

import os

import pytest

from quire import plans
from quire.plans import strings

SF = "/root/testdata/sf0.001"
NAMES = ["fn_parse_money", "fn_parse_amount_max", "fn_canon_money", "fn_canon_date", "fn_parse_date_watch", "fn_canon_label", "fn_person_key", "fn_merchant_canon", "val_expired", "res_same", "rec_scan", "qa_chain", "sink_chunks", "ret_crag", "ret_graph", "ret_keyword_docs", "txt_lines_spatial", "join_box_overlap", "join_interval_overlap", "q_locate", "pdf_gutter", "fn_mixed_script"]


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, con, name):
    got = plans.QUERIES[name](spark, SF)
    said = con.execute(plans.SQL[name])
    columns, cols = [d[0] for d in said.description], sorted(got.columns)
    assert cols == sorted(columns)
    show = lambda rows, order: sorted(tuple(f"{r[order.index(c)]:.6g}" if isinstance(r[order.index(c)], float) else str(r[order.index(c)]) for c in cols) for r in rows)
    assert show(got.collect(), got.columns) == show(said.fetchall(), columns)


def test_formats_are_translated():
    assert strings.translated("d-MMMM-yy") == "%d-%B-%y" and strings.translated("MMM d, yyyy") == "%b %d, %Y" and strings.translated("M/d/yyyy") == "%m/%d/%Y"
