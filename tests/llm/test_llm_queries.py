"""The registered queries of the training-data operators on the smallest tables; those with SQL against DuckDB."""

import os

import pytest

from sparkwright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
ROWS = {"op2_html_text": "pages"}


OTHER = {"op11_spelling", "op12_search"}  # rows of words and of items


@pytest.mark.parametrize("name", sorted(set(QUERIES) - OTHER))
def test_one_row_for_each_input_row(spark, name):
    if name == "op3_packing":
        pytest.importorskip("public_tokenizers")
    df = QUERIES[name](spark, SF)
    key = "page_id" if name == "op2_html_text" else "doc_id"
    table = spark.read.parquet(f"{SF}/{ROWS.get(name, 'documents')}.parquet")
    got = [r[0] for r in df.select(key).collect()]
    want = sorted(r[0] for r in table.select(key).collect())
    assert sorted(set(got)) == want and (name == "op3_packing" or len(got) == len(want))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    result = c.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(map(plain, df.select(names).collect())) == sorted(map(plain, result.fetchall()))
