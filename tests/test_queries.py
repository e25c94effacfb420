"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import pytest

from sparkwright.catalogue import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(columns).collect()]
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in at) for r in result.fetchall()]
    assert ordered(got) == ordered(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["cloze", "replaced_token", "token_deletion"])
def test_whole_documents(spark, tmp_path, name):
    spark.createDataFrame([(1, "word " * 3000), (2, ""), (3, None), (4, "one two")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert [got[i]["n"] for i in (1, 2, 4)] == [3000, 0, 2]
    changed = {"cloze": "hidden", "replaced_token": "replaced", "token_deletion": "kept"}[name]
    assert 300 < (got[1][changed] if name != "token_deletion" else 3000 - got[1]["kept"]) < 600


def test_stream_daily_many_files(spark, tmp_path):
    """Twenty files in no order of time, read eight a micro-batch: every day counts whole."""
    for k in range(20):
        day = k * 7 % 20 + 1
        spark.sql(f"select id as event_id, timestamp'2024-01-{day:02d} 05:00:00' as ts, 'view' as event_type, 1.0d as value from range({day})").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["stream_daily"](spark, str(tmp_path)).collect()
    assert sorted((r["day"].day, r["n"]) for r in got) == [(d, d) for d in range(1, 21)]
