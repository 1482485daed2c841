"""Queries with SQL of their own give the rows that DuckDB gives, and all give a row for each of their tables'."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from gramloom.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name, tmp_path):
    con = duckdb.connect(config={"temp_directory": str(tmp_path)})
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(map(repr, want.fetchall()))
    assert rows and sorted(repr(tuple(r)) for r in got.select(*want.columns).collect()) == rows
