"""Every query with SQL of its own gives the rows that DuckDB gives."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from gramloom.plans.queries import ORACLE_SQL, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([v.item() if hasattr(v, "item") else v for v in r]) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        assert rows(got) == rows(duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["fuzzy_self_join_words", "pair_scores", "shared_gram_similarity", "bow_distance"])
def test_sums_do_not_depend_on_their_order(duck, name):
    """The SQL gives the same rows with one thread and with several, again and again."""
    found = set()
    for threads in (1, 8, 8, 3):
        duck.sql(f"SET threads = {threads}")
        found.add(str(rows(duck.sql(ORACLE_SQL[name]).df())))
    assert len(found) == 1


def test_the_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
