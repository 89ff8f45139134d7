"""Every query that has SQL gives DuckDB's rows at the smallest scale; the others give rows."""

import os

import pytest

from scriptloom.plans.queries import QUERIES, SQL

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or x != x:
        return "null"
    return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    expected = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    rows = [sorted(map(tuple, df[sorted(df.columns)].map(plain).values.tolist())) for df in (got, expected)]
    assert rows[0] == rows[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "line_no", "rule", "text"]
    assert set(e.oracle_sql()) <= set(e.queries())
