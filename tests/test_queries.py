"""Every catalogued query with SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import pytest

from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "null" if math.isnan(x) else f"{x:.6f}"
    return "null" if x is None else f"{float(x):.6f}" if isinstance(x, (int,)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(plain(r[found.columns.index(c)]) for c in order) for r in found.fetchall())
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(1).count() == 1
