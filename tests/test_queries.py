"""Every registered query of the library against its SQL, as the driver compares them."""

import math

import duckdb
import pytest

from trackloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v if v is None or isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    res = duck.sql(catalogue.oracles()[name])
    assert sorted(res.columns) == cols
    at = [res.columns.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in at) for r in res.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_rows_only_queries_run(spark):
    for name in catalogue.queries().keys() - catalogue.oracles().keys():
        assert catalogue.queries()[name](spark, DATA).columns
