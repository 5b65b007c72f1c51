"""Registered queries against their SQL."""

import duckdb
import pytest

from partigrid.plans import catalog

DATA = "/root/testdata/sf0.001"
#: Counts that take a minute; the driver runs them.
SLOW = ("6x6", "7x7", "8x8", "queen_5x5_k5_d3")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in catalog.oracle_sql() if not any(x in n for x in SLOW)))
def test_query_equals_its_sql(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    want = db.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = [tuple(str(r[c]) for c in want.columns) for r in df.collect()]
    assert sorted(got) == sorted(tuple(map(str, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in set(catalog.queries()) - set(catalog.oracle_sql()) if not any(x in n for x in SLOW)))
def test_other_queries_give_rows(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0
