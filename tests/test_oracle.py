"""Each query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from claimcheck import queries as Q

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)[:19]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, duck, name):
    got = Q.queries()[name](spark, D)
    columns = sorted(got.columns)
    cursor = duck.execute(Q.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted([plain(r[k]) for k in at] for r in cursor.fetchall())
    assert sorted([plain(r[c]) for c in columns] for r in got.collect()) == want


def test_every_query_runs(spark):
    for name in set(Q.queries()) - set(Q.oracle_sql()):
        assert Q.queries()[name](spark, D).columns
