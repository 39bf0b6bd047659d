"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else x


def names():
    from keyloom import registry

    return sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", names())
def test_query_equals_its_sql(spark, duck, name):
    from keyloom import registry

    df = registry.queries()[name](spark, DATA)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    at = [columns.index(c) for c in sorted(columns)]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=str)
    assert sorted(df.columns) == sorted(columns)
    assert got == want
