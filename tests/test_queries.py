"""Every library query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest
from lumbra import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(names, got):
    order = sorted(range(len(names)), key=lambda k: names[k])
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(tidy(r[k]) for k in order) for r in got), key=repr)


#: Queries that SQL can't express, and the tests that compare them with plain loops.
PLAIN = {"reduced_logs": "test_chunking.py: test_reduced_logs"}


def test_every_query_is_compared():
    assert sorted(plans.queries()) == sorted([*plans.oracle_sql(), *PLAIN])


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    want = duck.sql(plans.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
