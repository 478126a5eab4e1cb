"""The queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from loamwork.plans.oracle import ORACLE_SQL
from loamwork.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr([show(r[i]) for i in order]) for r in rows), sorted(columns)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.execute(ORACLE_SQL[name])
    want = plain([d[0] for d in rel.description], rel.fetchall())
    assert plain(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry(spark, con):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
