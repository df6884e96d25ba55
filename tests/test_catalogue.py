"""Every query against its DuckDB equivalent on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from lodewell.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "conversations", "events", "pages", "labels"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if v is None else float(v) if isinstance(v, float) else v
    return sorted(([plain(r[i]) for i in order] for r in values), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    own = got.collect()
    if name not in catalogue.ORACLE_SQL:
        assert own
        return
    cur = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, own) == rows(names, cur.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES) <= set(__spark_entry__.queries())
