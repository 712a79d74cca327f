"""Every registered query against its SQL at the smallest scale, on the whole tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA
from tools.check_queries import ordered

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["check", "corpus", "path", "line_no", "rule", "severity", "matched", "message"]


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, oracle, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = oracle.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert ordered(df.columns, got) == ordered(cols, cur.fetchall())
