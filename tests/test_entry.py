"""The driver contract: entry smoke run and every query against its oracle
at sf0.001."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from starwright.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["rental_month", "film_category", "revenue"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(ORACLE_SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables absent")
def test_queries_match_oracle(spark):
    from check_oracle import TABLES, digest
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    bad = []
    for name, fn in sorted(QUERIES.items()):
        df = fn(spark, SF)
        s_rows = [tuple(r) for r in df.collect()]
        cur = con.execute(ORACLE_SQL[name])
        d_cols = [c[0] for c in cur.description]
        d_rows = cur.fetchall()
        if sorted(df.columns) != sorted(d_cols) or digest(df.columns, s_rows) != digest(d_cols, d_rows):
            bad.append(name)
    assert bad == []
