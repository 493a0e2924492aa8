"""Every registered query with SQL gives DuckDB's rows on the smallest tables; every other one runs."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def plain(rows):
    return sorted(repr([round(v, 6) + 0.0 if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    rows = entry.queries()[name](spark, SMALL)
    columns = sorted(rows.columns)
    got = rows.select(*columns).collect()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({sql})").fetchall()
        assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
