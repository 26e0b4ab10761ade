"""Every registered query against its SQL on DuckDB."""

import glob
import os

import duckdb
import pytest

from facetmill.plans import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = table(df.columns, df.collect())
    assert got[1]
    if name in oracles.SQL:
        r = duck.sql(oracles.SQL[name])
        assert got == table(r.columns, r.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert [r["step"] for r in __spark_entry__.entry(spark).collect()] == list(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
