"""Queries of the corpus operators against their SQL in DuckDB, row by row."""

import os

import duckdb
import pytest

from tidemark.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    df = queries.QUERIES[name](spark, DATA)
    cursor = db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    wanted = rows(columns, cursor.fetchall())
    assert sorted(columns) == sorted(df.columns) and wanted
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == wanted
