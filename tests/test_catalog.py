"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([r[i] for i in order] for r in values), key=lambda r: [(x is None, x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if not n.startswith("select_")] + ["select_div", "select_mod", "select_cast_float_to_int", "select_struct"])
def test_query_matches_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(catalog.ORACLE_SQL[name])
    wanted = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in cursor.description)
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted, strict=True):
        assert a == pytest.approx(b) if all(x is not None for x in a) else a == b


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "st", "et", "a"] and df.count() > 0


def test_every_query_of_the_engine_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry_lists_the_engine():
    assert set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n.startswith("select_") and n not in ("select_div", "select_mod", "select_cast_float_to_int", "select_struct")])
def test_scalar_query_matches_sql(spark, db, name):
    test_query_matches_sql(spark, db, name)
