"""Every registered query of the engine against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from inkspan.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def shown(value):
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([shown(x) for x in value])
    try:
        return f"{float(value):.6g}"
    except (TypeError, ValueError):
        return str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    ours = catalog.QUERIES[name](spark, SF)
    theirs = tables.sql(catalog.ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.columns, [tuple(r) for r in ours.collect()]) == rows(theirs.columns, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLES.keys()))
def test_queries_without_sql_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_the_driver_contract(spark):
    import __spark_entry__

    assert __spark_entry__.queries().keys() >= catalog.QUERIES.keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.entry(spark).count() > 0
