"""Every query with a SQL counterpart gives the same rows as DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.catalog.all_queries(), entry.oracle.all_sql()


def text(value):
    return "null" if value is None else repr(value) if isinstance(value, float) else str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=list(names).__getitem__)
    return sorted(tuple(text(row[i]) for i in order) for row in values)


@pytest.fixture(scope="module")
def base(sf_dir):
    connection = duckdb.connect()
    for table in ("orders", "customer", "lineitem", "events"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "weight_per_box" in df.columns


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, base, name):
    df = QUERIES[name](spark, sf_dir)
    result = base.execute(SQL[name])
    names = [column[0] for column in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_model_query(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
