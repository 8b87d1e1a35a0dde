"""Every core query with an SQL twin gives the same rows on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from gleanery.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert {r.field for r in entry.entry(spark).collect()} == {"event_type", "value", "k"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
