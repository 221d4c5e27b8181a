"""The driver's entry module and the registered queries against their SQL."""

import os

import pytest

import __spark_entry__ as entry
from hierql import queries as core

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "tzinfo") else value.isoformat()
    if hasattr(value, "as_tuple"):
        return f"{float(value):.9g}" if value != int(value) else str(int(value))
    return str(value)


@pytest.fixture(scope="module")
def connection():
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for file in os.listdir(DATA):
        c.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return c


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_listed():
    assert set(core.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_rows_match_sql(spark, connection, name):
    got = core.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    relation = connection.sql(core.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[i]) for i in order) for r in relation.fetchall()) == rows


#: Queries whose feature is a limit or an offset.
CUT = {"p9_null_events", "a15_variant_events", "a22_order_population", "a29_order_only_aggregate", "a11_positional_merge"}


def test_only_queries_about_limits_have_one():
    for name, q in core.QUERIES.items():
        assert name.startswith("o") or name in CUT or not ("limit" in q.text or "offset" in q.text), name
