"""Every query that has SQL, against DuckDB over the same tables."""

import os

import duckdb
import pytest

from quillgraph import bridge, bridge_documents

DATA = "/root/testdata/sf0.001"
assert bridge_documents  # adds its queries to the bridge's


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(bridge.QUERIES))
def test_query(spark, con, name):
    df = bridge.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    if name not in bridge.ORACLE_SQL:
        assert rows
        return
    expected = con.sql(bridge.ORACLE_SQL[name])
    assert sorted(expected.columns) == cols
    assert rows == sorted(map(repr, expected.project(", ".join(f'"{c}"' for c in cols)).fetchall()))


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
