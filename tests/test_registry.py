"""All registered queries against their SQL counterparts on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.run_queries import TABLES, table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in entry.oracle_sql()])
def test_query_equals_sql(spark, name):
    frame = entry.queries()[name](spark, FOLDER)
    got = table(frame.columns, [tuple(r) for r in frame.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    assert got == table([c[0] for c in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
