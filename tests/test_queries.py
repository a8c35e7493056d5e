"""Every registered query against its SQL, on the smallest tables."""

import datetime
import os
from pathlib import Path

import duckdb
import pytest

from gristmill.plans import registry

DATA = Path(os.environ.get("TEST_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value.isoformat() if isinstance(value, datetime.datetime) else value


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, views, name):
    rows = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(rows.columns)
    found = views.execute(registry.ORACLE_SQL[name])
    at = [[c[0] for c in found.description].index(c) for c in columns]
    want = sorted(repr(plain(tuple(r[i] for i in at))) for r in found.fetchall())
    assert sorted(repr(plain(tuple(r))) for r in rows.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, str(DATA)).count() > 0
