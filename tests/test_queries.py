"""Every registered query beside its SQL in DuckDB, on the smallest tables."""

import datetime as dt
import decimal
from pathlib import Path

import duckdb
import pytest

from tessera.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    held = duckdb.connect()
    held.execute("set timezone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        held.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return held


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    rows = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(rows.columns) == sorted(columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in rows.collect())
    assert got == sorted(repr([plain(v) for v in r]) for r in want.fetchall())
