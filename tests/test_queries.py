"""Every query that SQL can state gives the rows that its SQL gives, on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from pathloom.plans import registry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0 if v == v else "nan"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return sorted((k, plain(x)) for k, x in v.items())
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(row[k]) for k in order]) for row in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, duck, name):
    found = QUERIES[name](spark, str(SF))
    stated = duck.execute(SQL[name])
    columns = [c[0] for c in stated.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, found.collect()) == rows(columns, stated.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    frame = QUERIES[name](spark, str(SF))
    assert len(set(frame.columns)) == len(frame.columns) and frame.count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
