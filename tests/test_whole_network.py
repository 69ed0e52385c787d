"""The road network of the queries holds every hop of lineitem, in Spark as in SQL."""

import duckdb
import pytest
from test_queries import SF, duck  # noqa: F401

from pathloom.plans.base import HOPS, hops

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def test_every_hop_is_there(spark, duck):  # noqa: F811
    whole = duckdb.sql(f"SELECT count(*) FROM (SELECT l_suppkey AS u, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS v FROM '{SF}/lineitem.parquet') WHERE u <> v").fetchall()[0][0]
    assert hops(spark, str(SF)).count() == whole
    assert duck.execute(f"WITH {HOPS} SELECT count(*) FROM hops").fetchall()[0][0] == whole
