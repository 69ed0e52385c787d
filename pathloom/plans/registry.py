"""Queries over the supplied tables, each with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.plans import base, fusion, joins, network, operations, rows, sequences, streams  # noqa: F401  modules register their queries


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: places within a walking budget of a node."""
    return network.entry(spark, sf_dir)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
