"""Trust and distrust reach hosts over chains of any length."""

import pytest
from test_url_filter import SCHEMA, brute, pages

from pathloom.llm.url_filter import judge


def verdicts(spark, rows):
    result = judge(spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA).repartition(3))
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in result.collect()}


def chain(n=30):
    """Each host links to the next, the last one to a blocked one; seeds' masses differ."""
    rows = [(k, f"http://h{k}.biz/", f'<a href="http://h{k + 1}.biz/">') for k in range(n - 1)]
    return rows + [(n - 1, f"http://h{n - 1}.biz/", '<a href="http://bad.com/de/">'), (n, "http://bad.com/de/1", None)]


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    rows = chain()
    assert {p for p, v in verdicts(spark, rows).items() if v[3] == "allow"} == set()


@pytest.mark.parametrize("seed", [2, 5])
def test_settled_ranks_against_brute_force(spark, seed):
    rows = [(p + 100, u, h) for p, u, h in pages(seed=seed)] + chain(20)
    assert verdicts(spark, rows) == brute(rows, iterations=400)
