"""Ways of two edges that an edge closes: all of them, made where their edges meet."""

import random

from pathloom.operators import graph


def test_all_ways_are_closed_without_a_shuffle_of_ways(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", (3, 4))
    draw = random.Random(3)
    length = {(draw.randrange(-5, 12), draw.randrange(-5, 12)): float(draw.randrange(1, 9)) for _ in range(150)}
    edges = spark.createDataFrame([(u, v, w) for (u, v), w in length.items() if u != v], "u long, v long, length double")
    length = {(u, v): w for (u, v), w in length.items() if u != v}
    want = sorted((u, m, v, a, b, length[u, v]) for (u, m), a in length.items() for (n, v), b in length.items() if m == n and (u, v) in length)
    ways = graph.closed_ways(edges)
    assert sorted(map(tuple, ways.collect())) == want
    plan = graph.closed_ways(edges)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3
