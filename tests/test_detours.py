"""Edges that no cheapest path takes are left out of searches, and a search for the nearest keeps one source a node."""

import random

from pyspark.sql import functions as F

from pathloom.operators import graph

EDGES = "u long, v long, length double"


def test_undercut_edges_are_left_out(spark):
    rows = [(1, 2, 10.0), (2, 3, 10.0), (3, 4, 10.0), (1, 3, 25.0), (1, 4, 31.0), (2, 4, 20.0)]
    slim = spark.createDataFrame(rows, EDGES).withColumnRenamed("length", "w")
    assert sorted((r["u"], r["v"]) for r in graph.without_detoured(slim).collect()) == [(1, 2), (2, 3), (2, 4), (3, 4)]
    below = slim.unionByName(spark.createDataFrame([(7, 8, -1.0)], EDGES).withColumnRenamed("length", "w"))
    assert graph.without_detoured(below).count() == 7


def test_nearest_source_is_the_least_of_all_searches(spark):
    rng = random.Random(6)
    edges = spark.createDataFrame([(rng.randrange(40), rng.randrange(40), float(rng.randint(1, 9))) for _ in range(300)], EDGES).filter("u <> v")
    sources = spark.createDataFrame([(k, k) for k in (3, 8, 21)], "source long, node long")
    each = graph.shortest_paths(edges, sources).groupBy("node").agg(F.min(F.struct("dist", "source")).alias("b")).select("node", "b.source", "b.dist")
    found = graph.nearest_source(edges, sources)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, each.collect()))
