"""What path searches do beside the search: when edges are left out first, and how paths are laid."""

import itertools
import random

from pathloom.operators import graph


def test_few_sources_search_all_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "without_detoured", lambda slim: 1 / 0)
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0)], "u long, v long, length double")
    one = spark.createDataFrame([(1, 1)], "source long, node long")
    assert sorted(map(tuple, graph.shortest_paths(edges, one).collect())) == [(1, 1, 0.0), (1, 2, 1.0), (1, 3, 2.0)]


def test_edges_past_the_ways_are_tried_over_near_nodes(spark):
    light = [(n, n + 1, 1.0) for n in range(6)]
    slim = spark.createDataFrame([*light, (0, 6, 100.0), (0, 5, 5.0)], "u long, v long, w double")
    assert sorted((r["u"], r["v"]) for r in graph.without_detoured(slim).collect()) == sorted([*[(u, v) for u, v, _ in light], (0, 5)])


def test_paths_are_the_smallest_of_the_cheapest(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW_SOURCES", 2)
    draw, size = random.Random(7), 7
    edges = [(u, v, float(draw.choice([0, 1, 1, 2, 3]))) for u, v in itertools.permutations(range(size), 2) if draw.random() < 0.5]
    cost = {(u, v): w for u, v, w in edges}
    want = {}
    for source in range(3):
        for length in range(1, size + 1):
            for rest in itertools.permutations([n for n in range(size) if n != source], length - 1):
                path = [source, *rest]
                if all(p in cost for p in zip(path, path[1:])):
                    value = (sum(cost[p] for p in zip(path, path[1:])), path)
                    want[source, path[-1]] = min(want.get((source, path[-1]), value), value)
    starts = spark.createDataFrame([(n, n) for n in range(3)], "source long, node long")
    found = graph.shortest_paths(spark.createDataFrame(edges, "u long, v long, length double"), starts, with_path=True).collect()
    assert {(r["source"], r["node"]): (r["dist"], r["path"]) for r in found} == want
