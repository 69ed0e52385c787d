"""Graph operators against plain statements, on small graphs."""

import os
import random

import pytest

from pathloom.operators import graph
from pathloom.plans import network


def relaxed(edges, source):
    """Least costs from one node, by relaxing every edge until nothing changes."""
    best, changed = {source: 0.0}, True
    while changed:
        changed = False
        for u, v, w in edges:
            if u in best and best[u] + w < best.get(v, float("inf")):
                best[v], changed = best[u] + w, True
    return best


def long_road(n=24):
    """A chain of n nodes, each of whose direct ways past it are dearer, and a part that is not joined."""
    rng = random.Random(5)
    return [(k, k + 1, 1.0) for k in range(n)] + [(k, k + rng.randint(2, 6), 50.0) for k in range(0, n - 6, 3)] + [(90, 91, 1.0)]


def test_cheapest_paths_may_have_any_number_of_edges(spark):
    edges = long_road()
    starts = spark.createDataFrame([(0, 0), (5, 5)], "source long, node long")
    found = graph.shortest_paths(spark.createDataFrame(edges, "u long, v long, length double"), starts, with_path=True).collect()
    assert {(r["source"], r["node"], r["dist"]) for r in found} == {(s, node, d) for s in (0, 5) for node, d in relaxed(edges, s).items()}
    assert max(len(r["path"]) for r in found) == 25


def test_wide_states_and_merged_parts_give_the_same_and_only_the_result_stays(spark, monkeypatch):
    """More rounds than two merges take, with the state shuffled and with only what candidates meet of it."""
    folder = graph.shared_dir(spark).removeprefix("file://")
    kept = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    monkeypatch.setattr(graph._Improvements, "FAN", 3)
    edges = [(k, k + 1, 1.0) for k in range(11)] + [(k, k + 5, 30.0 - k % 5) for k in range(0, 6, 2)] + [(9, 3, 2.0)]
    table = spark.createDataFrame(edges, "u long, v long, length double")
    starts = spark.createDataFrame([(0, 0), (7, 7)], "source long, node long")
    for rows in (0, 10**6):
        monkeypatch.setattr(graph, "WIDE_ROWS", rows)
        before = kept()
        found = graph.shortest_paths(table, starts).collect()
        assert {(r["source"], r["node"], r["dist"]) for r in found} == {(s, node, d) for s in (0, 7) for node, d in relaxed(edges, s).items()}
        assert len(found) == len({(r["source"], r["node"]) for r in found})
        assert len(kept() - before) == 1


def test_a_search_that_does_not_settle_is_an_error(spark):
    starts = spark.createDataFrame([(0, 0)], "source long, node long")
    edges = spark.createDataFrame(long_road(), "u long, v long, length double")
    with pytest.raises(RuntimeError, match="did not settle"):
        graph.shortest_paths(edges, starts, rounds=8)
    loop = spark.createDataFrame([(0, 1, 1.0), (1, 0, -2.0)], "u long, v long, length double")
    with pytest.raises(RuntimeError, match="did not settle"):
        graph.shortest_paths(loop, starts)


def test_single_source_query_follows_long_roads(spark, tmp_path):
    """Each order is one hop of the chain."""
    lines = [(k, n, 1, k + n - 1, q) for k in range(12) for n, q in ((1, 1.0), (2, 1.0))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 0) for k in range(14)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    assert sorted(map(tuple, network.grf01_single_source(spark, str(tmp_path)).collect())) == [(k, 10.0 * k) for k in range(13)]


def test_components_of_long_chains_settle_in_few_rounds(spark):
    rng = random.Random(2)
    names = rng.sample(range(10_000), 1_300)
    chain, other, alone = names[:1000], names[1000:1299], names[1299]
    hops = [*zip(chain, chain[1:]), *zip(other[1:], other), (other[0], other[0])]
    rng.shuffle(hops)
    found = graph.components(spark.createDataFrame(hops, "u long, v long"), spark.createDataFrame([(n,) for n in names], "node long"), rounds=20)
    want = {n: min(part) for part in (chain, other, [alone]) for n in part}
    assert {r["node"]: r["component"] for r in found.collect()} == want
