"""Values of the operators that no SQL states, against plain statements on small inputs."""

import heapq
import itertools
import math
import random
from collections import defaultdict
from datetime import datetime
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import SF

from pathloom.functions import routing, text
from pathloom.functions.session import ship
from pathloom.operators import evaluation, graph, queue, sequences
from pathloom.plans import network, operations


def test_best_pairs_have_the_largest_total(spark):
    rng = random.Random(3)
    rows = [(region, a, b, rng.random()) for region in range(4) for a in range(4) for b in range(5) if rng.random() < 0.5]
    found = evaluation.best_pairs(spark.createDataFrame(rows, "region long, a long, b long, score double"), "region").collect()
    assert len({(r["region"], r["a"]) for r in found}) == len({(r["region"], r["b"]) for r in found}) == len(found)
    for region in range(4):
        score = {(a, b): s for k, a, b, s in rows if k == region}
        most = max(sum(score.get((a, b), 0.0) for a, b in enumerate(p)) for p in itertools.permutations(range(5), 4))
        assert sum(r["score"] for r in found if r["region"] == region) == pytest.approx(most)


def test_equal_rows_are_matched_as_one_with_a_count(spark):
    rng = random.Random(5)
    classes = [(a, b, round(rng.random(), 3), rng.randint(1, 3), rng.randint(1, 3)) for a in range(4) for b in range(4)]
    n_a, n_b = {a: n for a, _, _, n, _ in classes}, {b: n for _, b, _, _, n in classes}
    flows = evaluation.best_flows(spark.createDataFrame([(0, a, b, s, n_a[a], n_b[b]) for a, b, s, _, _ in classes], "region long, a long, b long, score double, n_a long, n_b long"), "region").collect()
    taken = {(k, f[k], f[f"from_{k}"] + i) for f in flows for i in range(f["units"]) for k in "ab"}
    assert len(taken) == 2 * sum(f["units"] for f in flows)
    assert all(at < (n_a if k == "a" else n_b)[c] for k, c, at in taken)
    single = [(0, a * 10 + i, b * 10 + j, s) for a, b, s, _, _ in classes for i in range(n_a[a]) for j in range(n_b[b])]
    rows, columns = sorted({r[1] for r in single}), sorted({r[2] for r in single})
    cost = np.zeros((len(rows), max(len(rows), len(columns))))
    for _, a, b, s in single:
        cost[rows.index(a), columns.index(b)] = -s
    most = -sum(cost[i, j] for i, j in enumerate(evaluation.assign(cost)))
    assert sum(f["units"] * f["score"] for f in flows) == pytest.approx(most)


def test_assignment_of_copies_has_no_pair_for_each_two_copies(spark, tmp_path):
    at = datetime(2020, 1, 1)
    rows = [(i, 7, at) for i in (0, 1, 40, 41, 80, 81, 120)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    found = operations.evl08_optimal_assignment(spark, str(tmp_path)).collect()
    assert len(found) == 3 and len({r["a"] for r in found}) == len({r["b"] for r in found}) == 3


def test_greedy_matching(spark):
    ship(spark)
    rng = random.Random(4)
    box = lambda: (x := rng.uniform(0, 6), y := rng.uniform(0, 6), x + rng.uniform(2, 5), y + rng.uniform(2, 5))
    truths = [(f, rng.choice("ab"), *box()) for f in range(6) for _ in range(5)]
    found = [(f, rng.choice("ab"), *box(), rng.random(), k) for f in range(7) for k in range(6)]

    def iou(p, q):
        w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
        both = max(w, 0) * max(h, 0)
        return both / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - both)

    stated = {}
    for f in range(7):
        free, tp = [t for t in truths if t[0] == f], 0
        for d in sorted((d for d in found if d[0] == f), key=lambda d: -d[6]):
            near = max((t for t in free if t[1] == d[1]), key=lambda t: iou(d[2:6], t[2:6]), default=None)
            if near and iou(d[2:6], near[2:6]) >= 0.3:
                free.remove(near)
                tp += 1
        stated[f] = (tp, 6 - tp, len(free))
    result = evaluation.greedy_match(
        spark.createDataFrame(found, "frame long, label string, x1 double, y1 double, x2 double, y2 double, confidence double, id long"),
        spark.createDataFrame(truths, "frame long, label string, x1 double, y1 double, x2 double, y2 double"), 0.3)
    assert {r["frame"]: (r["tp"], r["fp"], r["fn"]) for r in result.collect()} == stated


def test_bootstrap_interval_holds_the_mean_and_narrows(spark):
    rng = random.Random(5)
    rows = [(k % 200, rng.gauss(10, 2)) for k in range(2000)]
    frame = spark.createDataFrame(rows, "cluster long, value double")
    wide, narrow = (evaluation.bootstrap_interval(frame.filter(c), "value", "cluster").first() for c in ("cluster < 20", "true"))
    mean = sum(v for _, v in rows) / len(rows)
    assert narrow["low"] < mean < narrow["high"]
    assert narrow["high"] - narrow["low"] < wide["high"] - wide["low"] < 2
    assert evaluation.bootstrap_interval(frame, "value", "cluster").first() == narrow


def test_tours_visit_all_stops_or_drop_the_lightest(spark):
    ship(spark)
    rng = random.Random(6)
    at = {k: (rng.random(), rng.random()) for k in range(5)}
    far = lambda a, b: ((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5
    rows = [(1, a, b, far(a, b), 0, b) for a in at for b in at]
    frame = spark.createDataFrame(rows, "tour long, a long, b long, dist double, first long, weight long")
    tour = [r["stop"] for r in evaluation.tours(frame).orderBy("seq").collect()]
    length = lambda o: sum(far(a, b) for a, b in zip(o, o[1:]))
    assert tour[0] == 0 and sorted(tour) == list(at)
    # No reversal of a stretch shortens it.
    assert all(length([*tour[:i], *tour[i : j + 1][::-1], *tour[j + 1 :]]) >= length(tour) - 1e-9 for i in range(1, 5) for j in range(i + 1, 5))
    short = evaluation.tours(frame, budget=length(tour) * 0.9).orderBy("seq").collect()
    stops = [r["stop"] for r in short]
    assert stops[0] == 0 and sorted(stops) == [0, *range(6 - len(stops), 5)] and short[0]["total"] <= length(tour) * 0.9


def test_edges_are_split_and_chains_followed(spark):
    edges = spark.createDataFrame([(1, 10.0), (2, 5.0)], "edge long, length double")
    cuts = spark.createDataFrame([(1, 4.0), (1, 4.05), (1, 0.05), (1, 9.95), (1, 7.0), (1, 7.0)], "edge long, measure double")
    found = sorted(tuple(r) for r in graph.split_edges(edges, cuts).collect())
    assert found == [(1, 0, 0.0, 4.0), (1, 1, 4.0, 7.0), (1, 2, 7.0, 10.0), (2, 0, 0.0, 5.0)]


def walked(edges, start, max_edges=40, max_length=600.0, max_turn=100.0):
    """The chain of one start edge, step by step."""
    neighbours = {}
    for u, v, *_ in edges:
        neighbours.setdefault(u, set()).add(v)
        neighbours.setdefault(v, set()).add(u)
    at = {}
    for u, v, _, _, _, x1, y1, x2, y2 in edges:
        at[u], at[v] = (x1, y1), (x2, y2)
    bearing = lambda a, b: math.degrees(math.atan2(at[b][0] - at[a][0], at[b][1] - at[a][1])) % 360

    def side(p, c, road, steps, room):
        out = []
        while steps and len(neighbours[c]) == 2:
            ways = []
            for u, v, k, length, name, *_ in edges:
                if u == c and v != p:
                    turn = abs((bearing(c, v) - bearing(p, c) + 540) % 360 - 180)
                    ways.append((round(turn, 9), v, k, length, name))
            if not ways:
                break
            turn, v, k, length, name = min(ways)
            if turn > max_turn or (road and name and name != road) or length > room or length <= 0:
                break
            out.append((c, v, k))
            p, c, road, steps, room = c, v, name or road, steps - 1, room - length
        return out

    u, v, k = start
    (length, road), = [(e[3], e[4]) for e in edges if e[:3] == start]
    half = (max_edges - 1) // 2
    ahead, behind = side(u, v, road, half, (max_length - length) / 2), side(v, u, road, max_edges - 1 - half, (max_length - length) / 2)
    return [(b, a, key) for a, b, key in reversed(behind)] + [start] + ahead


def test_chains_follow_the_road_both_ways(spark):
    rng = random.Random(11)
    at, links = {}, []
    for way in range(6):
        x, y = 1000.0 * way, 0.0
        for k in range(60):
            node = 100 * way + k
            at[node] = (x, y)
            angle = 0.0 if way == 4 else rng.choice([0.0, 0.3, -0.4, 1.2, 2.0 if way % 2 else 0.5])
            x, y = x + 30 * math.cos(angle), y + 30 * math.sin(angle)
            if k:
                links.append((node - 1, node, rng.choice([5.0, 12.0, 40.0] if way < 3 else [1.0, 2.0]), "a" if way == 4 else rng.choice(["a", None] if k % 19 else ["b", "a"])))
    # A junction, a ring, an edge of no length, an edge one way only.
    links += [(30, 130, 7.0, "a"), (459, 400, 9.0, None), (501, 502, 0.0, "a")]
    edges = [(u, v, 0, length, road, *at[u], *at[v]) for u, v, length, road in links]
    edges += [(v, u, 0, length, road, *at[v], *at[u]) for u, v, length, road in links if (u, v) != (210, 211)]
    edges += [(5, 6, 1, 3.0, "a", *at[5], *at[6]), (6, 5, 1, 3.0, "a", *at[6], *at[5])]
    edges = sorted(set(edges), key=str)
    unique = {e[:3]: e for e in edges}
    edges = list(unique.values())
    frame = spark.createDataFrame(edges, "u long, v long, k int, length double, road string, x1 double, y1 double, x2 double, y2 double")
    starts = [e[:3] for n, e in enumerate(edges) if n % 5 == 0]
    found = {}
    for r in graph.expand_chains(frame, spark.createDataFrame([(n, *s) for n, s in enumerate(starts)], "chain long, u long, v long, k int")).collect():
        found.setdefault(r["chain"], []).append((r["seq"], (r["u"], r["v"], r["k"])))
    want = {n: walked(edges, s) for n, s in enumerate(starts)}
    assert {n: [e for _, e in sorted(rows)] for n, rows in found.items()} == want
    assert {len(w) for w in want.values()} >= {1, 40} and all(sorted(r[0] for r in rows) == list(range(len(rows))) for rows in found.values())


def test_numerals_and_similarity(spark):
    ship(spark)
    said = {"十四舍": "14舍", "二十三教": "23教", "七食堂": "7食堂", "十号楼": "10号楼", "一教": "1教"}
    assert {k: text.numerals_to_digits(k) for k in said} == said
    pairs = [("14舍", "4舍"), ("Hall", " hall "), ("north hall", "hall"), ("hall", "north hall"), ("abcd", "abxd"), ("", "x"), (None, "x")]
    found = text.similarity(spark.createDataFrame(pairs, "a string, b string"), "a", "b").select("a", "b", "score").collect()
    stated = {("14舍", "4舍"): SequenceMatcher(None, "14舍", "4舍").ratio(), ("Hall", " hall "): 1.0, ("north hall", "hall"): 0.9, ("hall", "north hall"): 0.85, ("abcd", "abxd"): 0.75, ("", "x"): 0.0, (None, "x"): 0.0}
    assert {(r["a"], r["b"]): r["score"] for r in found} == pytest.approx(stated)


def cheapest(edges, source):
    """Cost and path of the cheapest ways from a node, equal costs to the smaller path."""
    best, heap = {}, [(0.0, [source])]
    while heap:
        cost, path = heapq.heappop(heap)
        if path[-1] not in best:
            best[path[-1]] = (cost, path)
            for v, w in edges[path[-1]].items():
                if v not in best:
                    heapq.heappush(heap, (cost + w, [*path, v]))
    return best


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_recommended_routes_and_instructions(spark):
    e = network.edges(spark, str(SF)).collect()
    longest = max(r["length"] for r in e)
    metres = {(r["u"], r["v"]): float(r["length"]) for r in e}
    home = [r["source"] for r in network.sources(spark, str(SF), network.HOMES).collect()]
    routes = defaultdict(dict)
    for k, f in enumerate((1.0, 0.75, 0.5, 0.25, 0.0)):
        cost = routing.edge_cost(F.col("length") / F.lit(float(longest)), F.col("slope"), F.col("scenery"), {"distance": 1 - f * 0.5, "slope": 0.1 * f, "scenery": 0.4 * f}, F.lit(1.0))
        ways = defaultdict(dict)
        for r in network.edges(spark, str(SF)).select("u", "v", cost.alias("cost")).collect():
            ways[r["u"]][r["v"]] = r["cost"]
        for s in home:
            for node, (_, path) in cheapest(ways, s).items():
                if node != s:
                    routes[s, node][k] = sum(metres[p] for p in zip(path, path[1:]))
    stated = {key: next((k, m[k], m[4]) for k in sorted(m) if m[k] <= 1.25 * m[4] + 0.1) for key, m in routes.items()}
    found = {(r["source"], r["node"]): (r["vector"], r["metres"], r["shortest"]) for r in network.grf05_recommend(spark, str(SF)).collect()}
    assert found.keys() == stated.keys() and all(found[k] == pytest.approx(stated[k]) for k in stated)
    legs = defaultdict(list)
    for r in network.grf22_turn_by_turn(spark, str(SF)).orderBy("source", "node", "run").collect():
        legs[r["node"]].append(r)
    plain = defaultdict(dict)
    for (u, v), m in metres.items():
        plain[u][v] = m
    for node, (total, path) in cheapest(plain, 1).items():
        if node != 1:
            assert sum(r["metres"] for r in legs[node]) == pytest.approx(total, abs=0.1)
            assert [r["action"] == "depart" for r in legs[node]] == [True] + [False] * (len(legs[node]) - 1)
            assert [r["arrives"] for r in legs[node]] == [False] * (len(legs[node]) - 1) + [True]
            assert all(a["road"] != b["road"] for a, b in zip(legs[node], legs[node][1:])) and len(legs[node]) < len(path)


def test_changes_to_stored_rows(spark):
    stored = spark.createDataFrame([(1, 3, "a"), (2, 1, "b"), (3, 1, "c"), (4, 2, "d")], "id long, version int, value string")
    changes = spark.createDataFrame([(1, "update", 3, "A"), (2, "update", 9, "B"), (3, "delete", 1, None), (5, "create", None, "E"), (4, "create", None, "D"), (6, "delete", 1, None)], "id long, op string, expected int, value string")
    after, outcome = queue.apply_changes(stored, changes)
    assert sorted(map(tuple, after.collect())) == [(1, 4, "A"), (2, 1, "b"), (4, 2, "d"), (5, 1, "E")]
    assert dict(map(tuple, outcome.collect())) == {1: "applied", 2: "conflict", 3: "applied", 4: "exists", 5: "applied", 6: "missing"}
    union = sequences.stable_union([stored.filter("id < 3"), stored], ["id"], "value").collect()
    assert {r["id"]: r["branch"] for r in union} == {1: 0, 2: 0, 3: 1, 4: 1}
    rows = queue.insert_returning(stored, ["id"], 7).collect()
    assert len({r[0] for r in rows}) == 4 and all(r["created"] == 7 for r in rows)
