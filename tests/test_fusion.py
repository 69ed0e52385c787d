"""Fusion on a hand-made network: every disposition, splits, connectors and connectivity."""

from collections import Counter

from pathloom.operators import fusion

NODES = [(0, 0.0, 0.0), (1, 100.0, 0.0), (2, 100.0, 100.0), (3, 0.0, 100.0), (4, 50.0, 300.0), (5, 50.0, 300.3), (6, 400.0, 0.0), (7, 400.0, 200.0)]
EDGES = [(0, 1, False), (1, 0, False), (1, 2, False), (2, 1, False), (2, 3, False), (3, 0, False), (6, 7, True), (3, 4, False), (4, 5, False)]
PEDESTRIAN, BUILDING = "pedestrian", "construction"
#: source, ends, road class, trusted, preserved, walkable construction; match action and edge; disposition.
CASES = [
    (1, (0.5, 0.5, 100.0, 0.5), PEDESTRIAN, False, False, False, "matched", (0, 1), "replaced"),
    (2, (100.0, 1.0, 100.0, 60.0), PEDESTRIAN, False, False, False, "matched", (1, 2), "geometry gate failed"),
    (3, (100.0, 99.5, 0.0, 99.5), PEDESTRIAN, False, False, False, "matched", (2, 3), "competing features"),
    (4, (100.5, 100.0, 0.5, 100.0), PEDESTRIAN, False, False, False, "matched", (3, 2), "competing features"),
    (5, (50.0, 1.0, 50.0, 99.98), PEDESTRIAN, False, False, False, "new_candidate", None, "added"),
    (6, (0.5, 0.0, 20.0, 40.0), PEDESTRIAN, False, False, False, "new_candidate", None, "added"),
    (7, (20.0, 40.1, 100.0, 50.0), PEDESTRIAN, False, False, False, "new_candidate", None, "added"),
    (8, (0.0, 0.5, -80.0, -80.0), PEDESTRIAN, False, False, False, "new_candidate", None, "insufficient anchors"),
    (9, (100.5, 0.0, 180.0, -80.0), PEDESTRIAN, True, False, False, "ambiguous", None, "added"),
    (10, (50.0, 300.1, 52.0, 320.0), PEDESTRIAN, True, False, False, "new_candidate", None, "insufficient anchors"),
    (11, (400.0, 100.0, 300.0, 100.0), PEDESTRIAN, True, False, False, "new_candidate", None, "insufficient anchors"),
    (12, (0.0, 0.0, 1.0, 1.0), PEDESTRIAN, False, False, False, "ambiguous", None, "ambiguous"),
    (13, (0.0, 0.0, 1.0, 1.0), PEDESTRIAN, False, False, False, None, None, "unaccounted"),
    (14, (0.0, 0.0, 1.0, 1.0), PEDESTRIAN, True, True, False, "matched", (0, 1), "ambiguous"),
    (15, (0.0, 0.0, 1.0, 1.0), BUILDING, True, False, False, "new_candidate", None, "ambiguous"),
    (16, (0.2, 99.9, -60.0, 160.0), BUILDING, True, False, True, "ambiguous", None, "added"),
    (17, (5.0, 5.0, 9.0, 9.0), BUILDING, False, False, False, "new_candidate", None, "construction excluded"),
    (18, (7.0, 7.0, 7.0, 7.0), PEDESTRIAN, False, False, False, "new_candidate", None, "degenerate"),
    (19, (-0.9, 0.0, -50.0, 0.0), PEDESTRIAN, True, False, False, "matched", (3, 0), "added"),
]


def fuse(spark, cases):
    features = spark.createDataFrame([(c[0], *c[1], *c[2:6], "x") for c in cases], "source long, x1 double, y1 double, x2 double, y2 double, road_class string, trusted boolean, preserved boolean, walkable_construction boolean, part string")
    matches = spark.createDataFrame([(c[0], c[6], *(c[7] or (None, None))) for c in cases if c[6]], "source long, action string, u long, v long")
    return fusion.fuse(spark.createDataFrame(EDGES, "u long, v long, grade_separated boolean"), spark.createDataFrame(NODES, "node long, x double, y double"), features, matches)


def reached(edges, start):
    seen, left = {start}, [start]
    while left:
        at = left.pop()
        for u, v in edges:
            if u == at and v not in seen:
                seen.add(v)
                left.append(v)
    return seen


def test_every_input_has_one_disposition_and_ways_stay_open(spark):
    result = fuse(spark, CASES)
    found = {r["source"]: r["disposition"] for r in result.features.collect()}
    assert found == {c[0]: c[-1] for c in CASES} and result.features.count() == len(CASES)
    base = {(r["a"], r["b"]): r["disposition"] for r in result.base.collect()}
    assert result.base.count() == len(base) == len({frozenset(e[:2]) for e in EDGES})
    assert base == {(0, 1): "replaced and split", (1, 2): "split", (2, 3): "split", (0, 3): "unchanged", (6, 7): "unchanged", (3, 4): "unchanged", (4, 5): "unchanged"}
    edges = result.edges.collect()
    links = [(r["u"], r["v"]) for r in edges]
    for u in range(8):
        assert reached([e[:2] for e in EDGES], u) <= reached(links, u)
    # Both parts of the feature across the square lead through it on foot; a one-way road stays one way.
    walk = [(r["u"], r["v"]) for r in edges if r["walk_only"]]
    assert all((v, u) in walk for u, v in walk)
    assert Counter(r["origin"] for r in edges)["connector"] == 2
    split = [r for r in edges if r["origin"] == "split"]
    assert len(split) == 2 * 2 + 2 * 2 + 2
    assert abs(sum(r["length"] for r in split) - (2 * 99.5 + 2 * 100 + 100)) < 1e-6


def test_without_features_the_network_stays(spark):
    result = fuse(spark, [])
    assert result.features.count() == 0 and {r["disposition"] for r in result.base.collect()} == {"unchanged"}
    assert sorted((r["u"], r["v"]) for r in result.edges.collect()) == sorted(e[:2] for e in EDGES)
