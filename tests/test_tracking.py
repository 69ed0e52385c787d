"""Tracking and matching streams against plain folds, whole and resumed."""

import math
import random

import pytest

from pathloom.plans import streams
from pathloom.streaming import matching, runs, tracking
from pathloom.streaming.tracking import FRAMES, Tracker


def detection(k, label, confidence, x, y, size=10.0):
    return (k, label, confidence, x, y, x + size, y + size)


def films(n=30):
    """Objects on straight ways; some frames have no transform, some are missing, some boxes are faint."""
    rng = random.Random(7)
    rows = []
    for video in range(3):
        ways = [(rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(-3, 3), rng.uniform(-3, 3), rng.choice(["car", "person", "tree"])) for _ in range(6)]
        for frame in range(n):
            if rng.random() < 0.05:
                continue
            drift = [1.0, 0.0, 2.0, 0.0, 1.0, -1.0, 0.0, 0.0, 1.0]
            found = [detection(k, label, rng.choice([0.9, 0.9, 0.2, 0.05]), x + frame * (dx + 2), y + frame * (dy - 1)) for k, (x, y, dx, dy, label) in enumerate(ways)]
            rows.append((video, frame, None if rng.random() < 0.1 else drift, found))
    return rows


def folded(rows):
    out, names = [], ("detection", "label", "confidence", "x1", "y1", "x2", "y2")
    for video in sorted({r[0] for r in rows}):
        tracker = Tracker()
        for _, frame, transform, found in sorted((r for r in rows if r[0] == video), key=lambda r: r[1]):
            out += [(video, frame, *x) for x in tracker.step(frame, transform, [dict(zip(names, d)) for d in found])]
    return sorted(out, key=str)


def test_one_object_keeps_its_track_and_a_jump_ends_it():
    tracker, names = Tracker(), ("detection", "label", "confidence", "x1", "y1", "x2", "y2")
    still = list(tracking.IDENTITY)
    step = lambda frame, transform, *found: [t for *_, t in tracker.step(frame, transform, [dict(zip(names, d)) for d in found])]
    assert step(0, None, detection(0, "Car", 0.9, 0, 0), detection(1, "car", 0.2, 50, 50)) == [0, None]
    assert step(1, still, detection(0, "car", 0.9, 2, 0)) == [0]
    assert step(2, still, detection(0, "car", 0.2, 4, 0), detection(1, "car", 0.8, 100, 0)) == [0, 1]
    assert step(3, still) == []
    assert step(4, still, detection(0, "car", 0.9, 8, 0), detection(1, "tree", 0.9, 8, 0), detection(2, "person", 0.9, 8, 0)) == [0, 2, 3]
    assert step(4, still, detection(0, "car", 0.9, 8, 0)) == [None]
    assert step(5, None, detection(0, "car", 0.9, 10, 0)) == [4]
    assert step(6, [1.0, 0.0, 70.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], detection(0, "car", 0.9, 82, 0)) == [4]
    assert step(8, still, detection(0, "car", 0.9, 82, 0), detection(1, "car", math.nan, 0, 0), detection(2, "car", 0.9, 5, 5, -1)) == [5, None, None]


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_stream_gives_the_tracks_of_a_fold_also_when_resumed(spark, tmp_path):
    rows, source = films(), str(tmp_path / "in")
    want = folded(rows)
    # One run for each part: state, source and sink go on from the checkpoint each time.
    for k, (low, high) in enumerate(((0, 9), (10, 10), (11, 29))):
        write(spark, [r for r in rows if low <= r[1] <= high], FRAMES, f"{source}/b{k}")
        stream = spark.readStream.schema(FRAMES).option("recursiveFileLookup", True).parquet(source)
        found = runs.run_available(tracking.track(stream), str(tmp_path / "out"), str(tmp_path / "check"), 120)
        assert sorted(map(tuple, found.collect()), key=str) == [w for w in want if w[1] <= high]
    again = runs.run_available(tracking.track(stream), str(tmp_path / "out"), str(tmp_path / "check"), 120)
    assert again.count() == len(want)


FIXES = "user long, id long, seconds double, route long, x double, y double"
PIECES = [(1, 0, 0.0, 0.0, 1000.0, 0.0, 0.0), (1, 1, 1000.0, 0.0, 1000.0, 500.0, 1000.0), (2, 0, 0.0, 0.0, 0.0, 90.0, 0.0)]


def nearest(route, x, y):
    best = None
    for r, piece, x1, y1, x2, y2, before in PIECES:
        if r == route:
            length = math.hypot(x2 - x1, y2 - y1)
            t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / length**2))
            d = math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))
            best = min(best or (d, piece, before + t * length), (d, piece, before + t * length))
    return best if best and best[0] <= matching.REACH else (None, None, None)


def test_progress_never_runs_back_over_a_resumed_stream(spark, tmp_path):
    rng, fixes = random.Random(3), []
    for user in range(4):
        for k in range(25):
            fixes.append((user, 100 * user + k, 2.0 * k, user % 3, rng.uniform(-100, 1100), rng.uniform(-250, 600)))
    fixes += [(9, 900 + k, 2.0 * k, 1, 10.0 * k, 3.0) for k in range(25)]
    cells = matching.route_cells(spark.createDataFrame(PIECES, "route long, piece int, x1 double, y1 double, x2 double, y2 double, before double"))
    for k in range(2):
        write(spark, [f for f in fixes if (f[2] >= 24) == (k == 1)], FIXES, str(tmp_path / f"in/b{k}"))
        stream = spark.readStream.schema(FIXES).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        found = runs.run_available(matching.match(stream, cells), str(tmp_path / "out"), str(tmp_path / "check"), 120)
    got = {r["id"]: r for r in found.collect()}
    assert len(got) == found.count() == len(fixes)
    for user in range(4):
        furthest = None
        for _, i, seconds, route, x, y in (f for f in fixes if f[0] == user):
            d, piece, progress = nearest(route, x, y)
            furthest = progress if furthest is None else furthest if progress is None else max(furthest, progress)
            assert got[i]["piece"] == piece and got[i]["furthest"] == pytest.approx(furthest)
            assert got[i]["across"] == pytest.approx(d) and got[i]["progress"] == pytest.approx(progress)
    for k in range(25):
        assert got[900 + k]["speed"] == pytest.approx(5 * (1 - 0.6**k)) and got[900 + k]["furthest"] == pytest.approx(10.0 * k)


def test_query_gives_the_tracks_of_a_fold(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["video"], r["frame"], r["transform"], [tuple(x) for x in r["detections"]]) for r in streams.film_frames(spark, d).collect()]
    found = sorted(map(tuple, streams.str09_tracks(spark, d).collect()), key=str)
    assert found == folded(rows) and len(found) == 3 * len(rows)
    assert any(r[4] is None for r in found) and len({r[:1] + r[4:] for r in found}) < len(found) / 2
