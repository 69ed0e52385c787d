"""Videos whose numbers are near share a group of the tracking stream; frames without a choice need no assignment."""

import numpy as np

from pathloom.streaming import runs, tracking
from pathloom.streaming.tracking import FRAMES, Tracker

NAMES = ("detection", "label", "confidence", "x1", "y1", "x2", "y2")


def frame(video, n):
    return (video, n, list(tracking.IDENTITY), [(0, "car", 0.9, video + 3.0 * n, 0.0, video + 3.0 * n + 20, 10.0), (1, "bus", 0.9, 500.0, 0.0, 520.0, 10.0 + video % 3)])


def test_videos_of_a_group_keep_their_own_tracks_over_batches(spark, tmp_path):
    videos, want = [*range(-2, 20), 2**40], []
    for v in videos:
        tracker = Tracker()
        want += [(v, n, *x) for n in range(6) for x in tracker.step(n, frame(v, n)[2], [dict(zip(NAMES, d)) for d in frame(v, n)[3]])]
    for k in range(2):
        spark.createDataFrame([frame(v, n) for v in videos for n in range(3 * k, 3 * k + 3)], FRAMES).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
        stream = spark.readStream.schema(FRAMES).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        found = runs.run_available(tracking.track(stream), f"{tmp_path}/out", f"{tmp_path}/check", 120)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert {r["track"] for r in found.collect()} == {0, 1}
    assert "TransformWithState" not in tracking.track(stream)._jdf.queryExecution().logical().toString()


def test_frames_without_a_choice_need_no_assignment_and_a_still_camera_no_inverse(monkeypatch):
    monkeypatch.setattr(tracking, "assign", lambda cost: 1 / 0)
    monkeypatch.setattr(np.linalg, "inv", lambda matrix: 1 / 0)
    tracker = Tracker()
    for n in range(4):
        assert [t for *_, t in tracker.step(n, frame(1, n)[2], [dict(zip(NAMES, d)) for d in frame(1, n)[3]])] == [1, 0]
