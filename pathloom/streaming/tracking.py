"""Tracking of detected objects over the frames of many videos, as a stream.

A video's state is its live tracks: a filter of constant velocity for each of centre, aspect and
height, and for how many frames the track was missed. A frame's detections are associated in two
stages by overlap, confident ones first. Boxes are taken back to the camera's first view since its
last jump; a frame whose transform failed, or that does not follow the last one, starts afresh, so
no track leads across it.

A frame is one row. Frames that come after a later one of their video is done get no tracks; so do
boxes without area or confidence, and labels that are not tracked get one of their own each time.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pathloom.operators.evaluation import assign

# Labels that are tracked, thresholds of confidence, largest costs of the two stages (1 - overlap), frames that a track may be missed.
TRACKED = (
    "car", "bus", "truck", "motorcycle", "motorbike", "motor", "van",
    "vehicle", "tricycle", "awning-tricycle", "bicycle",
    "pedestrian", "person", "people",
)
HIGH, LOW, FIRST_COST, SECOND_COST, MAX_MISSED = 0.369, 0.1, 0.8, 0.5, 1
# Deviations of position and velocity, as shares of the height.
POSITION_SHARE, VELOCITY_SHARE = 1 / 20, 1 / 160
IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]

FRAMES = "video long, frame long, transform array<double>, detections array<struct<detection:long,label:string,confidence:double,x1:double,y1:double,x2:double,y2:double>>"
TRACKS = "video long, frame long, detection long, label string, track long"
TRACK = "struct<track:long,label:string,missed:int,mean:array<double>,spread:array<double>>"
HELD = f"videos array<struct<video:long,frame:long,next:long,forward:array<double>,tracks:array<{TRACK}>>>"
#: Bits of video numbers that one group leaves open; rows of tracks handed on at once.
NEAR, OUT_ROWS = 4, 10_000


def overlap(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def measured(box) -> list[float]:
    """Centre, aspect and height of a box."""
    w, h = box[2] - box[0], box[3] - box[1]
    return [box[0] + w / 2, box[1] + h / 2, w / h, h]


def deviations(height: float) -> tuple[list[float], list[float]]:
    """Of position and velocity, for centre, aspect and height."""
    p, v = POSITION_SHARE * height, VELOCITY_SHARE * height
    return [p, p, 1e-2, p], [v, v, 1e-5, v]


class Track:
    """Four filters of position and velocity: mean is (position, velocity) of each, spread (variance, covariance, variance of velocity)."""

    def __init__(self, track: int, label: str, missed: int, mean: list[float], spread: list[float]):
        self.track, self.label, self.missed, self.mean, self.spread = track, label, missed, mean, spread

    @classmethod
    def start(cls, track: int, label: str, box) -> Track:
        z = measured(box)
        p, v = deviations(z[3])
        mean = [x for k in range(4) for x in (z[k], 0.0)]
        return cls(track, label, 0, mean, [x for k in range(4) for x in ((2 * p[k] if k != 2 else p[k]) ** 2, 0.0, (10 * v[k] if k != 2 else v[k]) ** 2)])

    def predict(self) -> None:
        p, v = deviations(self.mean[6])
        mean, spread = [], []
        for k, (at, speed) in enumerate(zip(self.mean[::2], self.mean[1::2])):
            a, b, c = self.spread[3 * k : 3 * k + 3]
            mean += (at + speed, speed)
            spread += (a + 2 * b + c + p[k] ** 2, b + c, c + v[k] ** 2)
        self.mean, self.spread = mean, spread

    def update(self, box) -> None:
        z, (p, _) = measured(box), deviations(self.mean[6])
        mean, spread = [], []
        for k, (at, speed) in enumerate(zip(self.mean[::2], self.mean[1::2])):
            a, b, c = self.spread[3 * k : 3 * k + 3]
            total = a + (p[k] if k != 2 else 1e-1) ** 2
            off = z[k] - at
            mean += (at + a / total * off, speed + b / total * off)
            spread += (a - a * a / total, b - a * b / total, c - b * b / total)
        self.mean, self.spread, self.missed = mean, spread, 0

    def box(self) -> list[float]:
        x, y, aspect, h = self.mean[::2]
        return [x - aspect * h / 2, y - h / 2, x + aspect * h / 2, y + h / 2]


def pairs(tracks: list[Track], boxes: list, most: float) -> list[tuple[int, int]]:
    """One-to-one pairs of tracks and boxes of least total cost, none above most."""
    if not tracks or not boxes:
        return []
    costs = [[1 - overlap(at, b) for b in boxes] for at in [t.box() for t in tracks]]
    near = [(t, b) for t, row in enumerate(costs) for b, c in enumerate(row) if c <= most]
    # Where no track or box has a choice, the pairs within the limit are the assignment.
    if len({t for t, _ in near}) == len(near) == len({b for _, b in near}):
        return near
    cost = np.array(costs)
    gated = np.where(cost <= most, cost, 1e3)
    flip = len(tracks) > len(boxes)
    chosen = assign(gated.T if flip else gated)
    found = [(c, r) if flip else (r, c) for r, c in enumerate(chosen) if c >= 0]
    return sorted((t, b) for t, b in found if cost[t, b] <= most)


class Tracker:
    """One video: step() takes its frames in order."""

    def __init__(self, frame: int | None = None, following: int = 0, forward: Iterable[float] = IDENTITY, tracks: Iterable[Track] = ()):
        self.frame, self.following, self.forward, self.tracks = frame, following, np.array(list(forward)).reshape(3, 3), list(tracks)
        self._turned()

    def _turned(self) -> None:
        """Keep what boxes need of the camera: nothing where it stands as it did."""
        still = self.forward.ravel().tolist() == IDENTITY
        self.back = None if still else np.linalg.inv(self.forward)

    def _new(self) -> int:
        self.following += 1
        return self.following - 1

    def _settle_camera(self, frame: int, transform) -> None:
        known = transform is not None and len(transform) == 9 and all(x is not None and math.isfinite(x) for x in transform)
        if self.frame is not None and known and frame == self.frame + 1:
            if list(transform) == IDENTITY:
                return
            forward = np.array([float(x) for x in transform]).reshape(3, 3) @ self.forward
            if abs(np.linalg.det(forward)) > 1e-12:
                self.forward = forward
                self._turned()
                return
        self.tracks, self.forward, self.back = [], np.array(IDENTITY).reshape(3, 3), None

    def _steady(self, box) -> list[float] | None:
        """A box as the camera's first view since its last jump has it; None where it has no area."""
        if any(x is None or not math.isfinite(x) for x in box):
            return None
        if self.back is None:
            return [float(x) for x in box]
        corners = self.back @ np.array([[box[0], box[2], box[2], box[0]], [box[1], box[1], box[3], box[3]], [1.0] * 4])
        if (np.abs(corners[2]) < 1e-9).any():
            return None
        x, y = corners[:2] / corners[2]
        out = [float(v) for v in (x.min(), y.min(), x.max(), y.max())]
        return out if all(map(math.isfinite, out)) and out[2] > out[0] and out[3] > out[1] else None

    def step(self, frame: int, transform, detections) -> list[tuple[int, str, int | None]]:
        """detection, label and track of each detection."""
        detections = [] if detections is None else detections
        named = [(d["detection"], (d["label"] or "").strip().lower(), d["confidence"]) for d in detections]
        if self.frame is not None and frame <= self.frame:
            return [(i, label, None) for i, label, _ in named]
        self._settle_camera(frame, transform)
        self.frame = frame
        given, usable = {}, {}
        for k, ((i, label, confidence), d) in enumerate(zip(named, detections)):
            if confidence is None or not 0 <= confidence <= 1:
                continue
            if label not in TRACKED:
                if confidence >= HIGH:
                    given[k] = self._new()
                continue
            # A box whose corners are given the wrong way round has no area.
            box = self._steady([d["x1"], d["y1"], d["x2"], d["y2"]]) if None not in (d["x1"], d["y1"], d["x2"], d["y2"]) and d["x1"] < d["x2"] and d["y1"] < d["y2"] else None
            if box:
                usable.setdefault(label, []).append((k, box, confidence))
        for label in sorted({t.label for t in self.tracks} | set(usable)):
            self._associate(label, usable.get(label, []), given)
        return [(i, label, given.get(k)) for k, (i, label, _) in enumerate(named)]

    def _associate(self, label: str, found: list, given: dict) -> None:
        own = [t for t in self.tracks if t.label == label]
        for t in own:
            t.predict()
        left, fresh = own, []
        for most, stage in ((FIRST_COST, [x for x in found if x[2] >= HIGH]), (SECOND_COST, [x for x in found if LOW <= x[2] < HIGH])):
            # Only tracks that were seen last time may go on with a faint box.
            open_ = left if most == FIRST_COST else [t for t in left if t.missed == 0]
            taken = pairs(open_, [box for _, box, _ in stage], most)
            for t, b in taken:
                open_[t].update(stage[b][1])
                given[stage[b][0]] = open_[t].track
            done = {id(open_[t]) for t, _ in taken}
            left = [t for t in left if id(t) not in done]
            if most == FIRST_COST:
                fresh = [x for k, x in enumerate(stage) if k not in {b for _, b in taken}]
        for t in left:
            t.missed += 1
        self.tracks = [t for t in self.tracks if t.missed <= MAX_MISSED]
        for k, box, _ in fresh:
            given[k] = self._new()
            self.tracks.append(Track.start(given[k], label, box))


def frames_of_group(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """TRACKS of a batch's frames of the videos of one group, some thousands at once."""
    held = {}
    for video, frame, following, forward, tracks in state.get[0] if state.exists else ():
        held[video] = Tracker(frame, following, forward, [Track(t, label, missed, list(mean), list(spread)) for t, label, missed, mean, spread in tracks])
    batch = pd.concat(list(rows), ignore_index=True)
    # Nulls, if any, are a group of their own.
    nameless, videos = batch["video"].isna().any(), batch["video"].fillna(0).to_numpy("int64")
    batch = batch.take(np.lexsort((batch["frame"], videos)))
    out = []
    for video, frame, transform, detections in zip(np.sort(videos).tolist(), batch["frame"].tolist(), batch["transform"], batch["detections"]):
        tracker = held.get(video) or held.setdefault(video, Tracker())
        out += [(None if nameless else video, frame, *found) for found in tracker.step(frame, transform, detections)]
        if len(out) >= OUT_ROWS:
            yield _table(out)
            out = []
    state.update(([(video, t.frame, t.following, t.forward.ravel().tolist(), [(x.track, x.label, x.missed, [float(n) for n in x.mean], [float(n) for n in x.spread]) for x in t.tracks]) for video, t in held.items()],))
    yield _table(out)


def _table(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["video", "frame", "detection", "label", "track"]).astype({"track": "Int64"})


def track(frames: DataFrame) -> DataFrame:
    """TRACKS of a stream of FRAMES.

    Videos whose numbers are near share a group and its state, at most 2**NEAR of them, however many there are in
    all: a call of Python and a state of its own for each cost more than its frames.
    """
    near = frames.withColumn("videos", F.shiftright("video", NEAR))
    return near.groupBy("videos").applyInPandasWithState(frames_of_group, TRACKS, HELD, "append", GroupStateTimeout.NoTimeout)
