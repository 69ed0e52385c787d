"""Streams of position fixes and log events.

Stateful operators keep a few numbers for each key and see a key's rows of a batch in order of
time. Rows that arrive behind the watermark are dropped, as Structured Streaming defines it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixes across a limit in a row before a new route is asked for, and the seconds between two such calls.
STRIKES, COOLDOWN_S = 2, 30.0
#: Share of the new heading that is adopted.
ALPHA = 0.5

OFF_ROUTE = "user long, seconds double, cross double, reroute boolean"
HEADING = "user long, seconds double, heading double"
ARRIVAL = "user long, seconds double, phase string"
STALE = "user long, last double, stale boolean"


def ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values("seconds", kind="stable")


def off_route(fixes: DataFrame, limit: float = 25.0, accuracy: float = 100.0) -> DataFrame:
    """Each fix (user, seconds, cross, accuracy), and whether it calls for a new route.

    It does when the second accurate fix in a row is farther than limit from the route, unless the
    last call was less than COOLDOWN_S before. Inaccurate fixes change nothing.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        strikes, last = state.get if state.exists else (0, -math.inf)
        rows = ordered(batches)
        out = []
        for seconds, cross, precise in zip(rows["seconds"], rows["cross"], rows["accuracy"] <= accuracy):
            if precise:
                strikes = strikes + 1 if cross > limit else 0
            call = bool(precise and strikes >= STRIKES and seconds - last >= COOLDOWN_S)
            if call:
                strikes, last = 0, seconds
            out.append(call)
        state.update((strikes, float(last)))
        yield pd.DataFrame({"user": key[0], "seconds": rows["seconds"], "cross": rows["cross"], "reroute": out})

    return fixes.groupBy("user").applyInPandasWithState(step, OFF_ROUTE, "strikes int, last double", "append", GroupStateTimeout.NoTimeout)


def smooth(heading: float | None, new: float, alpha: float = ALPHA) -> float:
    """A low-pass step along the shorter arc, in degrees from 0 to 360; the first value is adopted."""
    return new % 360 if heading is None else (heading + alpha * ((new - heading + 540) % 360 - 180)) % 360


def smooth_headings(fixes: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """user, seconds, heading: each user's headings, smoothed in order of time."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        heading = state.get[0] if state.exists else None
        rows, out = ordered(batches), []
        for new in rows["heading"]:
            heading = smooth(heading, new, alpha)
            out.append(heading)
        state.update((heading,))
        yield pd.DataFrame({"user": key[0], "seconds": rows["seconds"], "heading": out})

    return fixes.groupBy("user").applyInPandasWithState(step, HEADING, "heading double", "append", GroupStateTimeout.NoTimeout)


def arrivals(fixes: DataFrame, near: float = 60.0, arrived: float = 15.0) -> DataFrame:
    """user, seconds, phase ('near', 'arrived'): the first fix within each distance left, once each."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = state.get[0] if state.exists else 0
        rows, out = ordered(batches), []
        for seconds, left in zip(rows["seconds"], rows["left"]):
            for level, (phase, distance) in enumerate((("near", near), ("arrived", arrived)), 1):
                if done < level and left <= distance:
                    done = level
                    out.append((key[0], seconds, phase))
        state.update((done,))
        yield pd.DataFrame(out, columns=["user", "seconds", "phase"])

    return fixes.groupBy("user").applyInPandasWithState(step, ARRIVAL, "done int", "append", GroupStateTimeout.NoTimeout)


def staleness(fixes: DataFrame, after_ms: int = 10_000) -> DataFrame:
    """user, last, stale: false with each batch of fixes, true once when none has come for so long."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"user": [key[0]], "last": [last], "stale": [True]})
            return
        last = max([*(b["seconds"].max() for b in batches), state.get[0] if state.exists else -math.inf])
        state.update((float(last),))
        state.setTimeoutDuration(after_ms)
        yield pd.DataFrame({"user": [key[0]], "last": [last], "stale": [False]})

    return fixes.groupBy("user").applyInPandasWithState(step, STALE, "last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user, start, until, n: runs of events (user, ts) without a longer gap."""
    grouped = events.withWatermark("ts", late).groupBy("user", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user", F.col("w.start").alias("start"), F.col("w.end").alias("until"), "n")


def segments(events: DataFrame, length: str = "36 seconds", late: str = "1 hour") -> DataFrame:
    """start, kind, n, total: partial results of fixed segments (ts, kind, value)."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "kind")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")


def ingest_once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events (key, ts, ...) whose key has not come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])


def append_log(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A JSON-lines log: each row once, also after a restart from the checkpoint."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
