"""Position fixes matched to the routes that users follow, as a stream.

The routes are a static table: each cell of a route has the pieces that may be nearest to a point in
it. A fix meets the one row of its cell, so its nearest piece is an expression over that row and no
candidates are shuffled. What a user has reached is kept in state and never runs back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pathloom.functions import geo
from pathloom.operators import spatial

#: Metres from its route within which a fix is matched.
REACH = 200.0
# Seconds between fixes that speed is taken from, greatest speed, metres that a fix may fall back, weight of the speed so far.
SLOWEST, LONGEST, FASTEST, BACK, WEIGHT = 0.5, 6.0, 30.0, 5.0, 0.6

MATCHED = "user long, id long, seconds double, piece int, progress double, across double, furthest double, speed double"
REACHED = "users array<struct<user:long,furthest:double,progress:double,seconds:double,speed:double>>"
#: Bits of user ids that one group leaves open.
NEAR = 6


def route_cells(pieces: DataFrame, reach: float = REACH) -> DataFrame:
    """route, cell, pieces: for each cell the pieces of the route that come within reach of it.

    pieces: route, piece, x1, y1, x2, y2, before (metres of the route before the piece).
    """
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    points = spatial.densify(pieces.select(F.struct("route", "piece", "x1", "y1", "x2", "y2", "before").alias("line"), "x1", "y1", "x2", "y2", length.alias("length")), reach)
    near = F.explode(F.array(*[F.struct((F.floor(F.col("x") / (2 * reach)) + i).alias("cx"), (F.floor(F.col("y") / (2 * reach)) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    touched = points.select("line", near.alias("cell")).distinct()
    return touched.groupBy(F.col("line.route").alias("route"), "cell").agg(F.array_sort(F.collect_list(F.struct("line.piece", "line.x1", "line.y1", "line.x2", "line.y2", "line.before"))).alias("pieces"))


def project(fixes: DataFrame, cells: DataFrame, reach: float = REACH) -> DataFrame:
    """user, id, seconds, piece, progress, across: each fix on the nearest piece of its route, null beyond reach; ties to the first.

    fixes: user, id, seconds, route, x, y.
    """

    def onto(p):
        t, distance = geo.segment_projection(F.col("x"), F.col("y"), p["x1"], p["y1"], p["x2"], p["y2"])
        length = F.sqrt(F.pow(p["x2"] - p["x1"], 2) + F.pow(p["y2"] - p["y1"], 2))
        return F.struct(F.round(distance, 6).alias("about"), p["piece"].alias("piece"), distance.alias("across"), (p["before"] + t * length).alias("progress"))

    cell = F.struct(F.floor(F.col("x") / (2 * reach)).alias("cx"), F.floor(F.col("y") / (2 * reach)).alias("cy"))
    met = fixes.withColumn("cell", cell).join(cells, ["route", "cell"], "left")
    best = met.withColumn("best", F.array_min(F.transform("pieces", onto)))
    hit = F.col("best.across") <= reach
    return best.select("user", "id", "seconds", *[F.when(hit, F.col(f"best.{c}")).alias(c) for c in ("piece", "progress", "across")])


def advance(seconds: list, progress: list, reached: tuple) -> tuple[list, list, tuple]:
    """Furthest progress and speed at each of one user's fixes, and what is reached after them."""
    furthest, last, at, speed = reached
    ahead, speeds = [], []
    for now, new in zip(seconds, progress):
        if new == new and new is not None:
            if last is not None and new > last - BACK and SLOWEST < now - at < LONGEST:
                v = (new - last) / (now - at)
                speed = speed * WEIGHT + v * (1 - WEIGHT) if 0 <= v < FASTEST else speed
            furthest = new if furthest is None else max(furthest, new)
            last, at = new, now
        ahead.append(furthest)
        speeds.append(speed)
    return ahead, speeds, (furthest, last, at, speed)


def advance_group(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """MATCHED of a batch's fixes of the users of one group: furthest progress, and speed along the route."""
    reached = {user: tuple(r) for user, *r in state.get[0]} if state.exists else {}
    batch = pd.concat(list(rows), ignore_index=True)
    users = batch["user"].fillna(0).to_numpy("int64")
    order = np.lexsort((batch["id"], batch["seconds"], users))
    batch, users = batch.take(order), users[order]
    seconds, progress = batch["seconds"].tolist(), batch["progress"].tolist()
    starts = np.flatnonzero(np.r_[True, users[1:] != users[:-1]]).tolist()
    ahead, speeds = [], []
    for low, high in zip(starts, [*starts[1:], len(users)]):
        user = int(users[low])
        more, faster, after = advance(seconds[low:high], progress[low:high], reached.get(user, (None, None, None, 0.0)))
        ahead += more
        speeds += faster
        if after[0] is not None:
            reached[user] = after
    if reached:
        state.update(([(user, *r) for user, r in reached.items()],))
    yield batch[["user", "id", "seconds", "piece", "progress", "across"]].assign(furthest=np.array(ahead, "float64"), speed=speeds)


def match(fixes: DataFrame, cells: DataFrame, reach: float = REACH) -> DataFrame:
    """MATCHED of a stream of fixes. Fixes of a batch are taken in order of time; a batch's fixes follow those of the batches before.

    Users whose ids are near share a group and its state, since a call of Python costs more than a user's fixes: at
    most 2**NEAR users, however many there are in all.
    """
    return project(fixes, cells, reach).withColumn("users", F.shiftright("user", NEAR)).groupBy("users").applyInPandasWithState(advance_group, MATCHED, REACHED, "append", GroupStateTimeout.NoTimeout)
