"""Stateful streams over the supplied tables, run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.session import ship
from pathloom.operators.graph import discard, settle, shared_dir
from pathloom.plans.base import EDGES, NODES, edges, nodes, query, read
from pathloom.sources import files
from pathloom.streaming import matching, runs, tracking


def run(spark, stream: DataFrame) -> DataFrame:
    work = f"{shared_dir(ship(spark))}/stream-{uuid.uuid4().hex}"
    return runs.run_available(stream, f"{work}/rows", f"{work}/checkpoint")


def user_routes(spark, d) -> DataFrame:
    """user, route, stops: the suppliers of the latest order of a user with events, in order of its lines, as points in planar metres."""
    seen = read(spark, d, "events").select(F.col("user_id").alias("user")).distinct()
    latest = read(spark, d, "orders").withColumnRenamed("o_custkey", "user").join(seen, "user", "left_semi").groupBy("user").agg(F.max("o_orderkey").alias("route"))
    at = nodes(spark, d).select(F.col("node").alias("l_suppkey"), ((F.col("lng") - 114.346) * 95000).alias("x"), ((F.col("lat") - 30.517) * 110000).alias("y"))
    line = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("route"), "l_linenumber", "l_partkey", "l_suppkey").join(at, "l_suppkey")
    stops = line.join(latest, "route").groupBy("user", "route").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "x", "y"))).alias("stops"))
    return stops.filter("size(stops) > 1")


def pieces(routes: DataFrame) -> DataFrame:
    """route, piece, x1, y1, x2, y2, before."""
    pair = F.expr("transform(sequence(1, size(stops) - 1), k -> struct(k - 1 as piece, stops[k - 1].x as x1, stops[k - 1].y as y1, stops[k].x as x2, stops[k].y as y2))")
    rows = routes.select("route", F.explode(pair).alias("p")).select("route", "p.*")
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    before = F.sum(length).over(Window.partitionBy("route").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", F.coalesce(before, F.lit(0.0)))


def fixes(spark, d, routes: DataFrame) -> DataFrame:
    """A stream of the events of users with a route: each at a place of its route, up to 180 m beside it."""
    schema = read(spark, d, "events").schema
    # As a pattern, since a table may be one file and a stream reads folders.
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    rows = events.select(F.col("user_id").alias("user"), F.col("event_id").alias("id"), (F.unix_micros(F.to_timestamp("ts")) / 1e6).alias("seconds")).join(routes, "user")
    k = F.expr("cast(id % (size(stops) - 1) as int)")
    a, b, t = F.get("stops", k), F.get("stops", k + 1), F.col("id") % 10 / 10
    return rows.select("user", "id", "seconds", "route", (a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t + 30.0 * (F.col("id") % 7)).alias("y"))


@query(f"""WITH {NODES}, latest AS (SELECT o_custkey AS "user", max(o_orderkey) AS route FROM orders GROUP BY 1),
s AS (SELECT "user", route, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY route) AS n, (lng - 114.346::DOUBLE) * 95000 AS x, (lat - 30.517::DOUBLE) * 110000 AS y FROM lineitem JOIN latest ON route = l_orderkey JOIN nodes ON node = l_suppkey WINDOW w AS (PARTITION BY route ORDER BY l_linenumber, l_partkey, l_suppkey)),
p AS (SELECT a."user", a.route, a.k AS piece, a.n, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS len FROM s a JOIN s b ON a.route = b.route AND b.k = a.k + 1),
q AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY route ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
f AS (SELECT e.user_id AS "user", event_id AS id, epoch_us(ts) AS micros, route, x1 + (x2 - x1) * ((event_id % 10)::DOUBLE / 10) AS x, y1 + (y2 - y1) * ((event_id % 10)::DOUBLE / 10) + 30.0::DOUBLE * (event_id % 7) AS y FROM events e JOIN q ON q."user" = e.user_id AND piece = event_id % (n - 1)),
c AS (SELECT f.*, piece, before, len, x1, y1, x2, y2, greatest(0, least(1, coalesce(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0))) AS t FROM f JOIN q USING (route)),
m AS (SELECT *, sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2)) AS across FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(across, 6), piece) AS rn FROM m WHERE across <= 200)
SELECT "user", id, round(before + t * len, 3) AS progress, round(across, 3) AS across, round(max(before + t * len) OVER (PARTITION BY "user" ORDER BY micros, id), 3) AS furthest FROM b WHERE rn = 1""")
def str01_map_matching(spark, d):
    """Fixes on the routes that their users follow, and how far each has come."""
    routes = settle(user_routes(spark, d))
    matched = run(spark, matching.match(fixes(spark, d, routes), settle(matching.route_cells(pieces(routes)))))
    return matched.filter("across is not null").select("user", "id", F.round("progress", 3).alias("progress"), F.round("across", 3).alias("across"), F.round("furthest", 3).alias("furthest"))


def film_frames(spark, d) -> DataFrame:
    """FRAMES from events: each user's events are the frames of a film with a car, one more object and a camera that fails at times."""
    frame = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    rows = read(spark, d, "events").select(F.col("user_id").alias("video"), frame.alias("frame"), F.col("event_id").alias("e"), "event_type")
    lit = lambda *values: F.array(*[F.lit(float(v)) for v in values])
    box = lambda k, label, confidence, x, y, size: F.struct(F.lit(k).cast("long").alias("detection"), label.alias("label"), confidence.alias("confidence"), x.alias("x1"), y.alias("y1"), (x + size).alias("x2"), (y + size).alias("y2"))
    e, n = F.col("e"), F.col("frame")
    car = box(0, F.lit("Car"), F.when(e % 5 > 0, 0.9).otherwise(0.2), n * 3.0 + e % 4, F.lit(10.0), 20.0)
    other = box(1, F.when(F.col("event_type") == "click", "person").when(F.col("event_type") == "view", "bus").otherwise("tree"), (e % 100) / 100, 300.0 - n * 2.0, 40.0 + e % 6, 30.0)
    crossing = box(2, F.lit("car"), F.lit(0.8), 200.0 - n * 3.0, F.lit(12.0) + e % 3, 20.0)
    transform = F.when(e % 23 == 0, None).otherwise(lit(1, 0, 0, 0, 1, 0, 0, 0, 1))
    return rows.select("video", "frame", transform.alias("transform"), F.array(car, other, crossing).alias("detections"))


@query()
def str09_tracks(spark, d):
    """Tracks of the objects in each user's film."""
    frames = film_frames(spark, d)
    path = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"
    frames.write.parquet(path)
    return run(spark, tracking.track(spark.readStream.schema(tracking.FRAMES).parquet(path)))


@query(f"""WITH {EDGES}, {NODES}, degrees AS (SELECT u, count(*) AS outgoing FROM edges GROUP BY u)
SELECT e.u, e.v, e.length::DOUBLE AS length, e.scenery, e.highway, e.road, n.nation, d.outgoing FROM edges e JOIN nodes n ON n.node = e.u JOIN degrees d ON d.u = e.u""")
def snk02_graphml(spark, d):
    """The whole network written as one typed document and read back: each edge with attributes of its start."""
    path = f"{shared_dir(spark)}/network-{uuid.uuid4().hex}.graphml"
    network = settle(edges(spark, d))
    outgoing = network.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("outgoing"))
    files.write_graphml(nodes(spark, d).join(outgoing, "node", "left"), network, path, compression="gzip")
    discard(network)
    at, links = files.read_graphml(spark, path)
    of = lambda name, kind: F.try_element_at("attributes", F.lit(name)).cast(kind).alias(name)
    starts = at.select(F.col("node").alias("u"), of("nation", "int"), of("outgoing", "long"))
    return links.select("u", "v", of("length", "double"), of("scenery", "int"), of("highway", "string"), of("road", "string")).join(starts, "u")
