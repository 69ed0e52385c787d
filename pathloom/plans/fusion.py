"""Fusion of two derived networks: each node's first road, and the roads that customers' latest orders draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators import fusion
from pathloom.operators.graph import settle
from pathloom.plans.base import HOPS, NODES, hops, nodes, query, read


def road_nodes(spark, d) -> DataFrame:
    """node, x, y in planar metres."""
    return nodes(spark, d).select("node", ((F.col("lng") - 114.346) * 95000).alias("x"), ((F.col("lat") - 30.517) * 110000).alias("y"))


def first_roads(spark, d) -> DataFrame:
    """a, m: each node with the smallest node that a hop leads to."""
    return hops(spark, d).groupBy(F.col("u").alias("a")).agg(F.min("v").alias("m"))


def base_edges(spark, d) -> DataFrame:
    return first_roads(spark, d).select(F.col("a").alias("u"), F.col("m").alias("v"), ((F.col("a") + F.col("m")) % 9 == 0).alias("grade_separated"))


def survey(spark, d) -> DataFrame:
    """A feature for each customer: from the smallest to the largest supplier of the latest order, with an end by kind."""
    latest = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.max("o_orderkey").alias("l_orderkey"))
    ends = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"))
    at = lambda k: road_nodes(spark, d).select(F.col("node").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    rows = latest.join(ends, "l_orderkey").join(first_roads(spark, d), "a").join(at("a"), "a").join(at("b"), "b").join(at("m"), "m")
    s, kind = F.col("source"), F.col("source") % 8
    ax, ay, bx, by, mx, my = (F.col(c) for c in ("ax", "ay", "bx", "by", "mx", "my"))
    away = F.when(s % 16 < 8, 0.04).otherwise(1.0)
    x1 = F.when(kind == 5, ax + 40.15).when(kind == 6, ax + 0.5).otherwise(ax + 0.3 * (s % 4))
    y1 = F.when(kind == 5, ay + 33.3).otherwise(ay)
    x2 = F.when(kind == 2, ax + 500.0 + s).when(kind == 3, (ax + mx) / 2).when(kind == 4, ax + 40.1).when(kind == 6, mx + 0.5).when(kind == 7, mx + 50.0).otherwise(bx)
    y2 = F.when(kind == 2, ay + 300.25).when(kind == 3, (ay + my) / 2 + away).when(kind == 4, ay + 33.3).when(kind.isin(6, 7), my).when(kind == 5, by + 0.5).otherwise(by + 1.2)
    building, trusted = s % 5 == 0, s % 3 == 0
    return rows.select(
        "source", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.when(building, "construction").otherwise("pedestrian").alias("road_class"),
        trusted.alias("trusted"), (s % 17 == 0).alias("preserved"), (trusted & (s % 10 == 0)).alias("walkable_construction"), "a", "m",
    )


def matched(features: DataFrame) -> DataFrame:
    s = F.col("source")
    action = F.when(s % 11 == 0, "ambiguous").when(s % 8 >= 6, "matched").otherwise("new_candidate")
    return features.filter(s % 13 != 0).select("source", action.alias("action"), F.when(action == "matched", F.col("a")).alias("u"), F.when(action == "matched", F.col("m")).alias("v"))


def fused(spark, d) -> fusion.Fused:
    features = settle(survey(spark, d))
    return fusion.fuse(base_edges(spark, d), road_nodes(spark, d), features.drop("a", "m"), matched(features))


_FUSED = f"""WITH RECURSIVE {HOPS}, {NODES}, xy AS (SELECT node, (lng - 114.346::DOUBLE) * 95000 AS x, (lat - 30.517::DOUBLE) * 110000 AS y FROM nodes),
roads AS (SELECT u AS a, min(v) AS m FROM hops GROUP BY u),
latest AS (SELECT o_custkey AS source, max(o_orderkey) AS l_orderkey FROM orders GROUP BY 1), ends_ AS (SELECT l_orderkey, min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY 1),
r AS (SELECT source AS s, source % 8 AS kind, ends_.a, ends_.b, m, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_, w.x AS mx, w.y AS my FROM latest JOIN ends_ USING (l_orderkey) JOIN roads ON roads.a = ends_.a JOIN xy p ON p.node = ends_.a JOIN xy q ON q.node = ends_.b JOIN xy w ON w.node = m),
f AS (SELECT s, a, m, s % 5 = 0 AS building, s % 3 = 0 AS trusted, s % 17 = 0 AS preserved, s % 3 = 0 AND s % 10 = 0 AS walkable,
  CASE WHEN kind = 5 THEN ax + 40.15::DOUBLE WHEN kind = 6 THEN ax + 0.5::DOUBLE ELSE ax + 0.3::DOUBLE * (s % 4) END AS x1, CASE WHEN kind = 5 THEN ay + 33.3::DOUBLE ELSE ay END AS y1,
  CASE kind WHEN 2 THEN ax + 500.0::DOUBLE + s WHEN 3 THEN (ax + mx) / 2 WHEN 4 THEN ax + 40.1::DOUBLE WHEN 6 THEN mx + 0.5::DOUBLE WHEN 7 THEN mx + 50.0::DOUBLE ELSE bx END AS x2,
  CASE kind WHEN 2 THEN ay + 300.25::DOUBLE WHEN 3 THEN (ay + my) / 2 + CASE WHEN s % 16 < 8 THEN 0.04::DOUBLE ELSE 1.0::DOUBLE END WHEN 4 THEN ay + 33.3::DOUBLE WHEN 6 THEN my WHEN 7 THEN my WHEN 5 THEN by_ + 0.5::DOUBLE ELSE by_ + 1.2::DOUBLE END AS y2,
  CASE WHEN s % 13 = 0 THEN 'unaccounted' WHEN s % 11 = 0 THEN 'ambiguous' WHEN s % 8 >= 6 THEN 'matched' ELSE 'new_candidate' END AS given FROM r),
g AS (SELECT *, CASE WHEN preserved THEN 'ambiguous' WHEN walkable THEN 'new_candidate' WHEN trusted AND building THEN 'ambiguous' WHEN trusted AND given <> 'matched' THEN 'new_candidate' ELSE given END AS action,
  CASE WHEN preserved THEN 'existing topology preserved' WHEN walkable THEN 'walkable construction' WHEN trusted AND building THEN 'construction excluded' WHEN trusted AND given <> 'matched' THEN 'trusted geometry, walk only' WHEN trusted THEN 'trusted match or geometry' ELSE 'correspondence' END AS policy FROM f),
e AS (SELECT least(a, m) AS a, greatest(a, m) AS b, bool_or((a + m) % 9 = 0) AS grade FROM roads GROUP BY ALL), l AS (SELECT e.*, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_ FROM e JOIN xy p ON p.node = a JOIN xy q ON q.node = b),
c AS (SELECT g.*, l.a AS ea, l.b AS eb, least(greatest(sqrt(pow(x1 - ax, 2) + pow(y1 - ay, 2)), sqrt(pow(x2 - bx, 2) + pow(y2 - by_, 2))), greatest(sqrt(pow(x2 - ax, 2) + pow(y2 - ay, 2)), sqrt(pow(x1 - bx, 2) + pow(y1 - by_, 2)))) <= 2 AS fits
  FROM g LEFT JOIN l ON g.action = 'matched' AND l.a = least(g.a, g.m) AND l.b = greatest(g.a, g.m)),
h AS (SELECT *, count_if(fits) OVER (PARTITION BY ea, eb) AS claims FROM c),
k AS (SELECT *, CASE WHEN coalesce(fits AND claims = 1, false) THEN 'replaced' WHEN (action = 'new_candidate' OR action = 'matched' AND trusted) AND (NOT building OR walkable) THEN CASE WHEN x1 <> x2 OR y1 <> y2 THEN 'open' ELSE 'degenerate' END
  WHEN action = 'matched' THEN CASE WHEN coalesce(fits, false) THEN 'competing features' ELSE 'geometry gate failed' END WHEN action = 'new_candidate' THEN 'construction excluded' ELSE action END AS first_ FROM h),
n AS (SELECT s, trusted, s * 2 AS end_, x1 AS x, y1 AS y FROM k WHERE first_ = 'open' UNION ALL SELECT s, trusted, s * 2 + 1, x2, y2 FROM k WHERE first_ = 'open'),
near AS (SELECT p.end_ AS u, q.end_ AS v FROM n p JOIN n q ON round(p.x) - round(q.x) BETWEEN -1 AND 1 AND floor(p.y) - floor(q.y) BETWEEN -1 AND 1 AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 0.15),
cl(end_, seen) AS (SELECT end_, end_ FROM n UNION SELECT cl.end_, v FROM cl JOIN near ON near.u = cl.seen),
cluster AS (SELECT end_, min(seen) AS cluster FROM cl GROUP BY end_), spot AS (SELECT n.end_ AS cluster, x, y FROM n JOIN cluster USING (end_) WHERE end_ = cluster),
side AS (SELECT s, bool_and(trusted) AS trusted, min(CASE WHEN end_ % 2 = 0 THEN cluster END) AS u, min(CASE WHEN end_ % 2 = 1 THEN cluster END) AS v FROM n JOIN cluster USING (end_) GROUP BY s),
both_ AS (SELECT u, v FROM side UNION SELECT v, u FROM side), pt(c, seen) AS (SELECT cluster, cluster FROM spot UNION SELECT pt.c, v FROM pt JOIN both_ ON both_.u = pt.seen), part AS (SELECT c AS cluster, min(seen) AS part FROM pt GROUP BY c),
dn AS (SELECT cluster, node, sqrt(pow(spot.x - xy.x, 2) + pow(spot.y - xy.y, 2)) AS dist FROM spot, xy WHERE abs(spot.x - xy.x) <= 2 AND abs(spot.y - xy.y) <= 2), dm AS (SELECT *, min(dist) OVER (PARTITION BY cluster) AS least_ FROM dn WHERE dist <= 2),
an AS (SELECT cluster, arg_min(node, dist) AS node, min(dist) AS gap, count(*) AS about FROM dm WHERE dist <= least_ + 0.5 GROUP BY cluster),
le AS (SELECT cluster, a, b, grade, ax, ay, bx, by_, x, y, greatest(0, least(1, coalesce(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0), 0))) AS t FROM spot, l WHERE cluster NOT IN (SELECT cluster FROM an)),
lf AS (SELECT *, ax + t * (bx - ax) AS px, ay + t * (by_ - ay) AS py, sqrt((x - (ax + t * (bx - ax))) * (x - (ax + t * (bx - ax))) + (y - (ay + t * (by_ - ay))) * (y - (ay + t * (by_ - ay)))) AS dist FROM le), lg AS (SELECT *, min(dist) OVER (PARTITION BY cluster) AS least_ FROM lf WHERE dist <= 2),
ae AS (SELECT cluster, min((dist, a, b)) AS best, arg_min(struct_pack(a := a, b := b, px := px, py := py, grade := grade), dist) AS e, min(dist) AS gap, count(*) AS about FROM lg WHERE dist <= least_ + 0.5 GROUP BY cluster),
hung AS (SELECT cluster, 'node' AS kind, node, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS px, NULL::DOUBLE AS py, gap FROM an WHERE about = 1 UNION ALL SELECT cluster, 'edge', NULL, e.a, e.b, e.px, e.py, gap FROM ae WHERE about = 1 AND NOT e.grade),
anchor AS (SELECT part, count(DISTINCT (kind, node, a, b, round(px, 1), round(py, 1))) AS anchors FROM hung JOIN part USING (cluster) GROUP BY part),
judged AS (SELECT part, min(s) AS first_source, coalesce(any_value(anchors), 0) AS anchors, coalesce(any_value(anchors), 0) >= CASE WHEN bool_and(trusted) THEN 1 ELSE 2 END AS kept FROM side JOIN part ON part.cluster = side.u LEFT JOIN anchor USING (part) GROUP BY part),
verdict AS (SELECT s AS source, action, policy, CASE WHEN first_ <> 'open' THEN first_ WHEN kept THEN 'added' ELSE 'insufficient anchors' END AS disposition, first_source AS part, anchors FROM k LEFT JOIN (SELECT s, first_source, anchors, kept FROM side JOIN part ON part.cluster = side.u JOIN judged USING (part)) j USING (s))"""


@query(f"{_FUSED} SELECT * FROM verdict")
def grf17_fusion(spark, d):
    """What becomes of every surveyed feature."""
    return fused(spark, d).features


@query(f"""{_FUSED}, hit AS (SELECT DISTINCT a, b, round(px, 2) AS x, round(py, 2) AS y FROM hung JOIN part USING (cluster) JOIN judged USING (part) WHERE kept AND kind = 'edge'), cut AS (SELECT a, b, count(*) AS n FROM hit GROUP BY ALL),
ne AS (SELECT ea AS a, eb AS b, true AS replaced FROM k WHERE first_ = 'replaced'), w AS (SELECT e.a, e.b, coalesce(n, 0) AS n, coalesce(replaced, false) AS replaced, (SELECT count(*) FROM roads WHERE roads.a = e.a AND m = e.b OR roads.a = e.b AND m = e.a) AS ways FROM e LEFT JOIN cut USING (a, b) LEFT JOIN ne USING (a, b)),
x AS (SELECT CASE WHEN n > 0 THEN 'split' WHEN replaced THEN 'replaced' ELSE 'base' END AS origin, (n + 1) * ways AS edges FROM w UNION ALL SELECT 'feature', 2 FROM verdict WHERE disposition = 'added' UNION ALL SELECT 'connector', 2 FROM hung JOIN part USING (cluster) JOIN judged USING (part) WHERE kept AND kind = 'edge' AND gap > 0.05)
SELECT origin, sum(edges)::BIGINT AS edges FROM x GROUP BY origin""")
def grf17_fused_edges(spark, d):
    """Edges of the fused network by origin, both directions."""
    return fused(spark, d).edges.groupBy("origin").agg(F.count(F.lit(1)).alias("edges"))
