"""Fusion of a road network with the features of a second source, under a policy.

Every feature gets one disposition. A matched feature replaces its edge's geometry if its ends lie at
the edge's ends and no other feature claims the edge. New features are joined at their ends into
parts; a part is added if it hangs on the network in two places at least, or in one if all its
features are trusted. A place is a node, or the inside of an edge that is then split there. Features
that have neither stay out, with the reason.

Coordinates are planar metres. Null actions count as unaccounted; an empty side leaves the other as
it is. Parts come from components of shared ends, so nothing is held in one task but what one place
has around it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.operators import spatial
from pathloom.operators.graph import components, settle

#: Ends this close are one; places whose distances differ by less are ambiguous; a gap that needs no connector; metres.
SAME_END, AMBIGUOUS, NO_GAP = 0.15, 0.5, 0.05


class Fused(NamedTuple):
    """edges: u, v, length, origin, walk_only in both directions; features and base: dispositions."""

    edges: DataFrame
    features: DataFrame
    base: DataFrame


def metres(x1, y1, x2, y2) -> Column:
    return F.sqrt(F.pow(F.col(x1) - F.col(x2), 2) + F.pow(F.col(y1) - F.col(y2), 2))


def planar_join(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """Pairs within reach, with their distance. left has x, y and right has rx, ry; right's rows go to the cells around them."""
    cell = lambda x, y, i=0, j=0: F.struct((F.floor(F.col(x) / reach) + i).alias("cx"), (F.floor(F.col(y) / reach) + j).alias("cy"))
    sent = right.withColumn("__cell", F.explode(F.array(*[cell("rx", "ry", i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])))
    pairs = left.withColumn("__cell", cell("x", "y")).join(sent.hint("merge"), "__cell").drop("__cell")
    return pairs.withColumn("distance", metres("x", "y", "rx", "ry")).filter(F.col("distance") <= reach)


def decide(features: DataFrame, matches: DataFrame) -> DataFrame:
    """features with the action that the policy makes of the match, and the policy's name.

    features: source, x1, y1, x2, y2, road_class, trusted, preserved, walkable_construction.
    matches: source, action (matched, ambiguous, new_candidate), u, v (the only candidate, if matched).
    """
    building = F.col("road_class") == "construction"
    given = F.coalesce("given", F.lit("unaccounted"))
    trusted = F.col("trusted")
    rules = [
        (F.col("preserved"), "ambiguous", "existing topology preserved"),
        (F.col("walkable_construction") & trusted & building, "new_candidate", "walkable construction"),
        (trusted & building, "ambiguous", "construction excluded"),
        (trusted & (given != "matched"), "new_candidate", "trusted geometry, walk only"),
        (trusted, "matched", "trusted match or geometry"),
    ]
    action, policy = given, F.lit("correspondence")
    for condition, to, name in reversed(rules):
        action, policy = F.when(condition, F.lit(to)).otherwise(action), F.when(condition, F.lit(name)).otherwise(policy)
    joined = features.join(matches.select("source", F.col("action").alias("given"), "u", "v"), "source", "left")
    return joined.withColumns({"action": action, "policy": policy, "building": F.coalesce(building, F.lit(False))}).drop("given")


def replacements(decided: DataFrame, lines: DataFrame, gate: float) -> DataFrame:
    """source, a, b, metres, fits, claims of each matched feature: whether its ends lie at its edge's, and how many features claim the edge."""
    matched = decided.filter("action = 'matched' and u is not null").withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")})
    there = F.greatest(metres("x1", "y1", "ax", "ay"), metres("x2", "y2", "bx", "by"))
    back = F.greatest(metres("x2", "y2", "ax", "ay"), metres("x1", "y1", "bx", "by"))
    gated = matched.join(lines, ["a", "b"]).select("source", "a", "b", metres("x1", "y1", "x2", "y2").alias("metres"), (F.least(there, back) <= gate).alias("fits"))
    claims = gated.filter("fits").groupBy("a", "b").agg(F.count(F.lit(1)).alias("claims"))
    return gated.join(claims, ["a", "b"], "left")


def attachments(ends: DataFrame, nodes: DataFrame, lines: DataFrame, reach: float) -> DataFrame:
    """cluster, kind (node, edge), node or a, b and the foot's px, py, and the gap: where each place hangs on the network, if anywhere.

    The nearest node, unless another is about as near; where no node is near the nearest edge, unless
    another is about as near or the edge passes over or under.
    """
    near = settle(planar_join(ends, nodes.select("node", F.col("x").alias("rx"), F.col("y").alias("ry")), reach))
    best = near.groupBy("cluster").agg(F.min("distance").alias("least"))
    node = near.join(best, "cluster").filter(F.col("distance") <= F.col("least") + AMBIGUOUS).groupBy("cluster").agg(F.min(F.struct("distance", "node")).alias("n"), F.count(F.lit(1)).alias("about"))
    node = node.filter("about = 1").select("cluster", F.lit("node").alias("kind"), "n.node", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("px"), F.lit(None).cast("double").alias("py"), F.lit(None).cast("double").alias("t"), F.col("n.distance").alias("gap"))

    wide = 2 * reach
    pieces = spatial.densify(lines.select(F.struct("a", "b").alias("line"), F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2"), metres("ax", "ay", "bx", "by").alias("length")), reach)
    around = F.explode(F.array(*[F.struct((F.floor(F.col("x") / wide) + i).alias("cx"), (F.floor(F.col("y") / wide) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    touched = pieces.select("line.a", "line.b", around.alias("cell")).distinct()
    free = ends.join(best, "cluster", "left_anti").withColumn("cell", F.struct(F.floor(F.col("x") / wide).alias("cx"), F.floor(F.col("y") / wide).alias("cy")))
    met = free.join(touched.hint("merge"), "cell").drop("cell").join(lines, ["a", "b"])
    t, distance = geo.segment_projection(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])
    met = settle(met.withColumns({"t": t, "distance": distance}).filter(F.col("distance") <= reach))
    least = met.groupBy("cluster").agg(F.min("distance").alias("least"))
    rows = F.struct("distance", "a", "b", "t", "grade_separated", (F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax"))).alias("px"), (F.col("ay") + F.col("t") * (F.col("by") - F.col("ay"))).alias("py"))
    edge = met.join(least, "cluster").filter(F.col("distance") <= F.col("least") + AMBIGUOUS).groupBy("cluster").agg(F.min(rows).alias("e"), F.count(F.lit(1)).alias("about"))
    edge = edge.filter("about = 1 and not e.grade_separated").select("cluster", F.lit("edge").alias("kind"), F.lit(None).cast("long").alias("node"), "e.a", "e.b", "e.px", "e.py", "e.t", F.col("e.distance").alias("gap"))
    return node.unionByName(edge)


def fuse(edges: DataFrame, nodes: DataFrame, features: DataFrame, matches: DataFrame, reach: float = 2.0) -> Fused:
    """edges: u, v, grade_separated; nodes: node, x, y; features and matches: see decide().

    Ids of new nodes follow from the smallest end that they stand for, above all ids of the network,
    so that no numbering over all of them is needed.
    """
    at = lambda k: nodes.select(F.col("node").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    pairs = edges.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.bool_or("grade_separated").alias("grade_separated"))
    lines = settle(pairs.join(at("a"), "a").join(at("b"), "b"))
    decided = settle(decide(features, matches))
    claimed = settle(replacements(decided, lines, reach))
    marked = decided.join(claimed.select("source", "fits", "claims"), "source", "left")
    replaced = F.coalesce(F.col("fits") & (F.col("claims") == 1), F.lit(False))
    fallback = (F.col("action") == "matched") & ~replaced & F.col("trusted")
    wanted = ((F.col("action") == "new_candidate") | fallback) & (~F.col("building") | F.col("walkable_construction"))
    length = metres("x1", "y1", "x2", "y2")
    first = F.when(replaced, "replaced").when(wanted & (length > 0), "open").when(wanted, "degenerate").when((F.col("action") == "matched") & ~F.coalesce("fits", F.lit(False)), "geometry gate failed")
    first = first.when(F.col("action") == "matched", "competing features").when(F.col("action") == "new_candidate", "construction excluded").otherwise(F.col("action"))
    marked = settle(marked.withColumns({"first": first, "metres": length}))

    # Ends that coincide are one place; parts are features that share places.
    new = marked.filter("first = 'open'").select("source", "trusted", "metres", F.posexplode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("side", "p"))
    new = settle(new.select("source", "trusted", "metres", "side", (F.col("source") * 2 + F.col("side")).alias("end"), "p.x", "p.y"))
    spots = settle(new.groupBy("x", "y").agg(F.min("end").alias("spot")))
    close = planar_join(spots, spots.select(F.col("spot").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry")), SAME_END).filter("spot < other")
    groups = components(close.select(F.col("spot").alias("u"), F.col("other").alias("v")), spots.select(F.col("spot").alias("node")))
    placed = settle(new.join(spots, ["x", "y"]).join(groups.withColumnsRenamed({"node": "spot", "component": "cluster"}), "spot"))
    ends = placed.filter("end = cluster").select("cluster", "x", "y")
    sides = placed.groupBy("source").agg(F.min_by("cluster", "side").alias("u"), F.max_by("cluster", "side").alias("v"), F.first("trusted").alias("trusted"), F.first("metres").alias("metres"))
    sides = settle(sides)
    parts = components(sides.select("u", "v"), ends.select(F.col("cluster").alias("node"))).withColumnsRenamed({"node": "cluster", "component": "part"})
    hung = settle(attachments(ends, nodes, lines, reach).join(parts, "cluster"))
    sign = F.when(F.col("kind") == "node", F.struct(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))).otherwise(F.struct("a", "b", F.round("px", 1).alias("x"), F.round("py", 1).alias("y")))
    anchors = hung.select("part", sign.alias("sign")).distinct().groupBy("part").agg(F.count(F.lit(1)).alias("anchors"))
    trusted = sides.join(parts, F.col("u") == F.col("cluster")).groupBy("part").agg(F.bool_and("trusted").alias("trusted"), F.min("source").alias("first_source"))
    judged = settle(trusted.join(anchors, "part", "left").select("part", "first_source", F.coalesce("anchors", F.lit(0)).alias("anchors"), (F.coalesce("anchors", F.lit(0)) >= F.when(F.col("trusted"), 1).otherwise(2)).alias("kept")))
    of = settle(sides.join(parts, F.col("u") == F.col("cluster")).join(judged, "part").select("source", "u", "v", "metres", "part", "first_source", "anchors", "kept"))

    verdict = F.when(F.col("first") != "open", F.col("first")).when(F.col("kept"), "added").otherwise("insufficient anchors")
    dispositions = marked.join(of.select("source", "first_source", "anchors", "kept"), "source", "left").select("source", "action", "policy", verdict.alias("disposition"), F.col("first_source").alias("part"), "anchors")

    used = settle(hung.join(judged.filter("kept").select("part"), "part"))
    top = nodes.agg(F.max("node")).first()[0] or 0
    span = 2 * (features.agg(F.max("source")).first()[0] or 0) + 2
    # One split node for each point of an edge, named by the smallest place that hangs there.
    cuts = used.filter("kind = 'edge'").groupBy("a", "b", F.round("px", 2).alias("cut_x"), F.round("py", 2).alias("cut_y")).agg(F.min("cluster").alias("lead"), F.min("t").alias("t"))
    cuts = settle(cuts.select("a", "b", "cut_x", "cut_y", (F.col("lead") + top + 1 + span).alias("split"), "t"))
    own = used.withColumns({"cut_x": F.round("px", 2), "cut_y": F.round("py", 2)}).join(cuts.select("a", "b", "cut_x", "cut_y", "split"), ["a", "b", "cut_x", "cut_y"], "left")
    own = settle(own.select("cluster", "node", "split", "gap"))
    named = F.coalesce("node", F.when(F.col("gap") <= NO_GAP, F.col("split")), F.col("cluster") + top + 1)
    names = settle(ends.select("cluster").join(own, "cluster", "left").select("cluster", named.alias("name"), "split", "gap"))
    name_of = lambda k: names.select(F.col("cluster").alias(k), F.col("name").alias(f"{k}_name"))
    added = of.filter("kept").join(name_of("u"), "u").join(name_of("v"), "v").select(F.col("u_name").alias("u"), F.col("v_name").alias("v"), F.col("metres").alias("length"), F.lit("feature").alias("origin"))
    connectors = names.filter(f"split is not null and gap > {NO_GAP}").select(F.col("name").alias("u"), F.col("split").alias("v"), F.col("gap").alias("length"), F.lit("connector").alias("origin"))

    new_length = claimed.filter("fits and claims = 1").select("a", "b", F.col("metres").alias("new_length"))
    measured = lines.join(new_length, ["a", "b"], "left").select("a", "b", F.coalesce("new_length", metres("ax", "ay", "bx", "by")).alias("length"), F.col("new_length").isNotNull().alias("replaced"))
    by_edge = cuts.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("t", "split"))).alias("cuts"))
    stops = F.concat(F.array(F.struct(F.lit(0.0).alias("t"), F.col("a").alias("split"))), F.coalesce("cuts", F.array().cast("array<struct<t:double,split:bigint>>")), F.array(F.struct(F.lit(1.0).alias("t"), F.col("b").alias("split"))))
    count = F.when(F.col("cuts").isNull(), 0).otherwise(F.size("cuts"))
    spans = settle(measured.join(by_edge, ["a", "b"], "left").withColumns({"n": count, "stops": stops}))
    piece = F.explode(F.expr("transform(sequence(1, n + 1), i -> struct(stops[i - 1].split as u, stops[i].split as v, (stops[i].t - stops[i - 1].t) as share))"))
    kept = spans.select("a", "b", "length", "replaced", "n", piece.alias("p")).select("p.u", "p.v", (F.col("length") * F.col("p.share")).alias("length"), F.when(F.col("n") > 0, "split").when(F.col("replaced"), "replaced").otherwise("base").alias("origin"), "a", "b", "n")
    # Pieces keep the directions that their edge has.
    ways = edges.select("u", "v").distinct().select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), (F.col("u") <= F.col("v")).alias("forth"))
    kept = kept.join(ways, ["a", "b"]).select(F.when(F.col("forth"), F.col("u")).otherwise(F.col("v")).alias("u"), F.when(F.col("forth"), F.col("v")).otherwise(F.col("u")).alias("v"), "length", "origin", F.lit(False).alias("walk_only"))
    fresh = added.unionByName(connectors)
    walks = fresh.unionByName(fresh.select(F.col("v").alias("u"), F.col("u").alias("v"), "length", "origin")).withColumn("walk_only", F.lit(True))
    base = spans.select("a", "b", F.when((F.col("n") > 0) & F.col("replaced"), "replaced and split").when(F.col("n") > 0, "split").when(F.col("replaced"), "replaced").otherwise("unchanged").alias("disposition"))
    return Fused(kept.unionByName(walks), dispositions, base)
