"""Aggregations, window and sequence operators, ranking and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathloom.functions import geo, routing
from pathloom.operators import graph, sequences, spatial
from pathloom.plans.base import ALL_EDGES, EDGES, EVENTS, NODES, NOW, PLACES, READINGS, RUNS, all_edges, edges, events, places, query, read, readings, runs
from pathloom.plans.rows import _EQ


@query(f"""WITH {ALL_EDGES} SELECT count(*) AS n, round(sum(length), 4) AS total, round(avg(length), 6) AS mean, min(length) AS shortest, max(length) AS longest FROM all_edges""")
def agg01_network_stats(spark, d):
    length = F.col("length")
    return all_edges(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(length), 4).alias("total"), F.round(F.avg(length), 6).alias("mean"), F.min(length).alias("shortest"), F.max(length).alias("longest"))


@query(f"""WITH {ALL_EDGES} SELECT coalesce(scenery::VARCHAR, 'missing') AS level, highway, count(*) AS n FROM all_edges GROUP BY ALL""")
def agg02_group_counts(spark, d):
    return all_edges(spark, d).groupBy(F.coalesce(F.col("scenery").cast("string"), F.lit("missing")).alias("level"), "highway").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PLACES} SELECT name, count(*) AS n, min(id) AS first FROM places GROUP BY name ORDER BY n DESC, first LIMIT 25""")
def agg03_most_common(spark, d):
    return places(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).orderBy(F.desc("n"), "first").limit(25)


@query(f"""WITH {PLACES} SELECT name, array_to_string(list_sort(list_distinct(list(type))), ',') AS types FROM places GROUP BY name HAVING count(DISTINCT type) > 1""")
def agg04_alias_conflicts(spark, d):
    return places(spark, d).groupBy("name").agg(F.array_sort(F.collect_set("type")).alias("types")).filter("size(types) > 1").withColumn("types", F.array_join("types", ","))


@query(f"""WITH {ALL_EDGES} SELECT highway, count(*) AS n, count_if(scenery IS NOT NULL) AS annotated, round(count_if(scenery IS NOT NULL) * 100.0::DOUBLE / count(*), 2) AS percent FROM all_edges GROUP BY highway""")
def agg05_coverage(spark, d):
    has = F.count_if(F.col("scenery").isNotNull())
    return all_edges(spark, d).groupBy("highway").agg(F.count(F.lit(1)).alias("n"), has.alias("annotated"), F.round(has * 100.0 / F.count(F.lit(1)), 2).alias("percent"))


@query(f"""WITH {ALL_EDGES} SELECT u, round(coalesce(sum(coalesce(scenery, 3) * length) / nullif(sum(length), 0), 0), 6) AS scenery FROM all_edges GROUP BY u""")
def agg06_weighted_average(spark, d):
    weighted = F.sum(F.coalesce("scenery", F.lit(routing.MISSING_LEVEL)) * F.col("length"))
    return all_edges(spark, d).groupBy("u").agg(F.round(F.coalesce(weighted / F.nullif(F.sum("length"), F.lit(0)), F.lit(0.0)), 6).alias("scenery"))


@query(f"""WITH {ALL_EDGES}, m AS (SELECT max(length) AS longest FROM all_edges) SELECT u, round(sum(0.5 * length / longest), 6) AS distance, round(sum(0.2 * slope / 5.0), 6) AS slope, round(sum(0.3 * (1 - coalesce(scenery, 3) / 5.0)), 6) AS scenery FROM all_edges, m GROUP BY u""")
def agg07_cost_sums(spark, d):
    e = all_edges(spark, d)
    longest = e.agg(F.max("length").alias("longest"))
    part = lambda c, name: F.round(F.sum(c), 6).alias(name)
    return e.join(F.broadcast(longest)).groupBy("u").agg(part(0.5 * F.col("length") / F.col("longest"), "distance"), part(0.2 * F.col("slope") / 5.0, "slope"), part(0.3 * (1 - F.coalesce("scenery", F.lit(3)) / 5.0), "scenery"))


@query(f"""WITH {ALL_EDGES} SELECT u, v, k, round(length / max(length) OVER (), 6) AS share FROM all_edges""")
def agg08_max_normalised(spark, d):
    e = all_edges(spark, d)
    return e.join(F.broadcast(e.agg(F.max("length").alias("longest")))).select("u", "v", "k", F.round(F.col("length") / F.col("longest"), 6).alias("share"))


@query(f"""WITH {READINGS} SELECT kind, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM readings GROUP BY kind""")
def agg09_linear_percentiles(spark, d):
    p = lambda q: F.round(F.percentile("value", q), 6)
    return readings(spark, d).groupBy("kind").agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"))


@query(f"""WITH {READINGS} SELECT kind, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM readings GROUP BY kind""")
def agg10_nearest_rank_percentiles(spark, d):
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    return readings(spark, d).groupBy("kind").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query(f"""WITH {READINGS} SELECT "user", list_sort(list(value))[count(*)::INTEGER // 2 + 1] AS upper_median FROM readings GROUP BY "user" """)
def agg11_upper_median(spark, d):
    """The middle value, the upper one of two: the row at that rank, without collecting a group."""
    w = Window.partitionBy("user")
    ranked = readings(spark, d).withColumns({"rank": F.row_number().over(w.orderBy("value")), "n": F.count(F.lit(1)).over(w)})
    return ranked.filter(F.col("rank") == F.floor(F.col("n") / 2) + 1).select("user", F.col("value").alias("upper_median"))


@query(f"""WITH {PLACES} SELECT type, round(avg(lng), 6) AS lng, round(avg(lat), 6) AS lat, count(*) AS members FROM places WHERE regexp_matches(name, 'ring|bolt') GROUP BY type""")
def agg12_centroids(spark, d):
    return places(spark, d).filter(F.col("name").rlike("ring|bolt")).groupBy("type").agg(F.round(F.avg("lng"), 6).alias("lng"), F.round(F.avg("lat"), 6).alias("lat"), F.count(F.lit(1)).alias("members"))


@query(f"""WITH {PLACES}, x AS (SELECT a.id, b.scenery::DOUBLE AS v FROM places a JOIN places b ON sqrt(pow((b.lng - a.lng) * cos(radians(a.lat)) * 111320, 2) + pow((b.lat - a.lat) * 111320, 2)) <= 60) SELECT id, median(v) AS median FROM x GROUP BY id""")
def agg13_median_smoothing(spark, d):
    return spatial.smooth_median(places(spark, d).withColumn("scenery", F.col("scenery").cast("double")), "id", "scenery", 60.0)


@query(f"""WITH {PLACES}, c AS (SELECT id, CASE WHEN id % 3 > 0 THEN least(1.0::DOUBLE, scenery / 40.0) END AS a, CASE WHEN id % 4 > 0 THEN importance / 2000 END AS b FROM places)
SELECT id, round((coalesce(0.6 * a, 0) + coalesce(0.4 * b, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 0.6 END + CASE WHEN b IS NULL THEN 0 ELSE 0.4 END, 0), 6) AS score, round(CASE WHEN a IS NULL THEN 0 ELSE 0.6 END + CASE WHEN b IS NULL THEN 0 ELSE 0.4 END, 6)::DOUBLE AS coverage FROM c""")
def agg14_partial_score(spark, d):
    parts = [(0.6, F.when(F.col("id") % 3 > 0, F.least(F.lit(1.0), F.col("scenery") / 40.0))), (0.4, F.when(F.col("id") % 4 > 0, F.col("importance") / 2000))]
    total = sum((F.coalesce(w * c, F.lit(0.0)) for w, c in parts), F.lit(0.0))
    cover = sum((F.when(c.isNotNull(), w).otherwise(0.0) for w, c in parts), F.lit(0.0))
    return places(spark, d).select("id", F.round(total / F.nullif(cover, F.lit(0.0)), 6).alias("score"), F.round(cover, 6).alias("coverage"))


@query(f"""WITH {READINGS}, p AS (SELECT "user", value - lag(value) OVER (PARTITION BY "user" ORDER BY micros, id) AS step FROM readings)
SELECT "user", round(sum(greatest(step, 0)), 4) AS gain, round(sum(greatest(-step, 0)), 4) AS loss, round(quantile_cont(abs(step) / 10, 0.9), 6) AS p90 FROM p WHERE step IS NOT NULL GROUP BY "user" """)
def agg15_profile(spark, d):
    w = Window.partitionBy("user").orderBy("micros", "id")
    steps = readings(spark, d).withColumn("step", F.col("value") - F.lag("value").over(w)).filter("step is not null")
    up = lambda c: F.round(F.sum(F.greatest(c, F.lit(0.0))), 4)
    return steps.groupBy("user").agg(up(F.col("step")).alias("gain"), up(-F.col("step")).alias("loss"), F.round(F.percentile(F.abs("step") / 10, 0.9), 6).alias("p90"))


@query(f"""WITH {READINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY "user", kind ORDER BY value DESC, id) AS n FROM readings) SELECT "user", kind, id, value FROM r WHERE n = 1""")
def agg16_strongest(spark, d):
    best = F.max_by(F.struct("id", "value"), F.struct(F.col("value"), -F.col("id")))
    return readings(spark, d).groupBy("user", "kind").agg(best.alias("b")).select("user", "kind", "b.id", "b.value")


@query("""SELECT o_orderpriority AS priority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderdate) AS days FROM orders GROUP BY 1""")
def agg17_distinct(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderdate").alias("days"))


@query(f"""WITH {READINGS} SELECT kind, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS peak FROM readings GROUP BY kind""")
def agg18_merged_partials(spark, d):
    """Segments first, then their merge: a mean of means weighted by counts, a maximum of maxima."""
    segments = readings(spark, d).groupBy("kind", F.floor(F.col("id") / 180).alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("peak"))
    return segments.groupBy("kind").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("mean") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.max("peak").alias("peak"))


@query(f"""WITH {READINGS}, f AS (SELECT count(DISTINCT id // 20) AS frames FROM readings), c AS (SELECT kind, id // 20 AS frame, count(*) AS n FROM readings GROUP BY ALL) SELECT kind, round(sum(n) / any_value(frames), 2) AS mean, max(n) AS peak FROM c, f GROUP BY kind""")
def agg19_dense_means(spark, d):
    frame = F.floor(F.col("id") / 20)
    r = readings(spark, d).withColumn("frame", frame)
    frames = r.agg(F.count_distinct("frame").alias("frames"))
    return r.groupBy("kind", "frame").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(frames)).groupBy("kind").agg(F.round(F.sum("n") / F.first("frames"), 2).alias("mean"), F.max("n").alias("peak"))


@query(f"""WITH {ALL_EDGES}, h AS (SELECT u, md5(string_agg(sha256(u || '-' || v || '-' || k), '' ORDER BY sha256(u || '-' || v || '-' || k))) AS part FROM all_edges GROUP BY u) SELECT md5(string_agg(part, '' ORDER BY u)) AS fingerprint, count(*) AS nodes FROM h""")
def agg20_fingerprint(spark, d):
    """A digest of all rows that no order changes: rows are digested within nodes, nodes within the graph."""
    row = F.sha2(F.concat_ws("-", *[F.col(c).cast("string") for c in ("u", "v", "k")]), 256)
    parts = all_edges(spark, d).groupBy("u").agg(F.md5(F.array_join(F.array_sort(F.collect_list(row)), "")).alias("part"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("u", "part"))), lambda x: x["part"])
    return parts.agg(F.md5(F.array_join(ordered, "")).alias("fingerprint"), F.count(F.lit(1)).alias("nodes"))


@query(f"""WITH {ALL_EDGES} SELECT least(u, v) AS a, greatest(u, v) AS b, road, count(*) AS directed, bool_or(highway = 'steps') AS has_steps, min(length) AS length FROM all_edges GROUP BY ALL""")
def agg21_physical_edges(spark, d):
    return graph.collapse(all_edges(spark, d))


@query(f"""WITH {EVENTS}, f AS (SELECT place, mode, kind, max(multiplier) AS factor FROM events_ GROUP BY ALL) SELECT place, mode, round(exp(sum(ln(factor))), 6) AS penalty, count(*) AS sources FROM f GROUP BY place, mode""")
def agg22_penalties(spark, d):
    within = events(spark, d).groupBy("place", "mode", "kind").agg(F.max("multiplier").alias("factor"))
    return within.groupBy("place", "mode").agg(F.round(graph.product(F.col("factor")), 6).alias("penalty"), F.count(F.lit(1)).alias("sources"))


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3""")
def win01_last_n(spark, d):
    return sequences.last_n(read(spark, d, "conversations"), ["conv_id"], "turn", 3).select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@query("""SELECT conv_id, min(turn) AS first_turn, arg_min(role, turn) AS first_role, max(turn) AS last_turn, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id""")
def win02_first_and_latest(spark, d):
    c = read(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.min_by("role", "turn").alias("first_role"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))


_GAPS = """g AS (SELECT *, coalesce((micros - lag(micros) OVER w > 1800000000)::INTEGER, 1) AS new FROM readings WINDOW w AS (PARTITION BY "user" ORDER BY micros, id)), c AS (SELECT *, sum(new) OVER (PARTITION BY "user" ORDER BY micros, id)::BIGINT AS cluster FROM g)"""


@query(f"""WITH {READINGS}, {_GAPS} SELECT "user", cluster, count(*) AS n, min(micros) AS start, max(micros) AS "end", round(avg(value), 6) AS mean FROM c GROUP BY ALL""")
def win03_gap_clusters(spark, d):
    c = sequences.gap_clusters(readings(spark, d), ["user"], ["micros", "id"], F.col("micros"), 1_800_000_000)
    return c.groupBy("user", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("micros").alias("start"), F.max("micros").alias("end"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"""WITH {READINGS}, s AS (SELECT DISTINCT kind, id // 4 AS segment FROM readings), i AS (SELECT kind, segment, segment - row_number() OVER (PARTITION BY kind ORDER BY segment) AS island FROM s) SELECT kind, min(segment) AS first, max(segment) AS last, count(*) AS segments FROM i GROUP BY kind, island""")
def win04_islands(spark, d):
    s = readings(spark, d).select("kind", F.floor(F.col("id") / 4).alias("segment")).distinct()
    return sequences.islands(s, ["kind"], "segment").groupBy("kind", "island").agg(F.min("segment").alias("first"), F.max("segment").alias("last"), F.count(F.lit(1)).alias("segments")).drop("island")


@query("""WITH r AS (SELECT l_orderkey, l_returnflag, l_extendedprice, l_linenumber, l_partkey, l_suppkey, coalesce((l_returnflag <> lag(l_returnflag) OVER w)::INTEGER, 1) AS new FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
c AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM r) SELECT l_orderkey AS "order", run, any_value(l_returnflag) AS flag, count(*) AS lines, round(sum(l_extendedprice), 2) AS price FROM c GROUP BY l_orderkey, run""")
def win05_merged_runs(spark, d):
    line = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("order"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return sequences.same_value_runs(line, ["order"], ["l_linenumber", "l_partkey", "l_suppkey"], "flag").groupBy("order", "run").agg(F.first("flag").alias("flag"), F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query(f"""WITH {ALL_EDGES} SELECT u, v, k, round(sum(length) OVER (PARTITION BY u ORDER BY v, k ROWS UNBOUNDED PRECEDING), 4) AS along FROM all_edges""")
def win06_cumulative(spark, d):
    return sequences.cumulative(all_edges(spark, d), ["u"], ["v", "k"], "length", "along").select("u", "v", "k", F.round("along", 4).alias("along"))


@query(f"""WITH {READINGS}, l AS (SELECT *, lag(id) OVER w AS before, lag(value) OVER w AS was, lead(value) OVER w AS next FROM readings WINDOW w AS (PARTITION BY kind ORDER BY id)) SELECT id, round(CASE WHEN id = before + 1 THEN value - was END, 4) AS step, round(next - value, 4) AS ahead FROM l""")
def win07_deltas(spark, d):
    w = Window.partitionBy("kind").orderBy("id")
    return readings(spark, d).select("id", F.round(F.when(F.col("id") == F.lag("id").over(w) + 1, F.col("value") - F.lag("value").over(w)), 4).alias("step"), F.round(F.lead("value").over(w) - F.col("value"), 4).alias("ahead"))


@query(f"""WITH {READINGS}, p AS (SELECT "user" // 10 AS line, row_number() OVER (PARTITION BY "user" // 10 ORDER BY micros, id) AS seq, value FROM readings), q AS (SELECT line, seq, CASE WHEN (seq % 11 IN (3, 4) AND seq > 1) OR (line % 4 = 1 AND seq % 50 BETWEEN 20 AND 22) THEN NULL ELSE value END AS value FROM p),
b AS (SELECT line, seq, value, max(CASE WHEN value IS NOT NULL THEN seq END) OVER (PARTITION BY line ORDER BY seq) AS lo, min(CASE WHEN value IS NOT NULL THEN seq END) OVER (PARTITION BY line ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM q),
x AS (SELECT b.*, bool_or(lo IS NULL OR hi IS NULL OR hi - lo - 1 > 2) OVER (PARTITION BY b.line) AS bad, l.value AS lv, h.value AS hv FROM b LEFT JOIN q l ON l.line = b.line AND l.seq = b.lo LEFT JOIN q h ON h.line = b.line AND h.seq = b.hi)
SELECT line, seq, round(CASE WHEN NOT bad THEN CASE WHEN hi = lo THEN lv ELSE lv + (hv - lv) * (seq - lo) / (hi - lo) END END, 6) AS filled FROM x""")
def win08_short_gaps(spark, d):
    line = F.floor(F.col("user") / 10)
    p = sequences.numbered(readings(spark, d).withColumn("line", line), ["line"], ["micros", "id"])
    hole = ((F.col("seq") % 11).isin(3, 4) & (F.col("seq") > 1)) | ((F.col("line") % 4 == 1) & (F.col("seq") % 50).between(20, 22))
    return sequences.fill_short_gaps(p.select("line", F.col("seq").cast("bigint").alias("seq"), F.when(~hole, F.col("value")).alias("value")), ["line"], "seq", "value", 2).select("line", "seq", F.round("filled", 6).alias("filled"))


@query(f"""WITH RECURSIVE {READINGS}, o AS (SELECT "user", value, row_number() OVER (PARTITION BY "user" ORDER BY micros, id) AS n, count(*) OVER (PARTITION BY "user") AS total FROM readings), e AS (SELECT "user", n, total, value AS ema FROM o WHERE n = 1 UNION ALL SELECT e."user", o.n, e.total, 0.7 * e.ema + 0.3 * o.value FROM e JOIN o ON o."user" = e."user" AND o.n = e.n + 1) SELECT "user", round(ema, 6) AS ema FROM e WHERE n = total""")
def win09_moving_average(spark, d):
    return sequences.fold_ema(readings(spark, d), ["user"], ["micros", "id"], "value", 0.7).select("user", F.round("ema", 6).alias("ema"))


@query(f"""WITH {READINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY "user", micros // 3600000000 ORDER BY value DESC, id) AS n FROM readings) SELECT "user", micros // 3600000000 AS hour, id, value FROM r WHERE n = 1""")
def win10_keep_best(spark, d):
    r = readings(spark, d).withColumn("hour", F.floor(F.col("micros") / 3_600_000_000))
    return sequences.keep_best(r, ["user", "hour"], [F.desc("value"), F.col("id")]).select("user", "hour", "id", "value")


@query(f"""WITH {READINGS} SELECT id, "user", row_number() OVER (PARTITION BY "user" ORDER BY micros, id) AS seq FROM readings""")
def win11_sequence_numbers(spark, d):
    return sequences.numbered(readings(spark, d), ["user"], ["micros", "id"]).select("id", "user", F.col("seq").cast("bigint").alias("seq"))


@query(f"""WITH {PLACES} SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY importance DESC, scenery DESC, name, id) AS rank FROM places""")
def win12_ranks(spark, d):
    return sequences.numbered(places(spark, d), ["type"], [F.desc("importance"), F.desc("scenery"), "name", "id"], "rank").select("id", "type", F.col("rank").cast("bigint").alias("rank"))


@query("""WITH b AS (SELECT least(9, floor(n_chars / 1000))::INTEGER AS bin, quality FROM documents JOIN labels USING (doc_id)), h AS (SELECT bin, count_if(quality = 1) AS pos, count_if(quality = 0) AS neg FROM b GROUP BY bin),
c AS (SELECT bin, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS all_pos FROM h WINDOW w AS (ORDER BY bin DESC)) SELECT bin, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / (all_pos + fp), 6) AS iou, round(tp / (tp + fp), 6) AS precision FROM c""")
def win13_threshold_sweep(spark, d):
    binned = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select(F.least(F.lit(9), F.floor(F.col("n_chars") / 1000)).cast("int").alias("bin"), "quality")
    hist = binned.groupBy("bin").agg(F.count_if(F.col("quality") == 1).alias("pos"), F.count_if(F.col("quality") == 0).alias("neg"))
    down = Window.orderBy(F.desc("bin"))  # ten rows: one for each bin of the histogram
    c = hist.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "all_pos": F.sum("pos").over(Window.partitionBy())})
    return c.select("bin", "tp", "fp", F.round(F.col("tp") / (F.col("all_pos") + F.col("fp")), 6).alias("iou"), F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"))


@query(f"""WITH {ALL_EDGES}, c AS (SELECT u, v, k, sum(length) OVER (PARTITION BY u ORDER BY v, k ROWS UNBOUNDED PRECEDING) AS along FROM all_edges) SELECT u, v, k, coalesce(lead(along) OVER (PARTITION BY u ORDER BY v, k) - along < 120, false) AS absorbed FROM c""")
def win14_absorbed_turns(spark, d):
    c = sequences.cumulative(all_edges(spark, d), ["u"], ["v", "k"], "length", "along")
    return c.select("u", "v", "k", F.coalesce(F.lead("along").over(Window.partitionBy("u").orderBy("v", "k")) - F.col("along") < 120, F.lit(False)).alias("absorbed"))


@query(f"""WITH {READINGS}, c AS (SELECT id, (id % 500)::DOUBLE AS mid, greatest(8.0::DOUBLE, least(30.0::DOUBLE, id % 50 + 4.0)) AS len FROM readings) SELECT id, greatest(0.0::DOUBLE, least(mid - len / 2, 500 - len)) AS start, least(500.0::DOUBLE, greatest(mid - len / 2, 0) + len) AS "end" FROM c""")
def win15_clip_windows(spark, d):
    mid, length = (F.col("id") % 500).cast("double"), F.greatest(F.lit(8.0), F.least(F.lit(30.0), F.col("id") % 50 + 4.0))
    return readings(spark, d).select("id", F.greatest(F.lit(0.0), F.least(mid - length / 2, 500 - length)).alias("start"), F.least(F.lit(500.0), F.greatest(mid - length / 2, F.lit(0.0)) + length).alias("end"))


@query(f"""WITH {PLACES} SELECT id, name, importance * 1 + scenery * 2 + CASE type WHEN 'PROMO' THEN 50 ELSE 0 END AS score FROM places ORDER BY score DESC, id LIMIT 20""")
def top01_importance(spark, d):
    score = routing.importance(F.col("importance"), F.col("scenery"), F.when(F.col("type") == "PROMO", 50).otherwise(0))
    return places(spark, d).select("id", "name", score.alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query(f"""WITH {PLACES}, c AS (SELECT * FROM places WHERE contains(name, 'bolt') ORDER BY importance DESC, id LIMIT 50) SELECT id, name, type FROM c WHERE type = 'PROMO' AND scenery >= 10""")
def top02_limit_before_filter(spark, d):
    return places(spark, d).filter(F.col("name").contains("bolt")).orderBy(F.desc("importance"), "id").limit(50).filter("type = 'PROMO' and scenery >= 10").select("id", "name", "type")


@query(f"""WITH {PLACES}, s AS (SELECT subcategory, id, importance / 1000 AS score FROM places WHERE importance / 1000 >= 0.5), m AS (SELECT *, max(score) OVER (PARTITION BY subcategory) AS top FROM s) SELECT subcategory, id, round(score, 6) AS score, count(*) OVER (PARTITION BY subcategory) > 1 AS ambiguous FROM m WHERE score >= top - 0.005""")
def top03_ambiguity(spark, d):
    w = Window.partitionBy("subcategory")
    s = places(spark, d).select("subcategory", "id", (F.col("importance") / 1000).alias("score")).filter("score >= 0.5").withColumn("top", F.max("score").over(w)).filter(F.col("score") >= F.col("top") - 0.005)
    return s.select("subcategory", "id", F.round("score", 6).alias("score"), (F.count(F.lit(1)).over(w) > 1).alias("ambiguous"))


@query(f"""WITH {PLACES}, q AS (SELECT unnest(['red', 'ring', 'small g', 'late']) AS asked), m AS (SELECT asked, name, CASE WHEN starts_with(name, asked) THEN 0 ELSE 1 END AS tier FROM q JOIN (SELECT DISTINCT name FROM places) ON contains(name, asked)), r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY tier, length(name), name) AS n FROM m) SELECT asked, name FROM r WHERE n = 1""")
def top04_tiered_match(spark, d):
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, ("red", "ring", "small g", "late")))).alias("asked"))
    hits = places(spark, d).select("name").distinct().join(F.broadcast(asked), F.col("name").contains(F.col("asked")))
    tier = F.when(F.col("name").startswith(F.col("asked")), 0).otherwise(1)
    return hits.groupBy("asked").agg(F.min(F.struct(tier.alias("t"), F.length("name").alias("l"), "name")).alias("b")).select("asked", "b.name")


@query("""WITH c AS (SELECT unnest([{'card': 'a', 'words': ['the', 'ing']}, {'card': 'b', 'words': ['ment', 'eau', 'ion']}, {'card': 'c', 'words': ['sch', 'ung']}]) AS c), h AS (SELECT conv_id, turn, c.card AS card, len(list_filter(c.words, lambda w: contains(text, w))) AS hits FROM conversations, c), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY hits DESC, card) AS n FROM h WHERE hits > 0) SELECT conv_id, turn, card, hits FROM r WHERE n <= 2""")
def top05_cards(spark, d):
    cards = {"a": ["the", "ing"], "b": ["ment", "eau", "ion"], "c": ["sch", "ung"]}
    hits = F.array(*[F.struct(F.lit(k).alias("card"), sum((F.col("text").contains(w).cast("bigint") for w in words), F.lit(0).cast("bigint")).alias("hits")) for k, words in cards.items()])
    found = F.filter(hits, lambda x: x["hits"] > 0)
    ordered = F.slice(F.array_sort(found, lambda a, b: F.when(a["hits"] != b["hits"], F.sign(b["hits"] - a["hits"]).cast("int")).when(a["card"] < b["card"], -1).otherwise(1)), 1, 2)
    return read(spark, d, "conversations").select("conv_id", "turn", F.explode(ordered).alias("c")).select("conv_id", "turn", "c.card", "c.hits")


@query(f"""WITH {EDGES}, direct AS (SELECT u, v, length FROM edges), via AS (SELECT a.u, b.v, a.v AS via, a.length + b.length AS length FROM edges a JOIN edges b ON a.v = b.u AND a.u <> b.v), r AS (SELECT via.u, via.v, via.via, via.length / direct.length AS ratio FROM via JOIN direct USING (u, v)), n AS (SELECT *, row_number() OVER (PARTITION BY u, v, ratio <= 1.5 ORDER BY ratio, via) AS n FROM r) SELECT u, v, via, round(ratio, 6) AS ratio, ratio <= 1.5 AS on_the_way FROM n WHERE ratio > 1.5 OR n <= 3""")
def top06_on_the_way(spark, d):
    """Ways of two edges against the edge between their ends: all long ones, and the three best of the others. Only these are ranked."""
    ratio = (F.col("first") + F.col("second")) / F.col("length")
    r = graph.closed_ways(graph.settle(edges(spark, d))).select("u", "v", "via", ratio.alias("ratio")).withColumn("on_the_way", F.col("ratio") <= 1.5)
    ranked = F.coalesce("on_the_way", F.lit(True))
    best = sequences.numbered(r.filter(ranked), ["u", "v", "on_the_way"], ["ratio", "via"], "n").filter("n <= 3").drop("n")
    both = r.filter(~ranked).unionByName(best)
    return both.select("u", "v", "via", F.round("ratio", 6).alias("ratio"), "on_the_way")


@query(f"""WITH {PLACES}, o AS (SELECT id, type, row_number() OVER (PARTITION BY subcategory ORDER BY CASE type WHEN 'PROMO' THEN 0 WHEN 'LARGE' THEN 1 ELSE 2 END, name, id) AS n, subcategory FROM places) SELECT id, lower(replace(subcategory, '#', '')) || '-' || lpad(n::VARCHAR, 3, '0') AS code FROM o""")
def top07_renumbered(spark, d):
    order = F.when(F.col("type") == "PROMO", 0).when(F.col("type") == "LARGE", 1).otherwise(2)
    n = sequences.numbered(places(spark, d), ["subcategory"], [order, "name", "id"], "n")
    return n.select("id", F.concat(F.lower(F.replace("subcategory", F.lit("#"), F.lit(""))), F.lit("-"), F.lpad(F.col("n").cast("string"), 3, "0")).alias("code"))


@query(f"""WITH {RUNS} SELECT run_id, status FROM runs WHERE run_id > 700 ORDER BY run_id LIMIT 50""")
def top08_keyset_page(spark, d):
    return runs(spark, d).filter("run_id > 700").orderBy("run_id").limit(50).select("run_id", "status")


@query(f"""WITH {RUNS} SELECT run_id, created FROM runs WHERE status = 'failed' ORDER BY created DESC, run_id LIMIT 200""")
def top09_bounded_listing(spark, d):
    return runs(spark, d).filter("status = 'failed'").orderBy(F.desc("created"), "run_id").limit(200).select("run_id", "created")


@query(f"""WITH {PLACES}, b AS (SELECT id, 0 AS branch, importance FROM places WHERE type = 'PROMO' UNION ALL SELECT id, 1, importance FROM places WHERE contains(name, 'ring') UNION ALL SELECT id, 2, importance FROM places WHERE scenery >= 40), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY branch, importance) AS n FROM b) SELECT id, branch, importance FROM r WHERE n = 1""")
def set01_stable_union(spark, d):
    """Three searches in order; a place that several find stays with the first."""
    p = places(spark, d).select("id", "importance", "type", "name", "scenery")
    found = [p.filter(c).select("id", "importance") for c in ("type = 'PROMO'", "contains(name, 'ring')", "scenery >= 40")]
    return sequences.stable_union(found, ["id"], "importance").select("id", "branch", "importance")


@query("""SELECT p_name AS name, arg_min(p_type, p_partkey) AS first, count(DISTINCT p_type)::INTEGER AS distinct_types FROM part GROUP BY p_name""")
def set02_ordered_distinct(spark, d):
    return read(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min_by("p_type", "p_partkey").alias("first"), F.count_distinct("p_type").cast("int").alias("distinct_types"))


@query(f"""WITH {PLACES} (SELECT name, subcategory, 'missing' AS side FROM places WHERE id < 800 EXCEPT SELECT name, subcategory, 'missing' FROM places WHERE id >= 800) UNION ALL (SELECT name, subcategory, 'stale' FROM places WHERE id >= 800 EXCEPT SELECT name, subcategory, 'stale' FROM places WHERE id < 800)""")
def set03_differences(spark, d):
    p = places(spark, d)
    a, b = (p.filter(c).select("name", "subcategory") for c in ("id < 800", "id >= 800"))
    return a.subtract(b).withColumn("side", F.lit("missing")).unionByName(b.subtract(a).withColumn("side", F.lit("stale")))


@query("""WITH o AS (SELECT l_orderkey AS o, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY l_orderkey) SELECT a.o AS a, b.o AS b, round(len(list_intersect(a.s, b.s))::DOUBLE / greatest(len(a.s), len(b.s)), 6) AS overlap FROM o a JOIN o b ON b.o = a.o + 1""")
def set04_overlap_rate(spark, d):
    o = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("a")).agg(F.collect_set("l_suppkey").alias("s"))
    n = o.select((F.col("a") - 1).alias("a"), F.col("s").alias("t"))
    return o.join(n, "a").select("a", (F.col("a") + 1).alias("b"), F.round(F.size(F.array_intersect("s", "t")) / F.greatest(F.size("s"), F.size("t")), 6).alias("overlap"))


@query("""WITH s AS (SELECT p_name AS name, CASE WHEN p_partkey % 10 < 7 THEN 'train' WHEN p_partkey % 10 < 9 THEN 'validation' ELSE 'test' END AS split FROM part) SELECT name, count(DISTINCT split) AS splits FROM s GROUP BY name HAVING count(DISTINCT split) > 1""")
def set05_leaks_between_splits(spark, d):
    k = F.col("p_partkey") % 10
    s = read(spark, d, "part").select(F.col("p_name").alias("name"), F.when(k < 7, "train").when(k < 9, "validation").otherwise("test").alias("split"))
    return s.groupBy("name").agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


@query("""WITH h AS (SELECT doc_id, sha256(text) AS digest FROM documents) SELECT h.doc_id, g.n AS copies, g.first FROM h JOIN (SELECT digest, count(*) AS n, min(doc_id) AS first FROM h GROUP BY digest HAVING count(*) > 1) g USING (digest)""")
def set06_content_duplicates(spark, d):
    h = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    g = h.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1")
    return h.join(g, "digest").select("doc_id", "copies", "first")


@query(f"""WITH {PLACES} SELECT name, floor(lng / 0.01)::BIGINT AS cx, floor(lat / 0.01)::BIGINT AS cy, count(*) AS merged, array_to_string(list_sort(list(id::BIGINT)), ',') AS rows FROM places GROUP BY ALL HAVING count(*) > 1""")
def set07_merged_sources(spark, d):
    cell = lambda c: F.floor(F.col(c) / 0.01)
    return places(spark, d).groupBy("name", cell("lng").alias("cx"), cell("lat").alias("cy")).agg(F.count(F.lit(1)).alias("merged"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("rows")).filter("merged > 1")


@query(f"""WITH {PLACES} SELECT id FROM places p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p.id AND l_quantity > 48)""")
def set08_exclusion(spark, d):
    gone = read(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("id")).distinct()
    return places(spark, d).select("id").join(gone, "id", "left_anti")


@query(f"""WITH {PLACES}, {NODES}, a AS (SELECT p.id, min(sqrt(pow((n.lng - p.lng) * cos(radians(p.lat)) * 111320, 2) + pow((n.lat - p.lat) * 111320, 2))) AS m FROM places p, nodes n GROUP BY p.id), b AS (SELECT p.id, min(sqrt(pow((n.lng - p.lng) * cos(radians(p.lat)) * 111320, 2) + pow((n.lat - p.lat) * 111320, 2))) AS m FROM places p, nodes n WHERE n.node % 4 > 0 GROUP BY p.id) SELECT id, round(a.m, 3) AS before, round(b.m, 3) AS after FROM a JOIN b USING (id) WHERE a.m <= 200 AND b.m > 200""")
def set09_regressions(spark, d):
    from pathloom.plans.base import nodes

    p, n = places(spark, d), nodes(spark, d)
    snap = lambda targets, name: spatial.nearest(p, "id", targets, "node", 400.0).select("id", F.col("distance").alias(name))
    both = snap(n, "before").join(snap(n.filter("node % 4 > 0"), "after"), "id")
    return both.filter("before <= 200 and after > 200").select("id", F.round("before", 3).alias("before"), F.round("after", 3).alias("after"))
