import datetime
import json

import pytest
from pyspark.sql import functions as F

from pathloom.sources import files
from pathloom.streaming import tracks


def test_catalogue_fills_absent_keys_only(spark, tmp_path):
    doc = {"pois": [{"id": "1", "name": "a", "by": None}, {"id": "2"}], "provenance_defaults": {"by": "survey", "name": "unnamed"}}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    rows = files.read_catalogue(spark, str(tmp_path / "p.json"), "pois", "provenance_defaults", ["id", "name", "by"]).collect()
    assert sorted(map(tuple, rows)) == [("1", "a", None), ("2", "unnamed", "survey")]


def test_geojson_and_graphml(spark, tmp_path):
    shape = {"type": "FeatureCollection", "features": [{"id": "x", "geometry": {"type": "Point", "coordinates": [1.5, 2]}, "properties": {"n": "p"}}]}
    (tmp_path / "g.json").write_text(json.dumps(shape))
    (row,) = files.read_geojson(spark, str(tmp_path / "g.json")).collect()
    assert (row["id"], row["kind"], json.loads(row["coordinates"]), row["properties"]) == ("x", "Point", [1.5, 2], {"n": "p"})
    (tmp_path / "n.graphml").write_text('<graphml><graph><node id="1"><data key="x">2.5</data></node><node id="2"/><edge source="1" target="2"><data key="len">9</data><data key="name">r</data></edge></graph></graphml>')
    nodes, edges = files.read_graphml(spark, str(tmp_path / "n.graphml"))
    assert sorted((r["node"], r["attributes"]) for r in nodes.collect()) == [(1, {"x": "2.5"}), (2, {})]
    assert [tuple(r) for r in edges.collect()] == [(1, 2, {"len": "9", "name": "r"})]


def test_strict_and_lenient_snapshots_and_writers(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"id": 1}, {"id": "bad"}]')
    schema = "id int"
    assert [r["id"] for r in files.read_snapshot(spark, str(tmp_path / "s.json"), schema, strict=False).collect()] == []
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        files.read_snapshot(spark, str(tmp_path / "s.json"), schema, strict=True).collect()
    frames = [spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2, 0.5)], "a int, c double")]
    files.write_csv_union(frames, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv"), "a int, b string, c double").collect()
    assert sorted(map(tuple, back)) == [(1, "x", None), (2, None, 0.5)]
    files.write_snapshot(frames[0], str(tmp_path / "snap"))
    files.write_snapshot(frames[0].limit(0), str(tmp_path / "snap"))
    assert spark.read.schema("a int, b string").json(str(tmp_path / "snap")).count() == 0
    made = files.generate_queries(spark, 100, ["to {}", "via {}"], ["walk", "bike"])
    assert sorted(map(tuple, made.repartition(7).collect())) == sorted(map(tuple, made.collect()))


@pytest.fixture
def stream(spark, tmp_path):
    """Runs batches of rows through a streaming operator, one file a batch."""

    def run(schema, batches, operator):
        source = tmp_path / "in"
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"b{k}"))
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(source / "b*"))
        name = f"out_{tmp_path.name.replace('-', '_')}"
        query = operator(read).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return [tuple(r) for r in spark.table(name).collect()]

    return run


def test_off_route_needs_two_fixes_and_a_pause(stream):
    rows = [(1, 0.0, 30.0, 5.0), (1, 1.0, 30.0, 500.0), (1, 2.0, 40.0, 5.0), (1, 3.0, 50.0, 5.0), (1, 4.0, 50.0, 5.0), (1, 40.0, 50.0, 5.0), (2, 0.0, 30.0, 5.0), (2, 1.0, 3.0, 5.0), (2, 2.0, 30.0, 5.0)]
    found = stream("user long, seconds double, cross double, accuracy double", [rows], tracks.off_route)
    assert {(u, s) for u, s, _, call in found if call} == {(1, 2.0), (1, 40.0)} and len(found) == len(rows)


def test_arrivals_are_told_once(stream):
    found = stream("user long, seconds double, left double", [[(1, 0.0, 90.0), (1, 1.0, 50.0), (1, 2.0, 55.0), (1, 3.0, 9.0), (1, 4.0, 3.0), (2, 0.0, 1.0)]], tracks.arrivals)
    assert sorted(found) == [(1, 1.0, "near"), (1, 3.0, "arrived"), (2, 0.0, "arrived"), (2, 0.0, "near")]


def test_headings_take_the_shorter_arc(stream):
    found = stream("user long, seconds double, heading double", [[(1, 0.0, 350.0), (1, 1.0, 10.0), (1, 2.0, 0.0)]], tracks.smooth_headings)
    assert [h for *_, h in sorted(found)] == [350.0, 0.0, 0.0]


def minutes(*values):
    return [datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=v) for v in values]


def test_sessions_end_with_a_gap(stream):
    first = [(1, t) for t in minutes(0, 20, 45)] + [(2, t) for t in minutes(0)] + [(1, t) for t in minutes(90)]
    found = stream("user long, ts timestamp", [first, [(9, t) for t in minutes(3000)], [(9, t) for t in minutes(6000)]], tracks.sessions)
    assert sorted(r for r in found if r[0] < 9) == [(1, *minutes(0, 75), 3), (1, *minutes(90, 120), 1), (2, *minutes(0, 30), 1)]


def test_segments_are_summed_by_kind(stream):
    rows = [(minutes(0)[0], "car", 1.0), (minutes(0.5)[0], "car", 2.0), (minutes(0.5)[0], "bus", 4.0), (minutes(0.7)[0], "car", 8.0)]
    later = [[(minutes(m)[0], "end", 0.0)] for m in (3000, 6000)]
    found = stream("ts timestamp, kind string, value double", [rows, *later], tracks.segments)
    assert sorted(r for r in found if r[1] != "end") == sorted([(*minutes(0), "car", 2, 3.0), (*minutes(0), "bus", 1, 4.0), (*minutes(0.6), "car", 1, 8.0)])


def test_keys_are_taken_once(stream):
    (at,) = minutes(0)
    found = stream("key string, ts timestamp, n int", [[("a", at, 1), ("b", at, 1)], [("a", at, 2), ("c", at, 2)]], tracks.ingest_once)
    assert sorted(r[0] for r in found) == ["a", "b", "c"] and sorted(r[2] for r in found) == [1, 1, 2]


def test_log_has_each_row_once_after_a_restart(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(k, "x")], "id long, note string").write.mode("append").parquet(str(tmp_path / "in"))
        read = spark.readStream.schema("id long, note string").parquet(str(tmp_path / "in"))
        tracks.append_log(read, str(tmp_path / "log"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(map(tuple, spark.read.schema("id long, note string").json(str(tmp_path / "log")).collect())) == [(0, "x"), (1, "x")]


def test_edges_and_summaries_are_written(spark, tmp_path):
    rows = [(1, 2, 0, 10.04, "steps", "a,b"), (2, 1, 1, 0.25, "footway", None)]
    edges = spark.createDataFrame(rows, "u long, v long, k int, length double, highway string, road string").withColumn("slope", F.lit(1))
    schema = "u long, v long, k int, length double, highway string, road string"
    want = sorted([(1, 2, 0, 10.0, "steps", "a,b"), (2, 1, 1, 0.3, "footway", None)])
    files.write_edges(edges, str(tmp_path / "csv"))
    files.write_edges(edges, str(tmp_path / "json"), "json")
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "csv"), schema).collect())) == want
    assert sorted(map(tuple, spark.read.schema(schema).json(str(tmp_path / "json")).collect())) == want
    files.write_with_summary(edges.select("u", "length"), str(tmp_path / "s"), F.count("u").alias("n"), F.round(F.sum("length"), 2).alias("metres"))
    assert spark.read.json(str(tmp_path / "s/summary")).select("n", "metres").first() == (2, 10.29)
    assert files.read_csv(spark, str(tmp_path / "s/rows"), "u long, length double").count() == 2
