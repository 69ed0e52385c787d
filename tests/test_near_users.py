"""Users whose ids are near share a group of the matching stream, each with its own progress and state."""

from pathloom.streaming import matching, runs

FIXES = "user long, id long, seconds double, route long, x double, y double"


def test_users_of_a_group_keep_their_own_progress_over_batches(spark, tmp_path):
    pieces = spark.createDataFrame([(r, 0, 0.0, 0.0, 1000.0, 0.0, 0.0) for r in range(3)], "route long, piece int, x1 double, y1 double, x2 double, y2 double, before double")
    cells = matching.route_cells(pieces)
    users = [*range(-3, 70), 2**40]
    for k in range(2):
        fixes = [(u, 10 * i + 2 * k + j, float(4 * k + 2 * j), i % 3, 5.0 * i + 100.0 * (2 * k - j), 3.0) for i, u in enumerate(users) for j in (0, 1)]
        spark.createDataFrame(fixes, FIXES).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
        stream = spark.readStream.schema(FIXES).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        matched = matching.match(stream, cells)
        found = runs.run_available(matched, f"{tmp_path}/out", f"{tmp_path}/check", 120)
    got = {(r["user"], r["id"] % 10): r["furthest"] for r in found.collect()}
    want = {(u, n): max(max(0.0, 5.0 * i + 100.0 * (2 * (m // 2) - m % 2)) for m in range(n + 1)) for i, u in enumerate(users) for n in range(4)}
    assert got == want
    assert "TransformWithState" not in matched._jdf.queryExecution().logical().toString()
