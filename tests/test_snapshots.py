"""Versions of a snapshot: atomic, reread, kept and cleared."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pathloom.sources.snapshots import Snapshot


def ids(frame):
    return sorted(r["id"] for r in frame.collect())


def test_a_failed_writer_leaves_the_old_rows_and_readers_see_new_ones(spark, tmp_path):
    path = str(tmp_path / "conditions")
    writer, reader = Snapshot(spark, path), Snapshot(spark, path)
    with pytest.raises(FileNotFoundError):
        reader.read()
    assert writer.write(spark.range(5)) == 1 and ids(reader.read()) == [0, 1, 2, 3, 4]
    held = reader.read()
    assert reader.read() is held
    # Some tasks write their rows before one fails.
    broken = spark.range(0, 100, 1, 8).select(F.when(F.col("id") == 99, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        writer.write(broken)
    assert ids(reader.read()) == [0, 1, 2, 3, 4] and reader.read() is held
    assert writer.write(spark.range(2).withColumn("note", F.lit("x"))) == 2
    assert ids(reader.read()) == [0, 1] and reader.read().columns == ["id", "note"]
    # A reader that began on the version before still has its rows.
    assert ids(held) == [0, 1, 2, 3, 4]
    assert writer.write(reader.read().limit(0)) == 3 and ids(reader.read()) == []
    assert len(reader.manifest()["folders"]) == 2
    assert not [p for p in Path(path).glob("v1-*")] and not list(Path(path).glob("manifest.json.*"))
