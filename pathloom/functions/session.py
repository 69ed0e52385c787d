"""What a session needs before Python functions of this package can run in its tasks."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's workers, once: they may not have it on their path."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='pathloom-')}/package", "zip", PACKAGE.parent, PACKAGE.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark
