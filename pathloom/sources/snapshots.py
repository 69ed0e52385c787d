"""Snapshots that are replaced as a whole, and reread when they have been.

Each version lies in a folder of its own. A manifest names the current one; it is written beside
itself and switched by one rename, after the version's rows are complete. A writer that fails
before leaves the manifest, and with it the rows that readers see, as they were. One writer at a
time: of two at once the later rename counts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


class Snapshot:
    """The snapshot under a path that driver and executors share; keep is how many versions stay, for readers that are still on one."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), max(1, keep)
        self._seen: tuple[int, DataFrame] | None = None

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    @property
    def _conf(self):
        return self.spark._jsparkSession.sessionState().newHadoopConf()

    def manifest(self) -> dict:
        """version, folder and schema of the current version, and the folders kept before it; version 0 before the first write."""
        fs = self._at(MANIFEST).getFileSystem(self._conf)
        if not fs.exists(self._at(MANIFEST)):
            return {"version": 0, "folders": []}
        read = fs.open(self._at(MANIFEST))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(read, "UTF-8"))
        finally:
            read.close()

    def write(self, df: DataFrame) -> int:
        """Make df the current version; returns its number."""
        now = self.manifest()
        folder = f"v{now['version'] + 1}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        folders = [folder, *now["folders"]]
        self._switch({"version": now["version"] + 1, "folders": folders[: self.keep], "schema": df.schema.json()})
        fs = self._at(MANIFEST).getFileSystem(self._conf)
        for old in folders[self.keep :]:
            fs.delete(self._at(old), True)
        return now["version"] + 1

    def _switch(self, manifest: dict) -> None:
        jvm = self.spark._jvm
        fresh = self._at(f"{MANIFEST}.{uuid.uuid4().hex}")
        out = fresh.getFileSystem(self._conf).create(fresh, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self._conf).rename(fresh, self._at(MANIFEST), overwrite)

    def read(self) -> DataFrame:
        """The current version: the same frame as before while there is no newer one."""
        from pyspark.sql.types import StructType

        now = self.manifest()
        if not now["version"]:
            raise FileNotFoundError(f"no snapshot under {self.path}")
        if self._seen is None or self._seen[0] != now["version"]:
            schema = StructType.fromJson(json.loads(now["schema"]))
            self._seen = now["version"], self.spark.read.schema(schema).parquet(f"{self.path}/{now['folders'][0]}")
        return self._seen[1]
