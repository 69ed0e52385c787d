"""Running a stream to the end of what is there, with its state and its rows written exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame

STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, path: str, checkpoint: str, timeout: int = 3600) -> DataFrame:
    """Process what the sources have now into Parquet files under path, and return all rows written so far.

    Called again with the same checkpoint, it goes on where the last run ended, also where that was
    cut short: the sink's log tells which batches are complete, and readers see those only.
    """
    spark = stream.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        if not query.awaitTermination(timeout):
            query.stop()
            raise TimeoutError(f"the stream did not end in {timeout} s")
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(stream.schema).parquet(path)
