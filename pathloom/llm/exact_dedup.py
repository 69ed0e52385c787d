"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is digested, reduced to one row per
digest, and kept from the index by a sort-merge anti-join that never shuffles the index; what is
new is appended in the same bucketing. Everything is built-in expressions: no Python touches a row.

Defined results: a null text counts as empty; texts are equal when identical after lower-casing
A-Z; of equal texts the row with the largest id stays, a null id losing to any other; rows that
repeat both id and text are told apart only by :func:`keep_documents`, which leaves one of them;
an empty batch appends nothing; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import ascii_lower, fresh, materialize, shuffle_partitions, table

INDEX_SCHEMA = "digest binary, keep_id bigint"


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the normalised text."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


class DigestIndex:
    """A persistent table of the digests seen so far, bucketed and sorted by digest.

    buckets: fixed when the table is made; at least the shuffle partitions, so that a batch is
    dealt out to the index's buckets and the index itself stays where it is.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name = spark, name
        self.buckets = buckets or max(16, shuffle_partitions(spark))
        if not spark.catalog.tableExists(name):
            self._write(spark.createDataFrame([], INDEX_SCHEMA))

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame) -> DataFrame:
        """Append what is new of batch (digest, doc_id); return the rows that were appended."""
        # Written first: the optimiser would otherwise move the anti-join below the aggregate,
        # and deal out every row of a large group instead of one for each task.
        firsts = materialize(batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "batch-digests")
        new = firsts.hint("merge").join(self.read().select("digest"), "digest", "left_anti")
        new = materialize(new.repartition(self.buckets, "digest"), "fresh-digests")
        self._write(new)
        return new

    def compact(self) -> None:
        """Rewrite as one sorted file per bucket, under a new table that then takes the name."""
        merged = f"{self.name}_{uuid.uuid4().hex[:8]}"
        self.read().repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(merged)
        self.spark.sql(f"DROP TABLE {self.name}")
        self.spark.sql(f"ALTER TABLE {merged} RENAME TO {self.name}")


def arrivals(digests: DataFrame) -> list[DataFrame]:
    """Two batches, the larger ids first: what is indexed earlier stays, as the largest id must."""
    low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None or low == high:
        return [digests]
    cut = (low + high) // 2 + 1
    return [digests.filter(F.col("doc_id") >= cut), digests.filter((F.col("doc_id") < cut) | F.col("doc_id").isNull())]


def dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The last join expands decisions to rows. A digest that holds a third of all rows makes one
    side of it skewed, the other side has each digest once: an equi-join that AQE splits.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    digests = materialize(docs.select("doc_id", digest(F.col("text")).alias("digest")), "digests")
    for batch in arrivals(digests):
        index.add(batch)
    sizes = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = materialize(sizes.hint("merge").join(index.read(), "digest"), "digest-groups")
    return digests.join(groups.hint("merge"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Kept (id, digest) pairs come from the index; only where such a pair repeats are whole rows
    compared, so that exactly one row of each group is left.
    """
    sha, kept_id, kept_sha, n = fresh(docs, "sha", "kept_id", "kept_sha", "n")
    decided = materialize(dedup(docs).filter("kept").groupBy("doc_id", "text_sha256").count(), "kept-digests")
    marked = docs.withColumn(sha, F.lower(F.hex(digest(F.col("text")))))
    keys = decided.select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha), F.col("count").alias(n))
    on = F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha))
    if decided.filter("count > 1").isEmpty():
        return marked.hint("merge").join(keys, on, "left_semi").drop(sha)
    kept = marked.hint("merge").join(keys, on)
    single = kept.filter(F.col(n) == 1).select(docs.columns)
    return single.unionByName(kept.filter(F.col(n) > 1).dropDuplicates([kept_id, sha]).select(docs.columns))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op8_exact_dedup": """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM t JOIN g USING (text_sha256)
"""
}
