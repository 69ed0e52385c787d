"""From raw documents to token digests: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next one's docs. All but the last return the columns of documents. Tables other than documents
are read from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.functions.session import ship
from pathloom.llm import bpe, exact_dedup, mixing, near_dup, quality
from pathloom.llm.common import materialize, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive quality classifier accepts."""
    return quality.keep_documents(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id."""
    return exact_dedup.keep_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by shingle similarity, the one with the smallest id."""
    return near_dup.keep_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's queue serves it, in the order of service."""
    return mixing.mix_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of each document."""
    ship(spark)
    return bpe.digests(docs)


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)


#: The first and the last stage cannot be stated in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None
