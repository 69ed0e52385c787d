"""Substring deduplication against a log-structured fingerprint index.

A window is a run of WINDOW words. Its anchor is the smallest hash among the shorter word grams in
it, so equal windows have equal anchors, and neighbouring windows mostly share one. The index has
two levels, both made of immutable runs, tables bucketed and sorted by key that a later session opens again
by the index's name:

* anchors: every anchor seen, with the first document that held it;
* windows: for each anchor that more than one document has held, the 128-bit hashes of the words of
  all windows with that anchor, each with the first document it starts in.

A batch is reduced to its own anchors, which are merge-joined with the anchor runs. Only documents
with a shared anchor are hashed window by window: those of the batch, and the earlier holder of an
anchor that has just become shared. The window hashes are merge-joined with the window runs, which
verifies the candidates; a window whose first document has a smaller id is removed. What is new in
the batch becomes a new run, and runs are compacted into one when there are too many. Keys are
unique in every run, so a passage in a third of all documents is one row of it.

Batches must arrive in order of id; what a batch only passes through is deleted when it has been read.
Of texts with equal words, told by SHA-256, only the first is indexed. Defined results: a null text has no words; documents shorter
than a window lose nothing; a null id neither removes nor loses words; rows that repeat an id are
separate texts, none of them earlier than the other; an empty batch adds nothing; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import discard, materialize, shuffle_partitions, table, word_hashes

WINDOW = 50
#: Words of the grams that anchors are chosen from: WINDOW - GRAM + 1 grams in a window.
GRAM = 25
#: Runs of a level before they are compacted.
MAX_RUNS = 2
#: Rows that a worker sends on at a time.
SEND = 100_000

_u = np.uint64
_BASE = 0x9E3779B97F4A7C15
_hash = xxhash.xxh3_64_intdigest


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def rolling(each: np.ndarray, width: int, base: int) -> np.ndarray:
    """A 64-bit hash of every run of so many word hashes, from prefix sums of a polynomial."""
    n = len(each)
    powers = np.full(n + 1, base, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(n, pow(base, -1, 2**64), np.uint64)
    inverse[:1] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each * powers[:n], dtype=np.uint64)])
    out = (sums[width:] - sums[:-width]) * np.multiply.accumulate(inverse)[: n - width + 1]
    out = (out ^ (out >> _u(32))) * _u(0x94D049BB133111EB)
    return out ^ (out >> _u(29))


def anchors(each: np.ndarray) -> np.ndarray:
    """The anchor of every window, in order."""
    if len(each) < WINDOW:
        return np.zeros(0, np.uint64)
    grams = rolling(each, GRAM, _BASE)
    return np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1).min(axis=1)


def joined_sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the word sequence), n_words, all_sha256, anchors of each document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, shas, found = [], [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                line = b" ".join(words)
                keys.append(_hash(line) - 2**63)
                counts.append(len(words))
                shas.append(hashlib.sha256(line).hexdigest())
                found.append(np.unique(anchors(word_hashes(words))).view(np.int64) if len(words) >= WINDOW else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "key", "n_words", "all_sha256", "anchors"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id bigint, key bigint, n_words bigint, all_sha256 string, anchors array<bigint>")


def window_hashes(words: list[bytes], place: np.ndarray) -> np.ndarray:
    """The 128-bit hash of the words of each window, as two integers."""
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    found = b"".join(xxhash.xxh3_128_digest(line[a:b]) for a, b in zip(starts[place].tolist(), ends[place + WINDOW - 1].tolist()))
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def windows(texts: DataFrame) -> DataFrame:
    """h1, h2, doc_id, key, place: the windows whose anchors are among the row's list."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "doc_id", "key", "place"])

        for batch in batches:
            for doc_id, key, text, wanted in zip(*(batch.column(c) for c in ("doc_id", "key", "text", "wanted"))):
                words = words_of(text.as_py())
                if len(words) < WINDOW:
                    continue
                place = np.flatnonzero(np.isin(anchors(word_hashes(words)).view(np.int64), np.array(wanted.as_py(), np.int64)))
                h1, h2 = window_hashes(words, place).T
                n = len(place)
                held.append((h1, h2, np.full(n, doc_id.as_py(), np.int64), np.full(n, key.as_py(), np.int64), place.astype(np.int32)))
                size += n
                if size >= SEND:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return texts.select("doc_id", "key", "text", "wanted").mapInArrow(cut, "h1 bigint, h2 bigint, doc_id bigint, key bigint, place int")


def removed(texts: DataFrame) -> DataFrame:
    """doc_id, key, n_removed, kept_sha256 of documents with places of windows to remove."""

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas = [], []
            for text, places in zip(batch.column("text"), batch.column("places")):
                words = words_of(text.as_py())
                steps = np.zeros(len(words) + WINDOW + 1, np.int64)
                at = np.unique(np.array(places.as_py(), np.int64))
                steps[at] += 1
                steps[at + WINDOW] -= 1
                gone = np.cumsum(steps)[: len(words)] > 0
                counts.append(int(gone.sum()))
                shas.append(joined_sha([w for w, g in zip(words, gone.tolist()) if not g]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(counts, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "key", "n_removed", "kept_sha256"])

    return texts.select("doc_id", "key", "text", "places").mapInArrow(strike, "doc_id bigint, key bigint, n_removed bigint, kept_sha256 string")


class Level:
    """Immutable runs of unique keys, each a table bucketed by the key columns and sorted by them.

    Runs are numbered in their names; the runs there are under a name are found again in the catalog.
    """

    def __init__(self, spark: SparkSession, name: str, keys: list[str], values: list[str]):
        self.spark, self.name, self.keys, self.values = spark, name, keys, values
        self.buckets = max(16, shuffle_partitions(spark))
        self.runs = sorted(r["tableName"] for r in spark.sql(f"SHOW TABLES LIKE '{name}_*'").collect())

    def _write(self, rows: DataFrame) -> str:
        number = int(self.runs[-1].rpartition("_")[2]) + 1 if self.runs else 0
        run = f"{self.name}_{number:09d}"
        rows.repartition(self.buckets, *self.keys).write.format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(run)
        return run

    def lookup(self, rows: DataFrame) -> DataFrame:
        """rows with the values of their keys in the newest run that has them, else null. Keys must be unique in rows."""
        columns, newest_first = rows.columns, list(enumerate(self.runs))[::-1]
        for n, run in newest_first:
            found = self.spark.table(run).select(*self.keys, *[F.col(v).alias(f"{v}_{n}") for v in self.values])
            rows = rows.hint("merge").join(found, self.keys, "left")
        known = [F.coalesce(*[F.col(f"{v}_{n}") for n, _ in newest_first], F.lit(None)).cast("bigint").alias(v) for v in self.values]
        return rows.select(*columns, *known)

    def append(self, rows: DataFrame) -> None:
        self.runs.append(self._write(rows))
        if len(self.runs) > MAX_RUNS:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one; of rows with one key, that of the newest run stays.

        Until the old runs are gone the merged one, as the newest, answers first and says the same.
        """
        if len(self.runs) < 2:
            return
        runs = [self.spark.table(run).withColumn("run", F.lit(n)) for n, run in enumerate(self.runs)]
        merged = runs[0]
        for run in runs[1:]:
            merged = merged.unionByName(run)
        newest = merged.groupBy(self.keys).agg(*[F.max_by(v, "run").alias(v) for v in self.values])
        old, self.runs = self.runs, [self._write(newest)]
        for run in old:
            self.spark.sql(f"DROP TABLE {run}")


class FingerprintIndex:
    """name: of the index's tables; one that exists is opened, none makes an index of its own."""

    def __init__(self, spark: SparkSession, name: str | None = None):
        name = name or f"substrings_{uuid.uuid4().hex[:12]}"
        self.anchors = Level(spark, f"{name}_anchors", ["anchor"], ["first", "shared"])
        self.windows = Level(spark, f"{name}_windows", ["h1", "h2"], ["first"])

    def add(self, batch: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
        """Deduplicate a batch, then index it. earlier: the documents indexed before, for their texts.

        Returns one row for each document of the batch: doc_id, n_words, n_removed, kept_sha256.
        """
        if earlier is None and self.anchors.runs:
            raise ValueError("the index holds documents: their texts are needed to find what the batch shares with them")
        signed = materialize(signatures(batch), "signatures")
        # Of texts with equal words, only the first needs its windows indexed.
        long = signed.filter(f"doc_id is not null and n_words >= {WINDOW}")
        firsts = long.groupBy("all_sha256").agg(F.min("doc_id").alias("first"))
        marked = materialize(long.hint("merge").join(firsts, "all_sha256").select("doc_id", "key", "anchors", (F.col("first") < F.col("doc_id")).alias("copy")), "marked")
        slim = materialize(signed.drop("anchors"), "digests")
        discard(signed)
        held = marked.filter("not copy").select(F.explode("anchors").alias("anchor"), "doc_id", "key")

        own = held.groupBy("anchor").agg(F.min("doc_id").alias("own_first"), F.max("doc_id").alias("own_last"))
        looked = materialize(self.anchors.lookup(own), "looked-up")
        now_shared = (F.col("first").isNotNull() | (F.col("own_first") < F.col("own_last"))).cast("bigint")
        shared = looked.filter(now_shared == 1)
        # Runs are immutable: that an older anchor has become shared is told by a row in a later run.
        news = looked.filter("first is null or shared = 0").select("anchor", F.coalesce("first", "own_first").alias("first"), now_shared.alias("shared"))
        wanted = held.hint("merge").join(shared.select("anchor"), "anchor").groupBy("doc_id", "key").agg(F.collect_set("anchor").alias("wanted"))
        sources = materialize(self._texts(batch, wanted), "candidates")
        cut = materialize(windows(sources), "windows")

        firsts = cut.groupBy("h1", "h2").agg(F.min("doc_id").alias("own_first"))
        if earlier is not None:
            once = looked.filter("first is not null and shared = 0").select("anchor", F.col("first").alias("doc_id"))
            again = once.groupBy("doc_id").agg(F.collect_set("anchor").alias("wanted"))
            # An id that repeats may stand for several texts: all are cut, and only true holders match.
            older = earlier.select("doc_id", "text").hint("merge").join(again, "doc_id").withColumn("key", F.lit(0).cast("bigint"))
            history = windows(older).groupBy("h1", "h2").agg(F.min("doc_id").alias("own_first"))
            firsts = firsts.unionByName(history).groupBy("h1", "h2").agg(F.min("own_first").alias("own_first"))
        firsts = materialize(self.windows.lookup(firsts), "firsts")
        first = F.coalesce("first", "own_first").alias("first")
        self.windows.append(firsts.filter("first is null").select("h1", "h2", first))
        self.anchors.append(news)
        discard(looked)

        repeated = cut.hint("merge").join(firsts.select("h1", "h2", first), ["h1", "h2"]).filter("first < doc_id")
        places = materialize(repeated.groupBy("doc_id", "key").agg(F.collect_set("place").alias("places")), "places")
        discard(cut, firsts)
        struck = removed(sources.select("doc_id", "key", "text").hint("merge").join(places, ["doc_id", "key"])).dropDuplicates(["doc_id", "key"])
        struck = materialize(struck, "struck")
        copies = materialize(marked.filter("copy").select("doc_id", "key", F.lit(True).alias("copy")).distinct(), "copies")
        discard(places, sources, marked)
        result = slim.hint("merge").join(struck, ["doc_id", "key"], "left").join(copies.hint("merge"), ["doc_id", "key"], "left")
        return result.select(
            "doc_id",
            "n_words",
            F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(F.col("copy"), F.lit(joined_sha([]))).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
        )

    def _texts(self, batch: DataFrame, wanted: DataFrame) -> DataFrame:
        """Texts of the documents with shared anchors, each with its list of them."""
        ids = wanted.groupBy("doc_id").agg(F.flatten(F.collect_list("wanted")).alias("wanted"))

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = pa.array([_hash(b" ".join(words_of(t.as_py()))) - 2**63 for t in b.column("text")], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), keys, b.column("text"), b.column("wanted")], names=["doc_id", "key", "text", "wanted"])

        found = batch.select("doc_id", "text").hint("merge").join(ids, "doc_id")
        return found.select("doc_id", "text", "wanted").mapInArrow(key, "doc_id bigint, key bigint, text string, wanted array<bigint>")


def dedup(docs: DataFrame, index: FingerprintIndex | None = None) -> DataFrame:
    """The whole table as two batches, the smaller ids first."""
    index = index or FingerprintIndex(docs.sparkSession)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None or low == high:
        return index.add(docs)
    cut = (low + high) // 2 + 1
    older, newer = docs.filter((F.col("doc_id") < cut) | F.col("doc_id").isNull()), docs.filter(F.col("doc_id") >= cut)
    first = index.add(older)
    second = index.add(newer, older)
    index.anchors.compact()
    index.windows.compact()
    return first.unionByName(second)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op2_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT doc_id, i AS place, md5(array_to_string(words[i:i + 49], ' ')) AS win FROM w, unnest(range(1, len(words) - 48)) AS u(i)
), f AS (
  SELECT win, min(doc_id) AS first FROM g GROUP BY win
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(place, place + 50)) AS i FROM g JOIN f USING (win) WHERE first < doc_id
), gl AS (
  SELECT doc_id, list(i) AS struck FROM gone GROUP BY doc_id
), words AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(struck), 0)::BIGINT AS n_removed,
    CASE WHEN struck IS NULL THEN array_to_string(words, ' ') ELSE
      (SELECT coalesce(string_agg(words[i], ' ' ORDER BY i), '') FROM unnest(range(1, len(words) + 1)) AS u(i) WHERE NOT list_contains(struck, i)) END AS kept
  FROM w LEFT JOIN gl USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM words
"""
}
