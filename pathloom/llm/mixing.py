"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated up to a number of times
whatever its target. A copy is queued in parts of PART_WORDS words, as a queue of packets, so that a
long document does not hold up the others. A part's virtual finish time is the words of its source
up to and with it, divided by the source's target, so a source with a larger target is served
faster. All parts are sorted by finish time over all sources, and the mix ends where their words
add up to the total budget, the words of all documents. That one cut decides what each source
gives: at least its target less a part, and at most as many parts more as there are other sources.

Running totals are distributed. Within a source the shuffle order is cut into blocks by the leading
digits of its key; block totals are summed first, and windows run inside single blocks only. Over
all sources a range sort by finish time does the same with its partitions; only the partition in
which the budget ends needs a running total.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source of its
own, the last one; rows that repeat an id are queued by their texts, and rows that repeat both are
served one after the other; an empty table gives an empty mix; sources without words get target 0;
extra columns are carried by mix_documents and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.common import WORD, discard, fresh, materialize, shuffle_partitions, table

WEIGHT_CYCLE = (1, 2, 3)
MAX_REPEATS = 3
#: Words of a part, the unit of service; the last part of a document holds what is left.
PART_WORDS = 64
#: Hex digits of the shuffle key that name a block: 4,096 blocks for each source.
BLOCK_DIGITS = 3


def shuffle_key() -> Column:
    """Order within a source: a hash of id and text, so reruns agree and rows without ids are dealt as well."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and the shuffle key."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), shuffle_key().alias("key"))


def fill_targets(sources: DataFrame, cycle: tuple[int, ...], repeats: int) -> DataFrame:
    """source, source_size and target of each source.

    Shares by weight, each capped at repeats times the source's size, the excess reshared. With the
    sources in order of cap / weight, all before some source are capped and all from it on get
    budget-left / weight-left by weight; one pass of running sums finds it. One row per source
    goes through these windows, never documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    weights = F.array([F.lit(float(w)) for w in cycle])
    ranked = sources.withColumn("weight", F.element_at(weights, ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int")))
    capped = ranked.withColumn("cap", F.col("source_size").cast("double") * repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), F.encode("source", "utf-8"))
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = capped.withColumn("level", level)
    share = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(Window.partitionBy())["level"]
    return levels.select("source", "source_size", F.round(F.least(F.col("cap"), F.coalesce(F.col("weight") * share, F.lit(0.0))), 6).alias("target"))


def queue(docs: DataFrame, cycle: tuple[int, ...], repeats: int) -> DataFrame:
    """doc_id, source, key, size, source_size, target, before: the words of its source that are queued before each document.

    Documents without words are never served; their place is null.
    """
    rows = materialize(sized(docs).withColumn("block", F.substring("key", 1, BLOCK_DIGITS)), "sized")
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(blocks.withColumn("before_block", F.coalesce(F.sum("block_size").over(earlier), F.lit(0))), "blocks")
    sources = materialize(fill_targets(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size")), cycle, repeats), "sources")

    # Null sources meet by a key that is never null.
    keyed = lambda df: df.withColumns({"__none": F.col("source").isNull(), "__source": F.coalesce("source", F.lit(""))})
    starts = keyed(blocks).hint("merge").join(keyed(sources).drop("source"), ["__none", "__source"]).drop("source", "block_size")
    joined = keyed(rows.filter("size > 0")).hint("merge").join(starts, ["__none", "__source", "block"])
    inside = Window.partitionBy("__none", "__source", "block").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("before", F.col("before_block") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # One row for each source.
    silent = keyed(rows.filter("size = 0")).join(keyed(sources).drop("source"), ["__none", "__source"]).withColumn("before", F.lit(None).cast("long"))
    columns = ["doc_id", "source", "key", "size", "source_size", "target", "before"]
    queued = materialize(placed.select(columns).unionByName(silent.select(columns)), "queued")
    discard(rows, blocks, sources)
    return queued


def packets(queued: DataFrame, repeats: int, part_words: int = PART_WORDS) -> DataFrame:
    """source, before, turn, words, finish: each part of each copy of each document, whatever its source's target."""
    turns = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("turn")
    copies = queued.filter("size > 0 AND target > 0").select("source", "size", "source_size", "target", "before", turns)
    parts = copies.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(part_words).cast("long"))).alias("from"))
    words = F.least(F.lit(part_words).cast("long"), F.col("size") - F.col("from"))
    finish = (F.col("before") + F.col("turn") * F.col("source_size") + F.col("from") + words) / F.col("target")
    return parts.select("source", "before", "turn", words.alias("words"), finish.alias("finish"))


def served(docs: DataFrame, cycle: tuple[int, ...], repeats: int) -> tuple[DataFrame, DataFrame]:
    """The queue, and the parts in it that the budget covers, with taken: their words up to it."""
    queued = queue(docs, cycle, repeats)
    order = ["finish", F.col("source").isNull(), "source", "before", "turn"]
    ranged = packets(queued, repeats).repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "by-finish-time")
    # One row for each partition of the range sort.
    totals = ranged.groupBy("part").agg(F.sum("words").alias("total"))
    starts = totals.select("part", "total", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("earlier"))
    budget = F.lit(queued.agg(F.sum("size")).first()[0] or 0)
    whole = ranged.join(F.broadcast(starts.filter(F.col("earlier") + F.col("total") <= budget).select("part")), "part").withColumn("taken", F.col("words"))
    last = ranged.join(F.broadcast(starts.filter((F.col("earlier") < budget) & (F.col("earlier") + F.col("total") > budget)).select("part", "earlier")), "part")
    inside = F.sum("words").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    left = budget - F.col("earlier") - F.col("inside")
    cut = last.withColumn("inside", inside).withColumn("taken", F.greatest(F.lit(0), F.least(F.col("words"), left))).filter("taken > 0")
    return queued, whole.unionByName(cut.drop("inside", "earlier")).drop("part")


def serve(docs: DataFrame, cycle: tuple[int, ...] = WEIGHT_CYCLE, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    queued, taken = served(docs, cycle, repeats)
    # Within a source, no two documents with words start at one place.
    facts = ["doc_id", "size", "source_size", "target"]
    none = F.lit(0).cast("long").alias("taken")
    nulls = [F.lit(None).cast(queued.schema[c].dataType).alias(c) for c in facts]
    rows = queued.filter("size > 0").select("source", "before", *facts, none).unionByName(taken.select("source", "before", *nulls, "taken"))
    found = rows.groupBy("source", "before").agg(*[F.max(c).alias(c) for c in facts], F.sum("taken").alias("taken"))
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return found.select(columns).unionByName(queued.filter("size = 0").select(*columns[:-1], none))


def mix_documents(docs: DataFrame, cycle: tuple[int, ...] = WEIGHT_CYCLE, repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: each document as often as its queue served it, globally sorted by virtual finish time.

    A copy stands where its last part was served. One that was being served when the budget was
    spent holds only its served words, joined by spaces.
    """
    key, own, of, words, finish, size = fresh(docs, "key", "own", "of", "words", "finish", "size")
    queued, taken = served(docs, cycle, repeats)
    copies = taken.groupBy("source", "before", "turn").agg(F.sum("taken").alias(words), F.max("finish").alias(finish))
    copies = copies.withColumnRenamed("source", of).withColumnRenamed("before", own)
    places = queued.filter("size > 0").select("source", "key", "before", F.col("size").alias(size))
    meet = (F.col("source").eqNullSafe(F.col(of))) & (F.col("before") == F.col(own))
    copies = materialize(places.hint("merge").join(copies, meet).select(F.col("source").alias(of), F.col("key").alias(own), size, words, finish), "copies")
    texts = docs.withColumn(key, shuffle_key())
    if not queued.filter("size > 0").groupBy("source", "key").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates([key, "source"])  # equal rows are queued one by one, and need their text once
    joined = texts.hint("merge").join(copies, (F.col(key) == F.col(own)) & F.col("source").eqNullSafe(F.col(of)))
    text = F.when(F.col(words) >= F.col(size), F.col("text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), F.lit(1), F.col(words).cast("int")), " "))
    mixed = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.repartitionByRange(finish, "doc_id").sortWithinPartitions(finish, "doc_id").select(docs.columns)


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op7_fair_mix": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight, source_size::DOUBLE * 3 AS cap FROM s
), l AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size, round(least(cap, coalesce(weight * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio), 0.0)), 6) AS target FROM l
), q AS (
  SELECT d.doc_id, d.source, d.key, d.size, t.source_size, t.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), packets AS (
  SELECT source, before, turn, least(64, size - "from")::BIGINT AS words, (before + turn * source_size + "from" + least(64, size - "from")) / target AS finish
  FROM (SELECT *, unnest(range(0, size, 64)) AS "from" FROM q, (VALUES (0), (1), (2)) AS turns(turn) WHERE size > 0 AND target > 0)
), cut AS (
  SELECT source, before, greatest(0, least(words, (SELECT sum(size) FROM d)
    - (sum(words) OVER (ORDER BY finish, source IS NULL, source, before, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words))) AS taken
  FROM packets
), given AS (
  SELECT source, before, sum(taken)::BIGINT AS taken FROM cut GROUP BY source, before
)
SELECT q.doc_id, q.size, q.source_size, q.target, CASE WHEN q.size > 0 THEN coalesce(g.taken, 0) ELSE 0 END::BIGINT AS taken
FROM q LEFT JOIN given g ON q.source IS NOT DISTINCT FROM g.source AND q.before = g.before
"""
}
