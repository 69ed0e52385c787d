import uuid
from collections import defaultdict

from brute import LOWER, sha
from pyspark.sql import functions as F

from pathloom.llm import exact_dedup
from pathloom.llm.exact_dedup import DigestIndex, dedup, keep_documents

SCHEMA = "doc_id long, text string, digest string, kept int"
DOCS = [(3, "Aa"), (9, "aA"), (5, "aa"), (1, None), (2, ""), (4, "É"), (6, "é"), (7, "x" * 200_000), (8, "X" * 200_000), (10, " aa")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "c", 1) for i, t in rows], SCHEMA)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    return sorted((i, max(groups[n]), len(groups[n]), i == max(groups[n]), sha(n)) for i, t in rows for n in [(t or "").translate(LOWER)])


def test_against_brute_force(spark):
    result = dedup(frame(spark, DOCS))
    assert sorted(map(tuple, result.collect())) == brute(DOCS)
    plan = result._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_a_later_batch_is_kept_from_the_index(spark):
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex[:8]}")
    digested = lambda rows: frame(spark, rows).select("doc_id", exact_dedup.digest(F.col("text")).alias("digest"))
    assert index.add(digested([(1, "a"), (2, "A"), (3, "b")])).count() == 2
    fresh = index.add(digested([(4, "B"), (5, "c"), (6, None)])).select("keep_id").collect()
    assert sorted(r[0] for r in fresh) == [5, 6]
    before = sorted(map(tuple, index.read().collect()))
    index.compact()
    assert sorted(map(tuple, index.read().collect())) == before
    assert index.add(digested([])).count() == 0


def test_kept_rows_have_all_columns_and_repeated_rows_leave_one(spark):
    rows = [*DOCS, (9, "aA"), (None, "n"), (None, "N"), (None, "aa")]
    kept = keep_documents(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "digest", "kept"]
    found = [(r["doc_id"], (r["text"] or "").lower()) for r in kept.collect()]
    assert sorted(found, key=str) == sorted([(9, "aa"), (2, ""), (4, "É".lower()), (6, "é"), (8, "x" * 200_000), (10, " aa"), (None, "n")], key=str)


def test_empty_table(spark):
    assert dedup(frame(spark, [])).collect() == [] and keep_documents(frame(spark, [])).collect() == []
