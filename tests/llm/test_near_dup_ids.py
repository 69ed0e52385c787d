"""Rows that repeat an id, or have none, are texts of their own for near duplicates."""

import random
from collections import Counter

from brute import near_components, shingle_set
from test_near_dup import corpus

from pathloom.llm import near_dup

SCHEMA = "doc_id long, text string, row long"


def groups(docs):
    """Row numbers of each group; rows with an empty set are groups of one."""
    out = {}
    for row, _, first in near_components(list(enumerate(text for _, text in docs))):
        out.setdefault(first, []).append(row)
    return list(out.values())


def check(spark, docs):
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], SCHEMA).repartition(3)
    least = lambda group: min((docs[k][0] for k in group if docs[k][0] is not None), default=None)
    stated = Counter((docs[k][0], len(shingle_set(docs[k][1])), least(group)) for group in groups(docs) for k in group)
    assert Counter(map(tuple, near_dup.cluster(frame).collect())) == stated
    kept = near_dup.keep_documents(frame)
    assert kept.columns == ["doc_id", "text", "row"]
    kept = kept.collect()
    assert all(docs[r["row"]] == (r["doc_id"], r["text"]) for r in kept)
    rows = {r["row"] for r in kept}
    assert len(rows) == len(kept)
    for group in groups(docs):
        stay = [k for k in group if k in rows]
        assert len(stay) == 1 and docs[stay[0]][0] == least(group)


def test_one_id_for_texts_of_different_sizes_and_groups(spark):
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    check(spark, [(4, long), (4, "other words here"), (4, "one two three four five six"), (3, long + " end"), (4, "other  WORDS here"), (7, "one two three four five six"), (4, None), (4, "")])


def test_near_copies_without_ids(spark):
    long = " ".join(f"w{k}" for k in range(40))
    check(spark, [(None, long), (None, long + " end"), (None, "start " + long), (None, "x y z"), (None, "p q"), (None, None), (None, None), (5, "a b c")])


def test_many_repeated_and_null_ids(spark):
    rng = random.Random(9)
    check(spark, [(rng.choice([None, i % 11, i]), t) for i, t in corpus(120, seed=5)])
