import random

import numpy as np
import pytest
from brute import near_components, vocabulary

from pathloom.llm import near_dup


def corpus(n=160, seed=7):
    """Random texts, near copies at every distance around the threshold, copies, and frequent openings."""
    rng, words = random.Random(seed), vocabulary()
    texts = [None, "", "  \n ", "one two", "ONE  two", "one two three four five", "x" * 5000]
    common = [rng.choice(words) for _ in range(30)]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.3 or len(texts) < 12:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([3, 8, 30, 120, 900]))))
        elif kind < 0.5:
            texts.append(" ".join(common + [rng.choice(words) for _ in range(rng.choice([0, 3, 6, 9, 40]))]))
        else:
            base = (rng.choice(texts) or "").split() or ["a", "b", "c"]
            for _ in range(rng.choice([0, 1, 1, 2, 4, len(base) // 20])):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
            if rng.random() < 0.2:
                texts[-1] = texts[-1].upper()
    return [(k * 3 + 2, t) for k, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, bucket string, size long")


def rows_of(result):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in result.collect())


@pytest.mark.parametrize("small, block, seed", [(512, 256, 7), (6, 4, 7), (10, 6, 11)])
def test_against_brute_force(spark, monkeypatch, small, block, seed):
    monkeypatch.setattr(near_dup, "SMALL", small)  # small limits send frequent members through the block way
    monkeypatch.setattr(near_dup, "BLOCK", block)
    docs = corpus(seed=seed)
    assert rows_of(near_dup.cluster(frame(spark, docs).repartition(5))) == near_components(docs)


def test_one_of_each_group_is_kept_with_its_columns(spark):
    docs = corpus(60)
    kept = near_dup.keep_documents(frame(spark, docs))
    assert kept.columns == ["doc_id", "text", "bucket", "size"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in near_components(docs)})


def test_empty_tables_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert near_dup.cluster(spark.createDataFrame([], schema)).collect() == []
    assert near_dup.keep_documents(spark.createDataFrame([], schema)).collect() == []
    text = "a b c d e f g h"
    rows = [(None, text), (4, text), (4, text), (4, "other words here"), (9, text.upper()), (11, None)]
    found = near_dup.cluster(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == len(rows)
    assert {r["component_id"] for r in found if r["n_shingles"] == 4} == {4}
    assert {(r["doc_id"], r["component_id"]) for r in found if r["n_shingles"] == 0} == {(11, 11)}


def test_traversal_leaves_no_pair_that_can_be_linked():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = []
    for k in range(120):
        size = int(rng.choice([5, 40, 200]))
        own = np.unique(np.concatenate([base[: size - size // (4 + k % 5)], rng.integers(0, 2**63, size // (4 + k % 5), dtype=np.uint64)]))
        sets.append(own)
    size = np.array([len(s) for s in sets])
    i, j = near_dup.candidate_pairs(size, size, [near_dup.signature(s) for s in sets], np.arange(len(sets)))
    found = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    linked = set()
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                linked.add((a, b))
    assert linked and linked <= found
    assert len(found) < len(sets) * (len(sets) - 1) // 2
