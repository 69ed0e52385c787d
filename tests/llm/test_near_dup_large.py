"""A group of more than two thousand near copies: its rows agree with brute force, and what is sent on grows with its size only."""

import random

import numpy as np
from brute import shingle_set

from pathloom.llm import near_dup

COPIES = 2200


def texts(seed=4):
    """Copies of one text around the threshold: some change so much that no copy is linked to them."""
    rng = random.Random(seed)
    base = [f"word{k}" for k in range(70)]
    out = []
    for n in range(COPIES):
        words = list(base)
        for k in range(rng.choice([0, 1, 1, 1, 2, 2, 3])):
            words[rng.randrange(len(words))] = f"new{n}-{k}"
        out.append(" ".join(words))
    return out


def stated(docs):
    """The smallest id that each reaches, by whole matrices of overlaps."""
    sets = [shingle_set(t) for t in docs]
    number = {m: k for k, m in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(sets), len(number)), np.float32)
    for row, s in enumerate(sets):
        has[row, [number[m] for m in s]] = 1
    both, size = has @ has.T, has.sum(1)
    linked = 5 * both >= 4 * (size[:, None] + size - both)
    label = np.arange(len(sets))
    while True:
        lower = np.where(linked, label, len(sets)).min(1)
        if (lower == label).all():
            return label
        label = np.minimum(label, lower)


def test_links_are_lost_nowhere_and_grow_with_the_group(spark, monkeypatch):
    docs = texts()
    sent, write = {}, near_dup.materialize

    def counted(frame, name):
        out = write(frame, name)
        sent[name] = max(sent.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dup, "materialize", counted)
    found = near_dup.cluster(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4))
    assert [r["component_id"] for r in found.orderBy("doc_id").collect()] == stated(docs).tolist()
    # The pairs of this group are more than two million.
    assert sent["large-links"] <= 2 * COPIES and sent["more-links"] <= COPIES
    # All of it went through a tree of blocks: the rows there, and the sets that it left undecided.
    assert sent["large-apart"] > 5 * COPIES and sent["undecided"] <= 2 * COPIES
