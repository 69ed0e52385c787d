import random
from collections import Counter

import pytest
from brute import WORDS, targets

from pathloom.llm.mixing import PART_WORDS, mix_documents, serve

SCHEMA = "doc_id long, text string, source string, n_chars long, size string, target string"


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choices(["hot", "b", "a", "é", None], [60, 20, 10, 2, 8])[0]
        text = rng.choice([None, "", "w " * 2000, *[" ".join("v" * rng.randint(1, 5) for _ in range(rng.randint(1, 60))) for _ in range(9)]])
        rows.append((i, text, source, len(text or ""), "s", "t"))
    return rows


def size(text):
    return len(WORDS.findall(text or ""))


def test_targets_and_served_words(spark):
    rows = corpus()
    found = serve(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    sizes = Counter()
    for _, text, source, *_ in rows:
        sizes[source] += size(text)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    wanted = targets(sizes, {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)})
    assert len(found) == len(rows)
    taken = Counter()
    for r in found:
        assert r["size"] == size(rows[r["doc_id"]][1]) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]], abs=1e-5)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for source in sizes:
        # Short of its target by less than a part, above it by less than the parts of the others.
        assert -PART_WORDS < taken[source] - wanted[source] < PART_WORDS * (len(sizes) - 1)
    again = serve(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_the_mix_holds_what_was_taken_in_order_of_service(spark):
    rows = corpus(120, seed=4)
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = {r["doc_id"]: r["taken"] for r in serve(docs).collect()}
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += size(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got == Counter({i: n for i, n in taken.items() if n})
    assert [r["doc_id"] for r in mix_documents(docs.repartition(3)).collect()] == [r["doc_id"] for r in mixed.collect()]


def test_no_words_empty_tables_and_repeated_ids(spark):
    assert serve(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mix_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    silent = serve(spark.createDataFrame([(1, None, None, 0, "", ""), (2, " ", "a", 1, "", "")], SCHEMA)).collect()
    assert [(r["taken"], r["target"]) for r in silent] == [(0, 0.0)] * 2
    same = [(7, "a b c", "s", 5, "", "")] * 3 + [(None, "d e", "s", 3, "", "")]
    assert sum(r["taken"] for r in serve(spark.createDataFrame(same, SCHEMA)).collect()) == 11
    assert sum(size(r["text"]) for r in mix_documents(spark.createDataFrame(same, SCHEMA)).collect()) == 11
