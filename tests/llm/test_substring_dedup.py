import random

import pytest
from brute import sha, vocabulary, without_repeats

from pathloom.llm import substring_dedup
from pathloom.llm.substring_dedup import FingerprintIndex, dedup


def corpus(n=70, seed=5):
    """Texts that share passages of 40 to 120 words, overlapping ones, copies and self-repeats among them."""
    rng, words = random.Random(seed), vocabulary()
    make = lambda k: [rng.choice(words) for _ in range(k)]
    passages = [make(rng.choice([40, 49, 50, 51, 80, 120])) for _ in range(9)]
    texts = [None, "", "é " * 60, "w " * 300, "w " * 55]
    while len(texts) < n:
        parts = [make(rng.choice([0, 5, 60, 400]))]
        for _ in range(rng.choice([0, 1, 2, 3])):
            p = rng.choice(passages)
            cut = rng.choice([0, 0, 5])
            parts += [p[cut:], make(rng.choice([0, 1, 30]))]
        text = " ".join(w for p in parts for w in p)
        texts.append(rng.choice([text, text, text.replace(" ", "\n  ", 3), texts[-1]]))
    ids = list(range(3, 3 + 2 * n, 2))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key long, anchor string")


def rows_of(result):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in result.collect())


@pytest.mark.parametrize("seed", [5, 6])
def test_against_brute_force(spark, seed):
    docs = corpus(seed=seed)
    assert rows_of(dedup(frame(spark, docs).repartition(4))) == without_repeats(docs)


def test_batches_in_order_of_id_agree_with_the_whole_and_runs_are_compacted(spark):
    docs = sorted(corpus(48), key=lambda d: d[0])
    index, out = FingerprintIndex(spark), []
    for k in range(0, len(docs), 12):
        earlier = frame(spark, docs[:k]) if k else None
        out += rows_of(index.add(frame(spark, docs[k : k + 12]), earlier))
        assert len(index.anchors.runs) <= substring_dedup.MAX_RUNS
    assert sorted(out) == without_repeats(docs)
    index.windows.compact()
    (run,) = index.windows.runs
    table = spark.table(run)
    assert table.count() == table.select("h1", "h2").distinct().count() > 0


def test_empty_tables_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert dedup(spark.createDataFrame([], schema)).collect() == []
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [(None, passage), (None, None), (2, passage), (2, passage), (5, f"{passage} more")]
    found = rows_of(dedup(spark.createDataFrame(rows, schema)).filter("doc_id is not null"))
    assert found == [(2, 60, 0, sha(passage)), (2, 60, 0, sha(passage)), (5, 61, 60, sha("more"))]
    assert dedup(spark.createDataFrame(rows, schema)).filter("doc_id is null and n_removed = 0").count() == 2


def test_an_index_is_opened_again_by_its_name(spark):
    docs = sorted(corpus(36, seed=8), key=lambda d: d[0])
    first = rows_of(FingerprintIndex(spark, "kept_substrings").add(frame(spark, docs[:20])))
    again = FingerprintIndex(spark, "kept_substrings")
    assert len(again.anchors.runs) == 1
    with pytest.raises(ValueError):
        again.add(frame(spark, docs[20:]))
    assert sorted(first + rows_of(again.add(frame(spark, docs[20:]), frame(spark, docs[:20])))) == without_repeats(docs)
