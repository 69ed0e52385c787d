"""The mix is a prefix of all queued copies in order of virtual finish time."""

from collections import Counter

from test_mixing import SCHEMA, corpus, size

from pathloom.llm import mixing


def test_taken_is_a_prefix_by_finish_time(spark):
    docs = spark.createDataFrame(corpus(200, seed=8), SCHEMA).repartition(5)
    queued, taken = mixing.served(docs, mixing.WEIGHT_CYCLE, mixing.MAX_REPEATS)
    rows = mixing.packets(queued, mixing.MAX_REPEATS).collect()
    rows.sort(key=lambda r: (r["finish"], r["source"] is None, (r["source"] or "").encode(), r["before"], r["turn"]))
    left = sum(r["size"] for r in queued.collect())
    assert sum(r["words"] for r in rows) == mixing.MAX_REPEATS * left  # every copy is queued, and the cut alone ends the mix
    expected = Counter()
    for r in rows:
        words = max(0, min(r["words"], left))
        left -= words
        if words:
            expected[r["source"], r["before"], r["turn"], r["finish"], words] += 1
    assert left == 0
    assert Counter((r["source"], r["before"], r["turn"], r["finish"], r["taken"]) for r in taken.collect()) == expected


def test_repeated_ids_and_clashing_columns(spark):
    schema = "doc_id long, text string, source string, key string, words int, finish double, own int, size_ int, count int"
    rest = ("k", 1, 0.5, 2, 3, 4)
    rows = [(7, "a b c", "s", *rest)] * 3 + [(7, "d e", "s", *rest), (None, "f g h i", "s", *rest), (None, "f g h i", None, *rest), (None, None, None, *rest)]
    docs = spark.createDataFrame(rows, schema)
    taken = sum(r["taken"] for r in mixing.serve(docs).collect())
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    found = mixed.collect()
    # Sources s and none weigh 1 and 2; none is capped at three times its words.
    assert taken == sum(size(r["text"]) for r in found) == 19
    assert sum(size(r["text"]) for r in found if r["source"] is None) == 12
    assert all(tuple(r)[3:] == rest for r in found)
