import binascii
from pathlib import Path

import numpy as np
import pytest

from pathloom.llm import quality, toxicity

SF = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def held_out(doc_id):
    return binascii.crc32(str(doc_id).encode()) % 5 == 0


def auc(score, label):
    order = np.argsort(score, kind="stable")
    _, inverse, counts = np.unique(np.asarray(score)[order], return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    positive = np.asarray(label)[order] == 1
    return (ranks[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())


@needs_data
def test_quality_of_rows_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    out = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert auc([r["score"] for r in out], [truth[r["doc_id"]] for r in out]) > 0.85
    assert np.mean([r["predicted"] for r in out if truth[r["doc_id"]] == 1]) > 0.97


def test_quality_reads_nothing_but_text_and_training_labels(spark):
    good = [(k, "A calm sentence with words of many kinds, written out in full.\nAnother line follows it. " * (1 + k % 9), "en", "a") for k in range(120)]
    bad = [(k, "BUY!! $$$ | now | now | now " * (1 + k % 9), "de", "b") for k in range(120, 240)]
    schema = "doc_id long, text string, lang string, source string, label int, x string"
    docs = spark.createDataFrame([(*r, 1, "x") for r in good + bad], schema)
    labels = [(k, int(k < 120), 0) for k in range(240)]
    fit = lambda rows: quality.train(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
    model = fit(labels)
    flipped = fit([(k, 1 - q if held_out(k) else q, t) for k, q, t in labels])
    odd = [(900, None), (901, ""), (902, "calm " * 40_000), (902, "calm " * 40_000), (None, "null id")]
    asked = spark.createDataFrame(odd + [r[:2] for r in good + bad], "doc_id long, text string")
    first, second = (sorted(map(tuple, quality.score(asked, m).collect()), key=str) for m in (model, flipped))
    assert first == second
    by_id = {r[0]: r for r in first}
    assert by_id[None][1] is False and by_id[900][2] == by_id[901][2] and len(first) == 245
    assert np.mean([by_id[k][3] == int(k < 120) for k in range(240)]) > 0.98
    kept = quality.keep_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k in range(240) if by_id[k][3]}


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x) > 0.5) == y) > 0.9
    by_hand = model.bias + sum(t[np.searchsorted(e, x[:, j], side="right")] for j, (e, t) in enumerate(zip(model.edges, model.tables)))
    for (i, j), t in zip(model.pairs, model.pair_tables):
        by_hand = by_hand + t[np.searchsorted(model.pair_edges[i], x[:, i], side="right"), np.searchsorted(model.pair_edges[j], x[:, j], side="right")]
    assert model.margin(x) == pytest.approx(by_hand)


@pytest.mark.parametrize("rows", [[], [(1, 1, 0)], [(1, None, None), (None, 1, 1)]])
def test_no_labels_or_one_class(spark, rows):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").selectExpr("*", "'en' AS lang")
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert len({r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()}) == 1
    scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert [r["toxic"] for r in scored] == [0, 0]
    assert quality.score(docs.limit(0), quality.train(docs, labels)).collect() == []


@needs_data
def test_toxic_rows_that_were_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train(docs, labels.filter("doc_id % 4 <> 0"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.filter("doc_id % 4 = 0").collect()}
    rows = [r for r in toxicity.score(docs, chain).collect() if r["doc_id"] in truth]
    hit = [r["toxic"] for r in rows if truth[r["doc_id"]] == 1]
    false = [r["toxic"] for r in rows if truth[r["doc_id"]] == 0]
    assert len(hit) > 20 and np.mean(hit) > 0.8 and np.mean(false) < 0.02


def test_later_models_of_the_chain_use_earlier_categories():
    rng = np.random.default_rng(4)
    n = 600
    first = rng.random(n) < 0.5
    rows = [[0] if f else [1] for f in first]
    y = np.stack([first, first], axis=1).astype(float)
    weights = toxicity.fit_chain(rows, y, 3, rng.integers(0, toxicity.FOLDS, n))
    assert len(weights[0]) == 4 and len(weights[1]) == 5 and weights[1][3] > 0
    p = toxicity.run_chain(weights, toxicity.csr(rows), n, 3)
    assert np.mean((p[:, 1] > 0.5) == first) == 1.0


def test_toxicity_of_odd_rows(spark):
    texts = [(k, f"plain words number {k}", "en") for k in range(60)] + [(k, f"you vilebeast {k}", "en") for k in range(60, 120)]
    docs = spark.createDataFrame([(*t, "x", 2.0) for t in texts], "doc_id long, text string, lang string, toxic string, p_toxic double")
    labels = spark.createDataFrame([(k, 1, int(k >= 60)) for k in range(120)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    odd = [(1, None), (2, ""), (3, "vilebeast"), (3, "vilebeast"), (4, "calm " * 100_000), (5, "calm " * 100_000 + "Vilebeasts"), (None, "plain")]
    found = toxicity.score(spark.createDataFrame(odd, "doc_id long, text string").repartition(1), chain).collect()
    assert sorted(((r["doc_id"] or 0, r["toxic"]) for r in found)) == [(0, 0), (1, 0), (2, 0), (3, 1), (3, 1), (4, 0), (5, 1)]
