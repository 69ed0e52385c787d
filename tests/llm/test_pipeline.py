import base64
import hashlib
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from brute import LOWER, WORDS, near_components

import corpus_pipeline
from pathloom.llm import mixing, quality
from pathloom.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_run_against_brute_force(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    accepted = {r["doc_id"] for r in quality.score(docs, quality.train(docs, labels)).collect() if r["predicted"]}
    rows = [r.asDict() for r in docs.collect() if r["doc_id"] in accepted]
    last = {}
    for r in rows:
        key = (r["text"] or "").translate(LOWER)
        last[key] = max(last.get(key, -1), r["doc_id"])
    rows = [r for r in rows if last[(r["text"] or "").translate(LOWER)] == r["doc_id"]]
    stay = {c for _, _, c in near_components([(r["doc_id"], r["text"]) for r in rows])}
    rows = [r for r in rows if r["doc_id"] in stay]
    # Which words each document gives is tested beside the mixing operator; here it decides the copies.
    taken = {r["doc_id"]: r["taken"] for r in mixing.serve(spark.createDataFrame(rows, docs.schema)).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter()
    for r in rows:
        words, left = WORDS.findall(r["text"] or ""), taken[r["doc_id"]]
        while left > 0:
            text = r["text"] if left >= len(words) else " ".join(words[:left])
            left -= len(words)
            ids = encoding.encode_ordinary(text)
            expected[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == expected


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.collect() == []
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
