import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", " ", "  ", "\n", " \n ", "a", " a", "a ", "a  b", "don't  we'll 'sn", "x" * 3000, "naïve café — 日本語 🙂👍🏽", "tab\tnew\r\nline    x",
    "<|endoftext|> <unk> ▁ Ġ", "1234567 12,5 %%%", "\u0000\u0001 �", "مرحبا بالعالم", "áë", "    indented()\n\n\treturn 1",
]


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


def test_ids_as_tiktoken_and_back(ours, theirs):
    rng = random.Random(2)
    made = ["".join(rng.choice("ab cdé'1\n\t ,日") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    for text in TEXTS + made:
        ids = ours.encode(text)
        assert ids == theirs.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=200))
def test_any_text(ours, theirs, text):
    assert ours.encode(text) == theirs.encode_ordinary(text)


def test_digests_of_a_table(spark, theirs):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(100, None, 1, "x"), (100, None, 1, "x"), (None, "null id", 1, "x")]
    found = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string").repartition(3)).collect()

    def expected(i, text):
        ids = theirs.encode_ordinary(text or "")
        return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert sorted(map(tuple, found), key=str) == sorted((expected(i, t) for i, t, *_ in rows), key=str)


def test_round_trip_of_a_table_and_an_empty_one(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    back = bpe.decode_documents(bpe.encode_documents(docs))
    assert sorted(map(tuple, back.collect())) == sorted(enumerate(TEXTS))
    empty = docs.limit(0)
    assert bpe.digests(empty).collect() == [] and bpe.decode_documents(bpe.encode_documents(empty)).collect() == []
