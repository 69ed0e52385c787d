import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pathloom.llm import rans

DOCS = [(7, "Hello, world! it's 42\n\n\tTABS <|endoftext|> X<|startoftext|>y"), (3, None), (5, ""), (9, "é É é ﬁ " + "ab" * 3000), (2, " non breaking\x1cseparators"), (3, "again"), (None, "no id"), (11, "same same"), (11, "same same")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute(rows, library):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def order(rows):
    return sorted(rows, key=lambda r: r[1])


def written(spark, rows, path, slices=1):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, place int, part string").coalesce(slices)
    rans.write_ids(frame, path)
    return path


def test_against_the_library(spark, tmp_path, library):
    path = written(spark, DOCS, str(tmp_path / "a"))
    found = order(map(tuple, rans.digests(spark, path).collect()))
    assert found == brute(DOCS, library)
    lists = {r["start"]: r["ids"] for r in rans.read_ids(spark, path).collect()}
    assert lists[found[1][1]][:-1] == library.encode(DOCS[4][1], add_special_tokens=False).ids


def test_words_have_the_ids_of_whole_texts(library):
    rng = random.Random(1)
    letters = "aAbİıſKéÉŉ'’.,;:!?s tTdlĹͅक़ﬁ²Ⅷ9<|>  \x1c\n\tİǅßẞΣς"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as held:
        one = rans.WordCoder(held.read())
    assert one.by_words
    ids, n = one.encode_all([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_another_build_encodes_texts_as_they_are():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as held:
        one = rans.WordCoder(held.read())
    whole = Tokenizer.from_file(path)
    ids, n = one.encode_all([b"a  b\n c", b""])
    assert not one.by_words and ids.tolist() == [*whole.encode("a  b\n c", add_special_tokens=False).ids, 2, 2] and n.tolist()[-1] == 1


def test_several_parts_segments_and_blocks(spark, tmp_path, library, monkeypatch):
    for name, value in (("PART_BYTES", 3000), ("SEGMENT_IDS", 700), ("BLOCK_IDS", 64), ("ABREAST", 3)):
        monkeypatch.setattr(rans, name, value)
    rng = np.random.default_rng(4)
    rows = [(int(i), " ".join(rng.choice(["alpha", "Beta", "gamma.", "d", "ε"], rng.integers(0, 90)))) for i in rng.permutation(60)]
    rows += [(30, f"hot {k}") for k in range(40)]
    path = written(spark, rows, str(tmp_path / "b"))
    found = order(map(tuple, rans.digests(spark, path).collect()))
    want = brute(rows, library)
    assert [r[:2] for r in found] == [r[:2] for r in want] and found == want
    assert spark.read.parquet(path).count() > 3


def test_any_stretch_reads_its_blocks_only_and_damage_is_found(monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_IDS", 96)
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 5000) * 9, 49_000).astype(np.uint32)
    data = rans.pack_segment([1, None], np.array([4000, 1000]), ids)
    held = rans.Segment(data)
    assert np.array_equal(held.read(), ids) and held.doc_ids == [1, None]
    for start, stop in ((0, 1), (95, 97), (4990, 9999), (300, 300)):
        assert np.array_equal(held.read(start, stop), ids[start:stop])
    hurt = bytearray(data)
    hurt[-3] ^= 1
    hurt = rans.Segment(bytes(hurt))
    assert np.array_equal(hurt.read(0, 96 * 40), ids[: 96 * 40])
    with pytest.raises(ValueError, match="damaged"):
        hurt.read()


def test_takes_about_the_entropy():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.geometric(0.01, 300_000), 3000).astype(np.uint32)
    _, n = np.unique(ids, return_counts=True)
    bits = -(n * np.log2(n / ids.size)).sum()
    assert len(rans.pack_segment([1], np.array([ids.size]), ids)) * 8 < bits * 1.03


def test_tables_are_exact():
    for counts in ([5], [1] * 49_000, [10**9, 1, 1], [3, 3, 3]):
        out = rans.scaled(np.array(counts))
        assert out.sum() == 1 << rans.SCALE_BITS and out.min() >= 1


def test_empty_table(spark, tmp_path):
    path = written(spark, [], str(tmp_path / "c"))
    assert rans.digests(spark, path).collect() == []
