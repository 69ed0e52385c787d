import random
import re
from collections import Counter

import numpy as np

from pathloom.llm import collocations, slot_index

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=collocations.TOP):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for width in (1, 2, 3):
                counts.update((lang, *w[i : i + width]) for i in range(len(w) - width + 1))
    kept = {p: c for p, c in counts.items() if len(p) > 2 and c >= 10}
    out = []
    for (lang, *w), a in kept.items():
        if any(q[0] == lang and 100 * c >= 50 * a and (list(q[1:3]) == w or list(q[2:4]) == w) for q, c in kept.items() if len(w) == 2 and len(q) == 4):
            continue
        cuts = [(1_000_000 * a * a // (counts[(lang, *w[:k])] * counts[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, counts[(lang, *w[:k])], counts[(lang, *w[k:])], n[lang], score))
    ranked = []
    for lang in sorted({r[0] for r in out}):
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], k, *r[1:]) for k, r in enumerate(best, 1)]
    return sorted(ranked)


def corpus():
    rng = random.Random(9)
    words = ["le", "Chat", "noir", "dort", "été", "a\xa0b", "x", "y|z"]
    rows = [(rng.choice(["fr", "en", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rng.randint(0, 120)))) for _ in range(80)]
    return [*rows, ("en", None), ("en", ""), (None, " ,.;"), ("de", "ho ho " * 3000), ("fr", "CHAT noir, chat noir"), ("fr", "CHAT noir, chat noir")]


def found(spark, rows, **options):
    docs = spark.createDataFrame([(k, t, lang, 1) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, words int")
    return sorted(map(tuple, collocations.mine(docs, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_against_brute_force(spark):
    assert found(spark, corpus()) == brute(corpus())


def test_small_groups_shards_and_memories_change_nothing(spark, monkeypatch):
    for module, name, value in ((slot_index, "SHARD_KEYS", 7), (slot_index, "GROUP_KEYS", 14), (collocations, "SLICE_BYTES", 500), (collocations, "REMEMBERED", 5), (collocations, "GATHERED", 50), (collocations, "LATELY_BITS", 2), (collocations, "ARITY", 2)):
        monkeypatch.setattr(module, name, value)
    assert found(spark, corpus(), top=5) == brute(corpus(), 5)


def test_no_candidates(spark):
    assert found(spark, []) == [] and found(spark, [("en", "one two three")]) == []


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    shard = slot_index.shard_of(a, 3)
    rows = []
    for s in range(3):
        sizes, bits, stored = slot_index.build(a[shard == s], b[shard == s])
        rows.append({"shard": s, "n": int((shard == s).sum()), "sizes": sizes.tobytes(), "bits": bits.tobytes(), "stored": stored.tobytes()})
    held = slot_index.Group(rows, 3)
    assert sorted(held.slots(a, b)) == list(range(5000))
    assert (held.slots(a, b + np.uint64(1)) == -1).all()
    some = slot_index.Group(rows[1:2], 3)
    assert (some.slots(a, b)[shard != 1] == -1).all() and sorted(some.slots(a, b)[shard == 1]) == list(range(int((shard == 1).sum())))
