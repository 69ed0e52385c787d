from collections import Counter
from itertools import permutations

from brute import WORDS

from pathloom.llm import filter_audit

LONG = " ".join(f"w{k}" for k in range(220))
DOCS = [
    (5, LONG, "en"), (3, LONG, "fr"), (3, LONG, "fr"), (9, LONG, "en"), (None, LONG, "en"), (None, LONG, None), (1, None, None), (2, "", "en"), (4, "A B # $", "en"),
    (6, "same " * 300, "en"), (7, "same " * 300, "de"), (8, LONG.upper(), "de"), (10, "a|b", ""), (11, LONG + "\x1c&", "fr"), (12, "É" * 300 + " x", "fr"), (12, "other", "fr"),
]
LABELS = [(5, 1, 0), (5, 0, 1), (3, 1, 1), (9, 1, None), (7, 0, 1), (None, 1, 1), (12, 1, 0), (99, 1, 1)]


def brute(docs, labels):
    lowest = {}
    for i, t, _ in docs:
        if i is not None:
            lowest[t or ""] = min(lowest.get(t or "", i), i)
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = WORDS.findall(t)
        fails = "".join(f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > lowest[t])) if x)
        rows.append((lang or "", fails, i in good, i in toxic))
    out, shares = [], Counter()
    for part in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                hit = sum(f in r[1] for r in own)
                shares[part, f] += len(gone)
                out.append((part, order, step, len(left), len(gone), hit - len(gone), sum(r[1] == f for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in out)


def report(spark, docs, labels):
    frame = spark.createDataFrame([(i, t, lang, "x", 1, 2) for i, t, lang in docs], "doc_id long, text string, lang string, part string, n int, digest int")
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    return sorted(map(tuple, filter_audit.audit(frame, marks).collect()))


def test_against_brute_force(spark):
    found = report(spark, DOCS, LABELS)
    assert found == brute(DOCS, LABELS) and len(found) == 600 * 4


def test_empty_tables(spark):
    assert report(spark, [], []) == []
    assert report(spark, DOCS[:2], []) == brute(DOCS[:2], [])
