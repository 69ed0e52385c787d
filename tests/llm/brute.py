"""Plain statements of what the operators return, for small tables."""

import hashlib
import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def vocabulary(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def shingle_set(text):
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([" ".join(words)])
    return frozenset(" ".join(words[k : k + 5]) for k in range(len(words) - 4))


def near_components(docs):
    """Rows (doc_id, set size, component) of (doc_id, text); ids must not repeat."""
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def without_repeats(docs, width=50):
    """Rows (doc_id, n_words, n_removed, kept_sha256) of (doc_id, text)."""
    words = {i: WORDS.findall(t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = []
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out)


def targets(sizes, weights, repeats=3):
    """Target of each source by filling: cap the sources above their limit, share the rest again."""
    left, open_, out = float(sum(sizes.values())), dict(sizes), {}
    while open_:
        share = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if weights[s] * share > repeats * sizes[s]]
        if not full:
            return out | {s: weights[s] * share for s in open_}
        for s in full:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
            del open_[s]
    return out
