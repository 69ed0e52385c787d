import random
from collections import Counter, defaultdict

import pytest

from pathloom.llm import url_filter
from pathloom.llm.url_filter import RULES, best_rule, judge, url_parts

SCHEMA = "page_id long, url string, html string, host string, rule string"


def brute_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, stops: s[: min([s.find(c) for c in stops if c in s], default=len(s))]
    host = cut(rest, "/?#")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), cut(rest[len(host) :], "?#")


def brute_rule(host, path):
    fits = [(len(r), r, v) for v, r in RULES for d, _, p in [r.partition("/")] if (host == d or host.endswith("." + d)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def brute(pages, damping=url_filter.DAMPING, iterations=url_filter.ITERATIONS):
    parts = {p: brute_parts(u) for p, u, _ in pages}
    ruled = {p: brute_rule(*parts[p]) for p in parts}
    edges = Counter()
    for page, _, html in pages:
        src = parts[page][0]
        for piece in (html or "").split('href="')[1:]:
            if (dst := brute_parts(piece.split('"')[0])[0]) and src and src != dst:
                edges[src, dst] += 1
    for host in {h for h, _ in parts.values() if h}:
        labels = host.split(".")
        for k in range(len(labels) - 2):
            low, high = ".".join(labels[k:]), ".".join(labels[k + 1 :])
            edges.setdefault((low, high), 0)
            edges.setdefault((high, low), 0)
    ties = {(".".join(x[k:]), ".".join(x[k + 1 :])) for x in (h.split(".") for h, _ in parts.values() if h) for k in range(len(x) - 2)}
    for low, high in ties:
        edges[low, high] += 1
        edges[high, low] += 1
    ranks = {}
    for kind, says in (("trust", "allow"), ("distrust", "block")):
        seeds = Counter(parts[p][0] for p in parts if ruled[p][1] == says and parts[p][0])
        pages_in_all = sum(seeds.values())
        seeds = {h: n / pages_in_all for h, n in seeds.items()}
        ways = defaultdict(dict)
        for (a, b), w in edges.items():
            src, dst = (a, b) if kind == "trust" else (b, a)
            ways[src][dst] = w
        rank = {h: float(n) for h, n in seeds.items()}
        for _ in range(iterations):
            new = Counter({h: n * (1 - damping) for h, n in seeds.items()})
            for src, mass in rank.items():
                out = sum(ways[src].values())
                for dst, w in ways[src].items():
                    new[dst] += damping * mass * w / out
            rank = new
        ranks[kind] = rank
    blocked = {h for h in ranks["distrust"] if round(ranks["distrust"][h], 9) > round(ranks["trust"].get(h, 0.0), 9)}
    return {p: (*parts[p], ruled[p][0], ruled[p][1] or ("block" if parts[p][0] in blocked else "allow")) for p in parts}


def pages(n=200, seed=2):
    rng = random.Random(seed)
    hosts = ["a.example.org", "Example.org", "shop.com", "x.y.shop.com", "news.net", "cdn.news.net", "de.com", "z.io", "w.z.io", "spam.biz"]
    paths = ["/", "/es/1", "/en/12", "/en/2", "/fr/x", "/de/y", "", "/q?de/", "#/de/"]
    out = []
    for page in range(n):
        links = " ".join(f'<a href="http://{rng.choice(hosts)}{rng.choice(paths)}">' for _ in range(rng.randint(0, 4)))
        out.append((page, f"https://{rng.choice(hosts)}{rng.choice(paths)}", rng.choice([None, "", links, links, links])))
    return out + [
        (n, None, None), (n + 1, "mailto:x", None), (n + 2, "", ""), (n + 3, "http://", None), (n + 4, "a://b://c/d", "x" * 100_000),
        (n + 5, "http://bad.com/de/1", None), (n + 6, "http://pointer.biz/x", '<a href="http://bad.com/de/">')]


@pytest.mark.parametrize("seed", [2, 3])
def test_against_brute_force(spark, seed):
    rows = pages(seed=seed)
    result = judge(spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA).repartition(4))
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in result.collect()}
    assert found == brute(rows)
    assert {v for *_, rule, v in found.values() if rule is None} == {"allow", "block"}


def test_hosts_and_rules(spark):
    cases = [
        ("HTTP://A.Org/B?c#d", "a.org", "/B", "org/", "allow"), ("http://example.org/es/", "example.org", "/es/", "example.org/es/", "block"),
        ("http://sub.example.org/en/1x", "sub.example.org", "/en/1x", "example.org/en/1", "block"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://É.com/fr/", "É.com", "/fr/", "com/fr/", "allow"), ("http://com/de/", "com", "/de/", "com/de/", "block"), ("no host", "", "", None, None), (None, "", "", None, None),
    ]
    frame = spark.createDataFrame([(c[0],) for c in cases], "url string")
    host, path = url_parts(frame["url"])
    parts = frame.select("url", host.alias("host"), path.alias("path"))
    found = parts.select("url", "host", "path", *best_rule(parts["host"], parts["path"])).collect()
    assert sorted(map(tuple, found), key=str) == sorted(cases, key=str)


def test_repeated_rows_and_empty_tables(spark):
    assert judge(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "http://a.org/", None, "", "")] * 2 + [(None, "http://q.net/", "x", "", "")]
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in judge(spark.createDataFrame(rows, SCHEMA)).collect()) == [(0, "allow"), (1, "allow"), (1, "allow")]
