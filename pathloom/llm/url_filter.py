"""URL filters: host and path rules first, link-graph propagation for the rest.

Pages that a rule fits seed their hosts: allowed ones with trust, blocked ones with distrust. Trust
flows along host edges as personalised PageRank, distrust along the reversed edges; both run as one
iteration of joins and sums over an aggregated edge table, until the ranks have settled. Either side
shares a mass of one among its seeds, by their pages, so that neither wins by having more of them. A
host whose distrust exceeds THRESHOLD times its trust is blocked, any other is allowed.

Host edges are links between hosts, counted, and one edge each way between a host and the domain
above it. Mass that reaches a host without edges out counts there once and goes no further.

Defined results: a null url, or one without "://", has an empty host and path and is allowed; a
null html has no links; repeated rows are judged alike and count as separate seeds; hosts that no
seed reaches are allowed; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import UPPER, discard, materialize, table

#: (verdict, rule): host, then path. The longest rule that fits decides.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING = 0.85
#: A host is blocked where its distrust exceeds so many times its trust.
THRESHOLD = 1.0
#: Iterations after which the SQL ends; propagate() goes on until the ranks have settled.
ITERATIONS = 160
#: Iterations between two writes to the shared folder and looks at the change.
WRITE_EVERY = 5
#: Edges for each task that an iteration runs: a small graph is not spread over all shuffle partitions, neither read from as many files.
EDGES_A_TASK, LEAST_TASKS = 250_000, 4
#: Ranks have settled when none changed by more than this share of itself, however small it is.
SETTLED = 1e-7
#: Distrust must exceed trust by this share of it, so that the order of sums never decides between equals.
MARGIN = 1e-6

LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def lower_host(host: Column) -> Column:
    return F.translate(host, UPPER, UPPER.lower())


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without '://'."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return lower_host(host), path


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, else nulls. Equal lengths: the first stated."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: counted links between different hosts, and ties between neighbouring domains."""
    host, _ = url_parts(F.col("url"))
    links = (
        pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
        .select("src", lower_host(F.col("dst")).alias("dst"))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )
    hosts = pages.select(host.alias("host")).distinct().filter("host <> ''")
    labels = F.split("host", r"\.")
    # Every host with the domains above it, down to two labels.
    above = hosts.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("low")).distinct()
    ties = above.filter(F.size(F.split("low", r"\.")) > 2).select("low", F.regexp_replace("low", r"^[^.]*\.", "").alias("high"))
    both = ties.select(F.col("low").alias("src"), F.col("high").alias("dst")).unionByName(ties.select(F.col("high").alias("src"), F.col("low").alias("dst")))
    all_edges = links.filter("src <> '' and src <> dst").unionByName(both.withColumn("weight", F.lit(1.0)))
    return all_edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """kind, host, rank: trust along edges and distrust against them, from seeds (kind, host, mass).

    Ends when the last iterations reached no new host and changed no rank by more than SETTLED of it,
    so that hosts far from all seeds are judged as finely as those near them.
    """
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = ways.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    shares = materialize(ways.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("out")).alias("share")), "host-shares")
    tasks = max(LEAST_TASKS, -(-shares.count() // EDGES_A_TASK))
    shares, seeds = shares.coalesce(tasks), seeds.coalesce(tasks)
    start = seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("rank"))
    ranks = first = seeds.select("kind", "host", F.col("mass").alias("rank"))
    while True:
        before = ranks
        for _ in range(WRITE_EVERY):
            sent = shares.join(ranks, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("share") * F.col("rank") * damping).alias("rank"))
            ranks = sent.unionByName(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank")).coalesce(tasks)
        ranks = materialize(ranks, "ranks")
        both = ranks.select("kind", "host", "rank", F.lit(0.0).alias("was"), F.lit(0).alias("known")).unionByName(before.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("was"), F.lit(1).alias("known")))
        hosts = both.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was"), F.max("known").alias("known")).coalesce(tasks)
        moved = (F.abs(F.col("rank") - F.col("was")) > SETTLED * F.col("rank")) | ((F.col("known") == 0) & (F.col("rank") > 0))
        unsettled = hosts.agg(F.count_if(moved)).first()[0]
        if before is not first:
            discard(before)
        if not unsettled:
            return ranks


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    host, path = url_parts(F.col("url"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    judged = materialize(pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "ruled": verdict}), "judged")
    seeds = (
        judged.filter("ruled is not null and host <> ''")
        .groupBy(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host")
        .agg(F.count(F.lit(1)).cast("double").alias("mass"))
    )
    # Two rows: one for each kind.
    totals = seeds.groupBy("kind").agg(F.sum("mass").alias("total"))
    seeds = seeds.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("mass") / F.col("total")).alias("mass"))
    ranks = propagate(host_edges(pages), materialize(seeds, "seeds"), damping)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0))
    blocked = ranks.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust")).filter(F.col("distrust") > THRESHOLD * (1 + MARGIN) * F.col("trust")).select("host", F.lit("block").alias("by_graph"))
    return judged.join(materialize(blocked, "blocked-hosts"), "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_graph", F.lit("allow")).alias("verdict"))


def op6_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    # moved: what is left of each seed's mass after so many steps; a rank is the damped sum over them.
    steps = f""", moved(step, kind, host, mass) AS (
  SELECT 0, kind, host, mass FROM seeds
  UNION ALL SELECT m.step + 1, m.kind, sh.dst, sum(m.mass * sh.share) * {DAMPING} FROM moved m JOIN shares sh ON sh.kind = m.kind AND sh.src = m.host WHERE m.step < {ITERATIONS} GROUP BY m.step, m.kind, sh.dst
), ranks AS (
  SELECT kind, host, sum(CASE WHEN step < {ITERATIONS} THEN {1 - DAMPING} ELSE 1 END * mass) AS rank FROM moved GROUP BY kind, host
)"""
    return (
        r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(ruled, rule, domain, prefix) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
    ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), j AS (
  SELECT p.page_id, p.host, p.path, arg_max(rule, length(rule)) AS rule, arg_max(ruled, length(rule)) AS ruled
  FROM (SELECT *, row_number() OVER () AS n FROM p) p LEFT JOIN rules r ON (p.host = r.domain OR ends_with(p.host, '.' || r.domain)) AND starts_with(p.path, r.prefix)
  GROUP BY p.n, p.page_id, p.host, p.path
), hosts AS (
  SELECT DISTINCT host FROM p WHERE host <> ''
), above AS (
  SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), k, len(string_split(host, '.'))), '.') AS low
  FROM hosts, unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS u(k)
), ties AS (
  SELECT low, regexp_replace(low, '^[^.]*\.', '') AS high FROM above WHERE len(string_split(low, '.')) > 2
), links AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), 'href\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1, 'i')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM p
), edges AS (
  SELECT src, dst, sum(weight) AS weight FROM (
    SELECT src, dst, 1.0::DOUBLE AS weight FROM links WHERE src <> '' AND src <> dst
    UNION ALL SELECT low, high, 1.0 FROM ties UNION ALL SELECT high, low, 1.0 FROM ties) GROUP BY src, dst
), ways AS (
  SELECT 'trust' AS kind, src, dst, weight FROM edges UNION ALL SELECT 'distrust', dst, src, weight FROM edges
), shares AS (
  SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM ways
), seeds AS (
  SELECT CASE WHEN ruled = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*)::DOUBLE / (sum(count(*)) OVER (PARTITION BY CASE WHEN ruled = 'allow' THEN 'trust' ELSE 'distrust' END))::DOUBLE AS mass
  FROM j WHERE ruled IS NOT NULL AND host <> '' GROUP BY 1, 2
)"""
        + steps
        + f""", blocked AS (
  SELECT host FROM ranks GROUP BY host
  HAVING sum(CASE WHEN kind = 'distrust' THEN rank ELSE 0 END) > {THRESHOLD * (1 + MARGIN)}::DOUBLE * sum(CASE WHEN kind = 'trust' THEN rank ELSE 0 END)
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' END, 'allow') AS verdict FROM j
"""
    )


SQL = {"op6_link_trust": _sql()}
