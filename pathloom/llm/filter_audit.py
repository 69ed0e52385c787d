"""Audit of how filters interact: what each removes first, again, or alone, in every order.

All that the report needs follows from the 32 joint-failure counts of five filters: J(S) is the
number of documents that fail every filter of S, a sum of products of failure flags. By
inclusion-exclusion the documents that pass all of P number the sum over S within P of
(-1)^|S| J(S); those that fail one filter only, and the Harsanyi dividends (-1)^(|S|+1) J(S) whose
equal shares are the Shapley values, come from the same counts. Rows are read once for their flags;
the report is a product of small tables of counts, made for each part by itself.

Defined results: a null text counts as empty, a null lang is the part of the empty string; a text
is a copy if a smaller id has it, so rows of the smallest id are no copies however often they
repeat, and a null id neither is a copy nor makes one; a document counts as good (or toxic) once if
any of its label rows says so; an empty table gives an empty report; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.common import table

FILTERS = "ABCDE"
SUBSETS = range(1 << len(FILTERS))
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 3
WHITE, MARKS = r"[\x20\x09-\x0D]+", "[#$%&*|]"
#: What is counted of each joint failure: documents, good ones, toxic ones.
WEIGHTS = ("n", "good", "toxic")


def text_flags(text: Column) -> list[Column]:
    """Failure of the filters that look at one text: 1 or 0 each, in the order of FILTERS."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failing = [count < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * count, 100 * upper > MAX_UPPER_PERCENT * F.length(text), text.rlike(MARKS)]
    return [f.cast("int") for f in failing]


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, the flags a to e and the weights n, good, toxic: rows that add up to all documents.

    Copies share their text's flags, so a text is one row for each part and needs no row for each
    copy: what it holds of the smallest id is the only part that is not a copy.
    """
    text = F.coalesce("text", F.lit(""))
    a, b, c, d = text_flags(text)
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    same = ["digest", "part", "a", "b", "c", "d"]
    rows = rows.groupBy("doc_id", *same).agg(F.count(F.lit(1)).alias("n"))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max((F.coalesce(F.col(x), F.lit(0)) == 1).cast("int")).alias(y) for x, y in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.join(marks, "doc_id", "left").withColumns({w: F.coalesce(F.col(w), F.lit(0)) * F.col("n") for w in ("good", "toxic")})
    known = F.col("doc_id").isNotNull()
    first = F.min(F.when(known, F.struct("doc_id", *WEIGHTS)))
    texts = rows.groupBy(*same).agg(first.alias("first"), *[F.sum(F.when(known, F.col(w)).otherwise(0)).alias(w) for w in WEIGHTS], F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("unknown"))
    # A text has at most one row for each part here.
    texts = texts.withColumn("lowest", F.min("first.doc_id").over(Window.partitionBy("digest")))
    leads = F.coalesce(F.col("first.doc_id") == F.col("lowest"), F.lit(False))
    held = {w: F.when(leads, F.col(f"first.{w}")).otherwise(0) for w in WEIGHTS}
    original = F.struct(F.lit(0).alias("e"), *[(held[w] + (F.col("unknown") if w == "n" else 0)).alias(w) for w in WEIGHTS])
    copy = F.struct(F.lit(1).alias("e"), *[(F.col(w) - held[w]).alias(w) for w in WEIGHTS])
    return texts.select("part", "a", "b", "c", "d", F.explode(F.array(original, copy)).alias("x")).select("part", "a", "b", "c", "d", "x.e", *[f"x.{w}" for w in WEIGHTS]).filter("n > 0")


def joint_failures(flags: DataFrame) -> DataFrame:
    """part and, for each weight, the array of J(S) with S read as a bit mask over the filters."""
    names = [f.lower() for f in FILTERS]

    def product(mask: int, weight: str) -> Column:
        out = F.col(weight)
        for k, name in enumerate(names):
            if mask >> k & 1:
                out = out * F.col(name)
        return F.sum(out)

    return flags.groupBy("part").agg(*[F.array(*[product(s, w) for s in SUBSETS]).alias(w) for w in WEIGHTS])


def moebius(joint: Column, within: int, holding: int = 0) -> Column:
    """Documents that fail all of holding and nothing else of within: the signed sum over the sets between."""
    out = F.lit(0).cast("long")
    for s in SUBSETS:
        if s & holding == holding and s & ~within == 0:
            out = out - joint[s] if (s ^ holding).bit_count() % 2 else out + joint[s]
    return out


def steps() -> list[tuple[str, int, int, int]]:
    """filter_order, step, filter and the mask of the filters before it, for every order."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            out.append(("".join(FILTERS[g] for g in order), k + 1, f, before))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each part's counts for every order of the filters and every step of it."""
    every = SUBSETS[-1]
    orders = factorial(len(FILTERS))
    joint = joint_failures(flagged(docs, labels))
    passing = {w: F.array(*[moebius(F.col(w), p) for p in SUBSETS]) for w in WEIGHTS}
    alone = F.array(*[moebius(F.col("n"), every, 1 << f) for f in range(len(FILTERS))])
    # Each set's dividend is shared equally by its filters; the number of orders is a multiple of every size.
    shares = []
    for f in range(len(FILTERS)):
        total = F.lit(0).cast("long")
        for s in SUBSETS:
            if s >> f & 1:
                total = total + F.lit(orders // s.bit_count() * (-1) ** (s.bit_count() + 1)) * F.col("n")[s]
        shares.append(total)
    solved = joint.select("part", *[passing[w].alias(f"passing_{w}") for w in WEIGHTS], alone.alias("alone"), F.array(*shares).alias("shares"), F.array(*[F.col("n")[1 << f] for f in range(len(FILTERS))]).alias("failing"))
    listed = ", ".join(f"named_struct('filter_order', '{o}', 'step', {k}, 'f', {f}, 'before', {b}, 'after', {b | 1 << f})" for o, k, f, b in steps())
    report = solved.withColumn("s", F.explode(F.expr(f"array({listed})")))
    at = lambda name, index: F.element_at(name, F.col(f"s.{index}") + 1)
    lost = {w: at(f"passing_{w}", "before") - at(f"passing_{w}", "after") for w in WEIGHTS}
    return report.select(
        "part",
        "s.filter_order",
        "s.step",
        at("passing_n", "after").alias("kept"),
        lost["n"].alias("removed"),
        (at("failing", "f") - lost["n"]).alias("redundant"),
        at("alone", "f").alias("unique_fails"),
        lost["good"].alias("good_lost"),
        lost["toxic"].alias("toxic_lost"),
        at("shares", "f").alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))

SQL = {
    "op11_filter_audit": f"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, [w FOR w IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF w <> ''] AS words FROM documents
), g AS (
  SELECT text, min(doc_id) AS lowest FROM t GROUP BY text
), l AS (
  SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, (len(words) < 200)::INTEGER AS a, (100 * len(list_distinct(words)) < 50 * len(words))::INTEGER AS b,
    (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text))::INTEGER AS c, regexp_matches(text, '[#$%&*|]')::INTEGER AS d,
    coalesce(t.doc_id > lowest, false)::INTEGER AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM t JOIN g USING (text) LEFT JOIN l ON l.doc_id = t.doc_id
), m AS (
  SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), o AS (
  SELECT * FROM (VALUES {_ORDERS}) AS v(filter_order)
), s AS (
  SELECT filter_order, k AS step, substr(filter_order, k, 1) AS f, substr(filter_order, 1, k - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
), x AS (
  SELECT *, (CASE WHEN a = 1 THEN 'A' ELSE '' END) || (CASE WHEN b = 1 THEN 'B' ELSE '' END) || (CASE WHEN c = 1 THEN 'C' ELSE '' END)
    || (CASE WHEN d = 1 THEN 'D' ELSE '' END) || (CASE WHEN e = 1 THEN 'E' ELSE '' END) AS fails FROM m
), y AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS hit, fails = f AS only_hit,
    fails <> '' AND regexp_matches(before, '[' || CASE WHEN fails = '' THEN '-' ELSE fails END || ']') AS gone FROM x, s
), r AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (only_hit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM y GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""
}
