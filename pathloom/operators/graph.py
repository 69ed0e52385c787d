"""Graph operators on edge tables: shortest paths by relaxation, components, chains.

Every loop writes its state to the shared folder that the session names in spark.checkpoint.dir, so
lineage stays short and a lost executor costs a read. What a loop collects is a count.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions import geo


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write and read back."""
    path = f"{shared_dir(df.sparkSession)}/state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Delete what settle() wrote, once nothing reads it any more."""
    for df in written:
        jvm = df.sparkSession._jvm
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class _Improvements:
    """What a search has found so far, in a log: a round appends its improvements and rewrites nothing.

    Every FAN parts of one level become one of the next, with the least for each key, so that what is
    written grows with the improvements (times a logarithm of the rounds), not with rounds x state.
    Parts are read as one table, so that many small files share a task.
    """

    FAN = 16

    def __init__(self, first: DataFrame):
        self.schema, self.session = first.schema, first.sparkSession
        self.levels: list[list[DataFrame]] = [[first]]
        self.merged: list[DataFrame] = []

    def rows(self, parts: list[DataFrame] | None = None) -> DataFrame:
        parts = parts or [p for level in self.levels for p in level]
        return self.session.read.schema(self.schema).parquet(*sorted({f.rpartition("/")[0] for p in parts for f in p.inputFiles()}))

    def least(self, parts: list[DataFrame] | None = None) -> DataFrame:
        return self.rows(parts).groupBy("source", "node").agg(F.min("dist").alias("dist"))

    def append(self, part: DataFrame) -> None:
        """Add a round's part. What was merged before is deleted only now: the round just made has read it."""
        discard(*self.merged)
        self.merged = []
        self.levels[0].append(part)
        for k, level in enumerate(self.levels):
            if len(level) < self.FAN:
                break
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(settle(self.least(level)))
            self.merged += level
            self.levels[k] = []

    def close(self) -> DataFrame:
        """The least of each key, written once; the log is deleted."""
        best = settle(self.least())
        discard(*self.merged, *[p for level in self.levels for p in level])
        return best


#: From this round on a search asks how many rounds it can need at most.
COUNT_FROM = 16
#: States of more rows than this are not shuffled for a round of few: only what its candidates meet is.
WIDE_ROWS = 1_000_000
#: A round is of few where the state has this many times its rows.
FEW = 64
#: Up to this many sources a search costs less than finding out which edges are undercut.
FEW_SOURCES = 8


#: Light edges, then nearest nodes, that each node looks for detours along: ways of up to two edges, then of up to four.
LIGHT = (8, 64)
#: A detour must be shorter by this share, so that rounding of sums decides nothing.
SHORTER = 1 - 1e-9


def without_detoured(slim: DataFrame) -> DataFrame:
    """u, v, w without edges for which the light edges offer a way that is strictly shorter.

    No cheapest path takes such an edge, so that least costs and paths stay as they are, provided that no cost is
    negative; where one is, all edges stay. Each node looks along a few light edges, then along its nearest nodes
    by them, so that the work grows with the nodes, not with pairs of edges. Edges between nodes that these ways
    do not connect are then tried over the first few nodes by the ways found.
    """
    if not slim.filter("w < 0").isEmpty():
        return slim
    lightest = lambda df, n: df.withColumn("__n", F.row_number().over(Window.partitionBy("u").orderBy("w", "v"))).filter(F.col("__n") <= n).drop("__n")
    ways, written = slim, []
    for n in LIGHT:
        ways = settle(lightest(ways, n))
        written.append(ways)
        onward = ways.select(F.col("u").alias("m"), "v", F.col("w").alias("more"))
        longer = ways.withColumnRenamed("v", "m").join(onward, "m").filter("u <> v").select("u", "v", (F.col("w") + F.col("more")).alias("w"))
        ways = longer.unionByName(ways).groupBy("u", "v").agg(F.min("w").alias("w"))
    ways = settle(ways)
    kept = settle(slim.join(ways.withColumnRenamed("w", "detour"), ["u", "v"], "left").filter(F.col("detour").isNull() | (F.col("w") * SHORTER <= F.col("detour"))))
    first = lightest(ways, LIGHT[0]).select("u", F.col("v").alias("m"), F.col("w").alias("begun"))
    tried = kept.filter("detour is null").select("u", "v", "w").join(first, "u").filter(F.col("begun") < F.col("w"))
    undercut = tried.join(ways.select(F.col("u").alias("m"), "v", F.col("w").alias("more")), ["m", "v"]).filter(F.col("w") * SHORTER > F.col("begun") + F.col("more"))
    thin = settle(kept.select("u", "v", "w").join(undercut.select("u", "v").distinct(), ["u", "v"], "left_anti"))
    discard(*written, ways, kept)
    return thin


def nearest_source(edges: DataFrame, sources: DataFrame, cost: str = "length") -> DataFrame:
    """node, source, dist: the nearest source of each node that one reaches, ties to the smaller source.

    A node keeps and sends on its best source only: what a source sends through a node that is nearer to
    another, or as near to a smaller one, is best nowhere behind it.
    """
    slim = settle(edges.groupBy("u", "v").agg(F.min(cost).cast("double").alias("w")))
    thin = without_detoured(slim)
    frontier, improved = _counted(sources.select("node", F.lit(0.0).alias("dist"), "source"))
    best, done, limit, value = frontier, 0, None, F.struct("dist", "source")
    while improved:
        if limit is not None and done > limit:
            raise RuntimeError(f"nearest sources did not settle in {done} rounds")
        sent = frontier.join(thin, F.col("node") == F.col("u")).select(F.col("v").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), "source")
        both = sent.select("node", value.alias("new"), F.lit(None).cast(best.select(value.alias("x")).schema["x"].dataType).alias("old")).unionByName(best.select("node", F.lit(None).cast(best.select(value.alias("x")).schema["x"].dataType).alias("new"), value.alias("old")))
        least = both.groupBy("node").agg(F.min("new").alias("new"), F.min("old").alias("old"))
        better = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") < F.col("old")))
        whole = settle(least.select("node", F.when(better, F.col("new")).otherwise(F.col("old")).alias("b"), better.alias("moved")).select("node", "b.dist", "b.source", "moved"))
        before, frontier = best, whole.filter("moved").select("node", "dist", "source")
        improved, best, done = frontier.count(), whole.select("node", "dist", "source"), done + 1
        discard(before)
        if limit is None and done >= COUNT_FROM:
            limit = slim.select("v").distinct().count() + 1
    discard(slim, thin)
    return best.select("node", "source", "dist")


def shortest_paths(edges: DataFrame, sources: DataFrame, cost: str = "length", cutoff: float | None = None, rounds: int | None = None, with_path: bool = False) -> DataFrame:
    """source, node, dist (and path): least costs from every source at once, over paths of any length.

    edges has u, v and the cost (smallest of parallel edges counts); sources has source and node. In
    each round only nodes that improved send on: the frontier joins the edges, the minimum of each
    (source, node) is taken, and what does not improve is dropped. For many sources, edges that a few
    light ones undercut are left out first: no cheapest path takes them. Improvements are
    appended to a log; the least of each key is taken once at the end. Rounds carry costs only, which
    are aggregated without a sort; paths are laid afterwards, along edges that least costs differ by.
    Equal costs go to the lexicographically smaller path.

    A cheapest path has at most as many edges as there are nodes with one into them; the round after
    that improves nothing. Where it does (a cycle of negative cost), or at rounds if given, this raises.
    """
    whole = settle(edges.groupBy("u", "v").agg(F.min(cost).cast("double").alias("w")))
    begun, known = _counted(sources.select("source", "node", F.lit(0.0).alias("dist")))
    slim = without_detoured(whole) if known > FEW_SOURCES else whole
    frontier, improved, log, limit, done = begun, known, _Improvements(begun), rounds, 0
    while limit is None or done < limit:
        reach = frontier.join(slim, F.col("node") == F.col("u"))
        sent = reach.select("source", F.col("v").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))
        if cutoff is not None:
            sent = sent.filter(F.col("dist") <= cutoff)
        state, met = log.rows(), []
        if known > WIDE_ROWS and improved * FEW < known:
            sent = settle(sent.groupBy("source", "node").agg(F.min("dist").alias("dist")))
            met, state = [sent], state.join(sent.select("source", "node"), ["source", "node"], "left_semi")
        none = F.lit(None).cast("double")
        both = sent.select("source", "node", F.col("dist").alias("new"), none.alias("old")).unionByName(state.select("source", "node", none.alias("new"), F.col("dist").alias("old")))
        least = both.groupBy("source", "node").agg(F.min("new").alias("new"), F.min("old").alias("old"))
        better = least.filter(F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") < F.col("old"))))
        frontier, improved = _counted(better.select("source", "node", F.col("new").alias("dist")))
        discard(*met)
        if not improved:
            best = log.close()
            paths = _laid(best, slim, sources) if with_path else best
            discard(whole, frontier, *([] if slim is whole else [slim]), *([best] if with_path else []))
            return paths
        log.append(frontier)
        known, done = known + improved, done + 1
        if limit is None and done >= COUNT_FROM:
            limit = whole.select("v").distinct().count() + 1
    raise RuntimeError(f"shortest paths did not settle in {done} rounds")


def _laid(best: DataFrame, slim: DataFrame, sources: DataFrame) -> DataFrame:
    """source, node, dist, path: of the cheapest paths that least costs allow, the lexicographically smallest.

    An edge is on a cheapest path where the least costs of its ends differ by its own. These edges are found once;
    what exceeds the greatest least cost of its node is dropped before the shuffle. Paths are sent along these only.
    """
    furthest = best.groupBy(F.col("node").alias("v")).agg(F.max("dist").alias("furthest"))
    sent = best.withColumnRenamed("node", "u").join(slim.join(furthest, "v"), "u").withColumn("sum", F.col("dist") + F.col("w")).filter("sum <= furthest")
    reached = best.select("source", F.col("node").alias("v"), F.col("dist").alias("least"))
    tight = settle(sent.select("source", "u", "v", "sum").join(reached, ["source", "v"]).filter("sum = least").select("source", "u", "v"))
    frontier, improved = _counted(best.join(sources.select("source", "node").distinct(), ["source", "node"], "left_semi").filter("dist = 0").select("source", "node", F.array("node").alias("path")))
    found = frontier
    while improved:
        sent = frontier.withColumnRenamed("node", "u").join(tight, ["source", "u"]).select("source", F.col("v").alias("node"), F.concat("path", F.array("v")).alias("path"), F.lit(True).alias("new"))
        both = sent.unionByName(found.select("source", "node", "path", F.lit(False).alias("new")))
        least = both.groupBy("source", "node").agg(F.min("path").alias("path"), F.min(F.when(~F.col("new"), F.col("path"))).alias("old"))
        moved = F.col("old").isNull() | (F.col("path") < F.col("old"))
        before, after = found, settle(least.select("source", "node", "path", moved.alias("moved")))
        frontier = after.filter("moved").select("source", "node", "path")
        improved, found = frontier.count(), after.select("source", "node", "path")
        discard(before)
    laid = settle(best.join(found, ["source", "node"]))
    discard(tight, found)
    return laid


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """settle(), and the number of rows as counted by the write itself."""
    seen = Observation()
    written = settle(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return written, seen.get["rows"]


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component: the smallest node of each weakly connected part.

    Alternating stars (Kiveris and others, 2014): a node's larger neighbours move to the smallest node
    around it, then it and its smaller neighbours to the smallest of them. Chains shrink by a factor
    each round, whatever the order of their nodes, so that rounds grow with the logarithm of the number
    of nodes. A hub makes one side of an equi-join skewed whose other side has it once.
    """
    links = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Only the rows of links that lead to a larger node move; their other ends are the nodes they hang on.
        large = links.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        small = large.join(least, "u").select(pairs.alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        before, links = links, settle(small)
        discard(before)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: distinct neighbours, whatever the direction."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
    return both.distinct().groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def _onward(edges: DataFrame, most_turn: float) -> DataFrame:
    """p, c, n and the edge taken: how a walk that came from p goes on through c, where that is a node of degree two."""
    through = degrees(edges).filter("degree = 2").select(F.col("node").alias("c"))
    there = edges.select(F.col("u").alias("p"), F.col("v").alias("c"), F.col("x1").alias("px"), F.col("y1").alias("py"))
    back = edges.select(F.col("v").alias("p"), F.col("u").alias("c"), F.col("x2").alias("px"), F.col("y2").alias("py"))
    ways = there.unionByName(back).distinct().join(through, "c")
    out = edges.select(F.col("u").alias("c"), F.col("v").alias("n"), "k", "x1", "y1", "x2", "y2", "length", "road")
    into, turned = geo.bearing(F.col("px"), F.col("py"), F.col("x1"), F.col("y1")), geo.bearing(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    steps = ways.join(out, "c").filter("n <> p").withColumn("turn", F.round(F.abs(geo.turn_delta(into, turned)), 9))
    best = steps.groupBy("p", "c").agg(F.min(F.struct("turn", "n", "k", "length", "road")).alias("e"))
    return best.filter((F.col("e.turn") <= most_turn) & (F.col("e.length") > 0)).select("p", "c", "e.n", "e.k", "e.length", "e.road")


def _joins(before: Column, after: Column) -> Column:
    """Whether names meet: unnamed stretches go with any."""
    return before.isNull() | after.isNull() | (before == after)


def expand_chains(edges: DataFrame, starts: DataFrame, max_edges: int = 40, max_length: float = 600.0, max_turn: float = 100.0) -> DataFrame:
    """chain, seq, u, v, k, length: each start edge and the road on both sides of it, from one end to the other.

    A walk goes on through nodes of degree two, taking the edge that turns least; it ends at a
    junction, at another road's name, at a turn above max_turn, or where its share of the edges or
    metres is used up: what the start leaves of either is halved between the two directions.

    Walks are found by pointer doubling: stretches of 1, 2, 4 and more steps are joined end to end,
    then each walk takes the longest that fits, so that rounds grow with the logarithm of max_edges.
    edges: u, v, k, length, road, x1, y1, x2, y2; starts: chain and the same key u, v, k.
    """
    ahead, behind = (max_edges - 1) // 2, max_edges - 1 - (max_edges - 1) // 2
    step = F.struct(F.col("c").alias("u"), F.col("n").alias("v"), "k", "length")
    level = _onward(edges, max_turn).filter(F.col("length") <= max_length / 2).select("p", "c", F.col("c").alias("to_p"), F.col("n").alias("to_c"), F.col("length").alias("metres"), F.col("road").alias("first"), F.col("road").alias("last"), F.array(step).alias("path"))
    levels = [settle(level)]
    while 2 ** len(levels) <= behind:
        left, right = levels[-1], levels[-1]
        right = right.select(F.col("p").alias("to_p"), F.col("c").alias("to_c"), F.col("to_p").alias("end_p"), F.col("to_c").alias("end_c"), F.col("metres").alias("more"), F.col("first").alias("next_first"), F.col("last").alias("next_last"), F.col("path").alias("rest"))
        both = left.join(right, ["to_p", "to_c"]).filter(_joins(F.col("last"), F.col("next_first")) & (F.col("metres") + F.col("more") <= max_length / 2))
        levels.append(settle(both.select("p", "c", F.col("end_p").alias("to_p"), F.col("end_c").alias("to_c"), (F.col("metres") + F.col("more")).alias("metres"), F.coalesce("first", "next_first").alias("first"), F.coalesce("next_last", "last").alias("last"), F.concat("path", "rest").alias("path"))))

    begun = settle(starts.select("chain", "u", "v", "k").join(edges.select("u", "v", "k", "length", "road"), ["u", "v", "k"]))
    sides = F.explode(F.array(*[F.struct(F.lit(name).alias("side"), F.col(p).alias("p"), F.col(c).alias("c"), F.lit(n).alias("edges")) for name, p, c, n in (("ahead", "u", "v", ahead), ("behind", "v", "u", behind))]))
    walks = begun.select("chain", "road", ((max_length - F.col("length")) / 2).alias("left"), sides.alias("s")).select("chain", "road", "left", "s.*", F.expr("cast(array() as array<struct<u:bigint,v:bigint,k:int,length:double>>)").alias("walked"))
    for k in range(len(levels) - 1, -1, -1):
        onward = levels[k].select("p", "c", "to_p", "to_c", "metres", "first", "last", "path")
        met = walks.join(onward, ["p", "c"], "left")
        fits = F.col("metres").isNotNull() & (F.col("metres") <= F.col("left")) & (F.col("edges") >= 2**k) & _joins(F.col("road"), F.col("first"))
        pick = lambda new, old: F.when(fits, new).otherwise(old)  # noqa: E731, B023
        walks = settle(met.select("chain", "side", pick(F.coalesce("last", "road"), F.col("road")).alias("road"), pick(F.col("left") - F.col("metres"), F.col("left")).alias("left"), pick(F.col("edges") - 2**k, F.col("edges")).alias("edges"), pick(F.col("to_p"), F.col("p")).alias("p"), pick(F.col("to_c"), F.col("c")).alias("c"), pick(F.concat("walked", "path"), F.col("walked")).alias("walked")))
    discard(*levels)
    behind_rows = walks.filter("side = 'behind'").select("chain", F.col("walked").alias("before"))
    ahead_rows = walks.filter("side = 'ahead'").select("chain", F.col("walked").alias("after"))
    turned = F.transform(F.reverse("before"), lambda e: F.struct(e["v"].alias("u"), e["u"].alias("v"), e["k"].alias("k"), e["length"].alias("length")))
    own = F.array(F.struct(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("k").cast("int").alias("k"), F.col("length").cast("double").alias("length")))
    whole = begun.join(behind_rows, "chain").join(ahead_rows, "chain").select("chain", F.posexplode(F.concat(turned, own, F.col("after"))).alias("seq", "e"))
    return whole.select("chain", "seq", "e.u", "e.v", "e.k", "e.length")


def path_edges(paths: DataFrame, edges: DataFrame, cost: str = "length") -> DataFrame:
    """source, node, seq, u, v, k and the edge's columns along each path; of parallel edges the cheapest."""
    hop = F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("u"), F.expr("slice(path, 2, size(path) - 1)").alias("v"))
    hops = paths.filter("size(path) > 1").select("source", "node", F.posexplode(hop).alias("seq", "hop")).select("source", "node", "seq", "hop.u", "hop.v")
    rest = [c for c in edges.columns if c not in ("u", "v")]
    cheapest = edges.groupBy("u", "v").agg(F.min_by(F.struct(*rest), F.struct(cost, "k")).alias("e")).select("u", "v", "e.*")
    return hops.join(cheapest, ["u", "v"])


#: Nodes to a block of first and of middle ends, in which ways of two edges are closed.
BLOCK = (128, 1024)


def closed_ways(edges: DataFrame) -> DataFrame:
    """u, via, v, first, second, length: ways of two edges whose ends an edge joins, with the three lengths.

    Edges (u, v distinct, with length) go to the blocks of their first and middle ends where such ways can be, as
    often as there are such blocks. In a block, ways are made and closed against tables of its edges as they come:
    the ways themselves are neither shuffled nor sorted. The session is told that rows dealt by block already meet
    in joins by block and node. Nodes whose keys are near should have near neighbours,
    else edges go to many blocks.
    """
    of = lambda c, n: F.floor(F.col(c) / n)
    placed = edges.select("u", "v", "length").withColumns({"bu": of("u", BLOCK[0]), "bm": of("v", BLOCK[1])})
    blocks = settle(placed.select("bu", "bm").distinct())
    parts = min(4096, 4 * blocks.count() + 1)
    edges.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    dealt = lambda df: df.repartition(parts, "bu", "bm")
    begun = dealt(placed.select("bu", "bm", "u", F.col("v").alias("via"), F.col("length").alias("first")))
    onward = dealt(edges.select(of("u", BLOCK[1]).alias("bm"), F.col("u").alias("via"), "v", F.col("length").alias("second")).join(blocks, "bm"))
    direct = dealt(placed.select("bu", "u", "v", "length").join(blocks, "bu"))
    ways = begun.join(onward.hint("shuffle_hash"), ["bu", "bm", "via"]).filter("u <> v")
    return ways.join(direct.hint("shuffle_hash"), ["bu", "bm", "u", "v"]).select("u", "via", "v", "first", "second", "length")


def split_edges(edges: DataFrame, cuts: DataFrame, least: float = 0.1) -> DataFrame:
    """edge, part, from_m, to_m: each edge cut at its distinct measures, none closer than least to another or an end.

    edges: edge, length. cuts: edge, measure. An edge without cuts is one part.
    """
    inside = cuts.join(edges, "edge").filter((F.col("measure") >= least) & (F.col("measure") <= F.col("length") - least))
    ordered = inside.groupBy("edge").agg(F.array_sort(F.collect_set(F.round("measure", 3))).alias("at"))
    keep = F.aggregate(F.coalesce("at", F.array().cast("array<double>")), F.array(F.lit(0.0)), lambda kept, m: F.when(m - F.element_at(kept, -1) >= least, F.concat(kept, F.array(m))).otherwise(kept))
    marks = edges.join(ordered, "edge", "left").withColumn("marks", F.concat(keep, F.array(F.col("length").cast("double"))))
    parts = F.arrays_zip(F.expr("slice(marks, 1, size(marks) - 1)").alias("from_m"), F.expr("slice(marks, 2, size(marks) - 1)").alias("to_m"))
    return marks.select("edge", F.posexplode(parts).alias("part", "p")).select("edge", "part", "p.from_m", "p.to_m")


def both_ways(ways: DataFrame, refs: str = "refs") -> DataFrame:
    """way, seq, u, v in both directions from each way's ordered node references."""
    pairs = F.arrays_zip(F.expr(f"slice({refs}, 1, size({refs}) - 1)").alias("u"), F.expr(f"slice({refs}, 2, size({refs}) - 1)").alias("v"))
    there = ways.filter(F.size(refs) > 1).select("way", F.posexplode(pairs).alias("seq", "p")).select("way", "seq", "p.u", "p.v")
    return there.unionByName(there.select("way", "seq", F.col("v").alias("u"), F.col("u").alias("v")))


def collapse(edges: DataFrame) -> DataFrame:
    """Physical edges: both directions and parallels of one pair of nodes and road as one row."""
    return edges.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "road").agg(
        F.count(F.lit(1)).alias("directed"), F.bool_or(F.col("highway") == "steps").alias("has_steps"), F.min("length").alias("length")
    )


def product(column: Column) -> Column:
    """Product of positive factors as a partial aggregate."""
    return F.exp(F.sum(F.log(column)))
