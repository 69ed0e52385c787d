"""N-gram Jaccard join by signature trees.

Texts become sets of word shingles. Sets that can reach the threshold must share one of the first
few members in a common order, rare members first, so each such member names a bucket of sets. In
every bucket a signature tree is built: a node holds the OR of its sets' token bitmaps, the range
of their sizes and the most that any of them can still share. Two trees are traversed together from
their roots; a pair of nodes is left as soon as its largest possible overlap is less than the
smallest that a link needs. What remains at the leaves is verified on the whole sets.

Only which texts hang together is asked for, so sets already known to be linked need no second
link. A first round verifies a forest of likely links in each bucket. A second one takes the buckets
that still hold sets of different components: it traverses them with wider bitmaps, keeps the sets
that the bounds leave a partner in another component, verifies all pairs of those in place and sends
on a forest of verified links. No link between different texts is lost, and what a task sends on is
in proportion to the sets it was given, never to their pairs.

Large buckets (members that very many texts share) are cut into blocks of sets of like size,
component and sketch. The first round verifies links inside the blocks of one large bucket of each
set. The second builds the upper levels of the tree as tables, a node for each block and for each
sixteen nodes, and descends from the roots level by level with joins; a pair of nodes is left by the
bounds, or when both hold one component only. Texts with equal sets are one class throughout.

Defined results: a null or empty text has an empty set, links to nothing and is its own component;
a text with fewer words than a shingle is one shingle; a null id never names a component unless
there is no other; rows that repeat an id are separate texts; an empty table gives an empty result;
extra columns are carried by keep_documents and ignored elsewhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pathloom.llm.common import WORD, fresh, materialize, shuffle_partitions, table, word_hashes
from pathloom.llm.components import components

WORDS = 5
#: Jaccard threshold, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Shingles whose counts over all documents set the common order: the most frequent so many.
FREQUENT = 65_536
#: A shingle is counted where one batch of documents holds it so often, or in this share of the batch.
COUNTED, COUNTED_SHARE = 3, 1 / 256
#: Buckets of more sets than this are cut into blocks of about BLOCK sets.
SMALL, BLOCK = 512, 256
#: Documents whose sets a worker holds at a time.
TOGETHER = 512
#: Sets in a leaf, and children of an inner node.
LEAF, FANOUT = 8, 8
#: Children of a node above the blocks of a large bucket, as bits of the block's number.
UPPER_BITS = 4
#: Bits of a signature for each member of a set, in the first round and after it, and the least width.
BITS_EACH, WIDE, LEAST_BITS = 2, 8, 256
#: Members whose overlaps are counted at a time.
COUNT_AT_ONCE = 16_384

_u = np.uint64
_WEIGHTS = [_u(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_hash = xxhash.xxh3_64_intdigest


# ---- sets -------------------------------------------------------------------------------------


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([_hash(b" ".join(words), 1)], np.uint64)
    each = word_hashes(words)
    n = len(each) - WORDS + 1
    out = sum(each[k : n + k] * _WEIGHTS[k] for k in range(WORDS))
    out = (out ^ (out >> _u(29))) * _WEIGHTS[1]
    return np.unique(out ^ (out >> _u(32)))


def class_of(members: np.ndarray) -> int:
    """Names the class of texts with this set, together with its size."""
    return _hash(members.tobytes()) - 2**63


def least_shared(n: int | np.ndarray) -> int | np.ndarray:
    """Members of a set of n that any set linked to it must share."""
    return (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR


def signature(members: np.ndarray, each: int = BITS_EACH) -> np.ndarray:
    """Token bitmap; its width is a power of two, about so many bits for each member."""
    width = max(LEAST_BITS, 1 << int(each * len(members) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(members >> _u(7)) & _u(width - 1)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def sketch(members: np.ndarray) -> int:
    """Sets with many common members mostly have the same, or nearly: four least hashes, 16 bits of each."""
    least = (np.array([(members * w).min() for w in _WEIGHTS[:4]]) * _WEIGHTS[4] >> _u(48)).tolist()
    return least[0] << 47 | least[1] << 31 | least[2] << 15 | least[3] >> 1


def folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    while bitmaps.shape[-1] > words:
        half = bitmaps.shape[-1] // 2
        bitmaps = bitmaps[..., :half] | bitmaps[..., half:]
    return bitmaps


# ---- trees ------------------------------------------------------------------------------------


class Tree:
    """Sets of one signature width, in order of size. Level 0 has a node for each set."""

    def __init__(self, size: np.ndarray, rest: np.ndarray, bitmaps: np.ndarray, owner: np.ndarray):
        spare = size - np.bitwise_count(bitmaps).sum(1)
        self.owner = owner
        self.levels = [(size, size, rest, spare, bitmaps)]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            lo, hi, most, extra, union = self.levels[-1]
            starts = np.arange(0, len(lo), width)
            self.levels.append((np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts), np.maximum.reduceat(most, starts), np.maximum.reduceat(extra, starts), np.bitwise_or.reduceat(union, starts, axis=0)))
            width = FANOUT

    def children(self, level: int, node: np.ndarray) -> list[np.ndarray]:
        width = LEAF if level == 1 else FANOUT
        n = len(self.levels[level - 1][0])
        return [np.arange(k * width, min(n, (k + 1) * width)) for k in node]


def bounds(a, i: np.ndarray, b, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether nodes i and j can hold a linked pair, by sizes and largest possible overlap; and that overlap."""
    lo_a, hi_a, most_a, extra_a, bits_a = (x[i] for x in a)
    lo_b, hi_b, most_b, extra_b, bits_b = (x[j] for x in b)
    fits = (DENOMINATOR * hi_a >= NUMERATOR * lo_b) & (DENOMINATOR * hi_b >= NUMERATOR * lo_a)
    words = min(bits_a.shape[1], bits_b.shape[1])
    # A narrower bitmap has fewer bits: members spare beyond bits count again after folding.
    fold_a, fold_b = folded(bits_a, words), folded(bits_b, words)
    both = np.bitwise_count(fold_a & fold_b).sum(1)
    lost_a = np.bitwise_count(bits_a).sum(1) - np.bitwise_count(fold_a).sum(1) if bits_a.shape[1] > words else 0
    lost_b = np.bitwise_count(bits_b).sum(1) - np.bitwise_count(fold_b).sum(1) if bits_b.shape[1] > words else 0
    overlap = np.minimum(np.minimum(most_a, most_b), np.minimum(extra_a + lost_a, extra_b + lost_b) + both)
    return fits & ((NUMERATOR + DENOMINATOR) * overlap >= NUMERATOR * (lo_a + lo_b)), overlap


def dual_traversal(a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sets (places in a and b) that the bounds allow, and their largest overlaps; a place pair once where a is b."""
    same = a is b
    top = (len(a.levels) - 1, len(b.levels) - 1)
    i, j, la, lb = np.zeros(1, np.int64), np.zeros(1, np.int64), *top
    while True:
        keep, overlap = bounds(a.levels[la], i, b.levels[lb], j)
        i, j = i[keep], j[keep]
        if not len(i) or (la == 0 and lb == 0):
            return i, j, overlap[keep]
        down_a, down_b = la > 0 and la >= lb, lb > 0 and lb >= la
        kids_a = a.children(la, i) if down_a else [np.array([x]) for x in i]
        kids_b = b.children(lb, j) if down_b else [np.array([x]) for x in j]
        i = np.concatenate([np.repeat(x, len(y)) for x, y in zip(kids_a, kids_b)])
        j = np.concatenate([np.tile(y, len(x)) for x, y in zip(kids_a, kids_b)])
        la, lb = la - down_a, lb - down_b
        if same:
            ordered = i < j if la == 0 else i <= j
            i, j = i[ordered], j[ordered]


def forest(size: np.ndarray, rest: np.ndarray, bitmaps: list[np.ndarray], owner: np.ndarray) -> list[Tree]:
    """One tree for each signature width; owner is carried along in the trees' order."""
    words = np.array([len(b) for b in bitmaps])
    out = []
    for w in np.unique(words):
        at = np.flatnonzero(words == w)
        at = at[np.argsort(size[at], kind="stable")]
        out.append(Tree(size[at], rest[at], np.stack([bitmaps[k] for k in at]), owner[at]))
    return out


def candidate_pairs(size, rest, bitmaps, component, side=None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sets that may be linked and are of different components, the likeliest pairs first.

    side: where given, only pairs between the two sides, or within side 0 if that is the only one.
    """
    trees = forest(size, rest, bitmaps, np.arange(len(size)))
    found = [(a.owner[i], b.owner[j], overlap) for x, a in enumerate(trees) for b in trees[x:] for i, j, overlap in [dual_traversal(a, b)]]
    i, j, overlap = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    keep = component[i] != component[j]
    if side is not None and len(np.unique(side)) > 1:
        keep &= side[i] != side[j]
    i, j, overlap = i[keep], j[keep], overlap[keep]
    first = np.argsort(-overlap / (size[i] + size[j]), kind="stable")
    return i[first], j[first]


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common members of the sets at each pair of places, counted over a stretch of members at a time."""
    where = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    members, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Members of one set only are in no overlap; the rest are numbered anew.
    number = np.cumsum(times > 1) - 1
    shared = times[at] > 1
    where, at = where[shared], number[at[shared]]
    order = np.argsort(at, kind="stable")
    where, at = where[order], at[order]
    both, n = np.zeros(len(i), np.int64), int(number[-1]) + 1
    width = min(COUNT_AT_ONCE, -(-n // 64) * 64)
    for lo in range(0, n, COUNT_AT_ONCE):
        a, b = np.searchsorted(at, [lo, lo + COUNT_AT_ONCE])
        has = np.zeros((len(sets), width), bool)
        has[where[a:b], at[a:b] - lo] = True
        bits = np.packbits(has, axis=1).view(np.uint64)
        for k in range(0, len(i), COUNT_AT_ONCE):
            x, y = i[k : k + COUNT_AT_ONCE], j[k : k + COUNT_AT_ONCE]
            both[k : k + COUNT_AT_ONCE] += np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64)
    return both


def spanning(i: np.ndarray, j: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """A forest among the pairs, as places in them: those that join two trees of what came before. Equal labels are one tree."""
    parent = {x: x for x in labels.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(labels[i].tolist(), labels[j].tolist())):
        if (p := root(x)) != (q := root(y)):
            parent[p] = q
            kept.append(k)
    return np.array(kept, np.int64)


# ---- Spark stages -----------------------------------------------------------------------------


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """So many documents at a time: what a worker holds does not depend on the session's batch size."""
    for batch in batches:
        for start in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(start, TOGETHER)


def describe(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per document: doc_id, set size, class. And counts of the shingles that many documents share."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [shingles(t.as_py()) for t in batch.column("text")]
            n, classes = [len(s) for s in rows], [class_of(s) for s in rows]
            # Texts with one set count once in a batch.
            distinct = {c: s for c, s in zip(classes, rows)}
            token, count = np.unique(np.concatenate([*distinct.values(), np.zeros(0, np.uint64)]), return_counts=True)
            often = count >= max(COUNTED, COUNTED_SHARE * len(distinct))
            token, count = token[often].view(np.int64), count[often]
            none_rows, none_tokens = pa.nulls(len(rows), pa.int64()), len(token)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column("doc_id").cast(pa.int64()), pa.nulls(none_tokens, pa.int64())]),
                    pa.array([*n, *[None] * none_tokens], pa.int64()),
                    pa.array([*classes, *[None] * none_tokens], pa.int64()),
                    pa.concat_arrays([none_rows, pa.array(token, pa.int64())]),
                    pa.concat_arrays([none_rows, pa.array(count, pa.int64())]),
                ],
                names=["doc_id", "n", "class", "token", "times"],
            )

    both = materialize(docs.select("doc_id", "text").mapInArrow(sets, "doc_id bigint, n bigint, class bigint, token bigint, times bigint"), "shingle-sets")
    frequent = both.filter("token is not null").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(FREQUENT)
    return both.filter("n is not null").select("doc_id", "n", "class"), frequent


def keyed(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """Rows (large, key, class, size, rest) for the leading members of each set.

    large: the key is so frequent that it is a bucket in blocks from the start, never one group.
    rest: how many members stand at or behind the key in the common order.
    The table of frequent members goes out with the function; it has FREQUENT rows at most.
    """
    counts = sorted((r["token"], r["times"]) for r in frequent.collect())
    known = np.array([t for t, _ in counts], np.int64)
    order = np.argsort(known.view(np.uint64))
    known, times = known.view(np.uint64)[order], np.array([c for _, c in counts], np.int64)[order]

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in sliced(batches):
            if len(seen) > 1_000_000:
                seen.clear()
            parts = []
            for text in batch.column("text"):
                members = shingles(text.as_py())
                n = len(members)
                mine = (class_of(members), n)
                if not n or mine in seen:
                    continue
                seen.add(mine)
                count = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, members), len(known) - 1)
                    count = np.where(known[at] == members, times[at], 0)
                first = np.lexsort((members, count))[: n - least_shared(n) + 1]
                parts.append((count[first] > SMALL, members[first], np.full(len(first), mine[0]), np.full(len(first), n), n - np.arange(len(first))))
            if parts:
                large, key, name, size, rest = (np.concatenate(c) for c in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(large), pa.array(key.view(np.int64)), pa.array(name, pa.int64()), pa.array(size, pa.int64()), pa.array(rest, pa.int64())], names=["large", "key", "class", "size", "rest"])

    return docs.select("text").mapInArrow(lead, "large boolean, key bigint, class bigint, size bigint, rest bigint")


def may_link(size_a, rest_a, size_b, rest_b):
    """Whether sets of these sizes, with so many members at or behind a shared key, can be linked."""
    sizes = (DENOMINATOR * size_a >= NUMERATOR * size_b) & (DENOMINATOR * size_b >= NUMERATOR * size_a)
    return sizes & ((NUMERATOR + DENOMINATOR) * np.minimum(rest_a, rest_b) >= NUMERATOR * (size_a + size_b))


def pair_buckets(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of two: rows (key, class, size, rest) that may link, equal pairs merged."""
    good = (a[:, 1] != b[:, 1]) & may_link(a[:, 2], a[:, 3], b[:, 2], b[:, 3])
    a, b = a[good], b[good]
    swap = a[:, 1] > b[:, 1]
    a[swap], b[swap] = b[swap], a[swap]
    order = np.lexsort((b[:, 2], a[:, 2], b[:, 1], a[:, 1]))
    a, b = a[order], b[order]
    if not len(a):
        return np.zeros(0, np.int64), a
    new = np.r_[True, ((a[1:, 1:3] != a[:-1, 1:3]) | (b[1:, 1:3] != b[:-1, 1:3])).any(1)]
    starts = np.flatnonzero(new)
    for rows in (a, b):
        rows[starts, 3] = np.maximum.reduceat(rows[:, 3], starts)
    a, b = a[starts], b[starts]
    bucket = (a[:, 1].view(np.uint64) * _WEIGHTS[0] ^ (b[:, 1].view(np.uint64) * _WEIGHTS[1] >> _u(1))).view(np.int64)
    return np.concatenate([bucket, bucket]), np.concatenate([a, b])


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted key rows to bucket rows: sets that can link to no other of their key go, keys with equal classes merge.

    Rows of large keys, and of a key that turns out to have more than SMALL rows, are passed on as they come.
    """
    names = ["large", "bucket", "class", "size", "rest"]
    held: list[np.ndarray] = []
    streaming = None

    def out(large: bool, bucket, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), large)), pa.array(bucket, pa.int64()), *[pa.array(rows[:, k]) for k in (1, 2, 3)]], names=names)

    def close(rows: np.ndarray) -> list[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        ends = np.r_[starts[1:], len(rows)]
        pairs = starts[ends - starts == 2]
        bucket, kept = pair_buckets(rows[pairs], rows[pairs + 1])
        done: dict[bytes, np.ndarray] = {}
        result = [out(False, bucket, kept)] if len(kept) else []
        for lo, hi in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
            group = rows[lo:hi]
            if hi - lo > SMALL:
                result.append(out(True, group[:, 0], group))
                continue
            group = group[np.lexsort((-group[:, 3], group[:, 2], group[:, 1]))]
            group = group[np.r_[True, (group[1:, 1:3] != group[:-1, 1:3]).any(1)]]
            size, rest = group[:, 2], group[:, 3]
            links = may_link(size[:, None], rest[:, None], size, rest)
            np.fill_diagonal(links, False)
            group = group[links.any(1)]
            if len(group) < 2:
                continue
            name = group[:, 1].tobytes()
            if name in done:
                done[name][:, 3] = np.maximum(done[name][:, 3], group[:, 3])
            else:
                done[name] = group.copy()
        if done:
            ids = [np.full(len(group), _hash(name) - 2**63) for name, group in done.items()]
            result.append(out(False, np.concatenate(ids), np.concatenate(list(done.values()))))
        return result

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy() for c in ("key", "class", "size", "rest")], axis=1)
        large = batch.column("large").to_numpy(zero_copy_only=False)
        if large.any():
            yield out(True, rows[large, 0], rows[large])
            rows = rows[~large]
        if streaming is not None and len(rows):
            other = rows[:, 0] != streaming
            run = int(np.argmax(other)) if other.any() else len(rows)
            if run:
                yield out(True, rows[:run, 0], rows[:run])
            rows = rows[run:]
            streaming = streaming if not len(rows) else None
        if not len(rows):
            continue
        held.append(rows)
        whole = np.concatenate(held)
        last = int(np.argmax(whole[:, 0] == whole[-1, 0]))
        if last:
            yield from close(whole[:last])
        held = [whole[last:]]
        if len(held[0]) > SMALL:
            streaming = held[0][0, 0]
            yield out(True, held[0][:, 0], held[0])
            held = []
    if held:
        yield from close(np.concatenate(held))


def buckets(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """large, bucket, class, size, rest: each class once in each bucket."""
    spark = docs.sparkSession
    spread = F.when(F.col("large"), F.col("class")).otherwise(0)
    rows = keyed(docs, frequent).repartition(shuffle_partitions(spark), "key", spread).sortWithinPartitions("key")
    found = rows.mapInArrow(gather, "large boolean, bucket bigint, class bigint, size bigint, rest bigint")
    return materialize(found.groupBy("large", "bucket", "class", "size").agg(F.max("rest").alias("rest")), "buckets")


def irregular(sets: DataFrame) -> bool:
    """Whether an id is null or names several rows, so that ids alone do not find a text."""
    return not sets.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty()


def members_of(docs: DataFrame, sets: DataFrame, needed: DataFrame, by_class: bool) -> str:
    """The table of class, size, members, bitmap, sketch of the classes needed: from one document of each.

    by_class: ids repeat or are null. A class without any id is then sought in all rows without one,
    and what a repeated id brings in beside the class sought, or twice, is dropped.
    """
    needed = needed.select("class", "size").distinct()
    first = sets.filter("n > 0").join(needed.withColumnRenamed("size", "n"), ["class", "n"]).groupBy("class", "n").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [s for s in (shingles(t.as_py()) for t in batch.column("text")) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in rows], pa.int64()), pa.array([len(s) for s in rows], pa.int64()), pa.array([s.tobytes() for s in rows], pa.binary()), pa.array([signature(s).tobytes() for s in rows], pa.binary()), pa.array([sketch(s) for s in rows], pa.int64())], names=["class", "size", "members", "bitmap", "sketch"])

    texts = docs.select("doc_id", "text").hint("merge").join(first, "doc_id", "left_semi")
    if by_class:
        texts = texts.unionByName(docs.select("doc_id", "text").filter("doc_id is null"))
    found = texts.mapInArrow(build, "class bigint, size bigint, members binary, bitmap binary, sketch bigint")
    if by_class:
        found = found.join(needed, ["class", "size"], "left_semi").dropDuplicates(["class", "size"])
    # Several joins by class and size follow: bucketed by both, the sets are moved once.
    spark, name = docs.sparkSession, f"members_{uuid.uuid4().hex[:12]}"
    parts = shuffle_partitions(spark)
    found.repartition(parts, "class", "size").write.format("parquet").bucketBy(parts, "class", "size").sortBy("class", "size").saveAsTable(name)
    return name


def by_group(work, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """work(group's rows) for each group of rows sorted by group; None is left out."""

    def close(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        group = rows.column("group").to_numpy()
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
        for lo, hi in zip(starts, [*starts[1:], len(group)]):
            if hi - lo > 1 and (found := work(rows.slice(lo, hi - lo))) is not None:
                yield found

    def merged(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := list(found):
            yield from pa.Table.from_batches(found).combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        whole = pa.Table.from_batches(held)
        group = whole.column("group").to_numpy()
        last = int(np.argmax(group == group[-1])) if len(group) else 0
        if last:
            yield from merged(close(whole.slice(0, last)))
            held = whole.slice(last).to_batches()
    if held:
        yield from merged(close(pa.Table.from_batches(held)))


PAIRS = "a bigint, size_a bigint, b bigint, size_b bigint"


def pairs_of(name: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch | None:
    if not len(i):
        return None
    rows = np.stack([name[i], size[i], name[j], size[j]], axis=1)
    swap = rows[:, 0] > rows[:, 2]
    rows[swap] = rows[swap][:, [2, 3, 0, 1]]
    return pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(4)], names=["a", "size_a", "b", "size_b"])


def numbers(rows: pa.Table, *columns: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy() for c in columns]


def likely(rows: pa.Table) -> pa.RecordBatch | None:
    """A forest of the likeliest pairs of a group's sets."""
    name, size, rest = numbers(rows, "class", "size", "rest")
    maps = [np.frombuffer(b.as_buffer(), np.uint64) for b in rows.column("bitmap")]
    places = np.arange(len(name))
    i, j = candidate_pairs(size, rest, maps, places)
    kept = spanning(i, j, places)
    return pairs_of(name, size, i[kept], j[kept])


def undecided(rows: pa.Table) -> pa.RecordBatch | None:
    """The sets of a group that the bounds leave a partner in another component."""
    size, rest, component, side = numbers(rows, "size", "rest", "component", "side")
    i, j = candidate_pairs(size, rest, [np.frombuffer(b.as_buffer(), np.uint64) for b in rows.column("bitmap")], component, side)
    if not len(i):
        return None
    return rows.select(["group", "class", "size", "rest", "component", "side"]).take(pa.array(np.union1d(i, j))).combine_chunks().to_batches()[0]


def certain(rows: pa.Table) -> pa.RecordBatch | None:
    """Links between components of a group's sets: traversed once more, verified on the whole sets, a forest of them."""
    name, size, rest, component, side = numbers(rows, "class", "size", "rest", "component", "side")
    sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in rows.column("members")]
    i, j = candidate_pairs(size, rest, [signature(s, WIDE) for s in sets], component, side)
    if not len(i):
        return None
    both = overlaps(sets, i, j)
    linked = DENOMINATOR * both >= NUMERATOR * (size[i] + size[j] - both)
    i, j = i[linked], j[linked]
    kept = spanning(i, j, component)
    return pairs_of(name, size, i[kept], j[kept])


UNDECIDED = "group bigint, class bigint, size bigint, rest bigint, component bigint, side int"


def dealt(rows: DataFrame, work, schema: str, payload: str) -> DataFrame:
    """work over each group of rows (group, class, size, rest, component, side, and the payload), a group in a task."""
    placed = rows.select("group", "class", "size", "rest", "component", F.col("side").cast("int").alias("side"), payload)
    placed = placed.repartition(shuffle_partitions(rows.sparkSession), "group").sortWithinPartitions("group", "side", "class", "size")
    return placed.mapInArrow(lambda batches: by_group(work, batches), schema)


def verified(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Links of groups of rows without a payload."""
    whole = rows.hint("merge").join(members.select("class", "size", "members"), ["class", "size"])
    return dealt(whole, certain, PAIRS, "members")


def verify(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("members_a"), batch.column("members_b")):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(DENOMINATOR * shared >= NUMERATOR * (len(a) + len(b) - shared))
            yield batch.select(["a", "size_a", "b", "size_b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: members.select(F.col("class").alias(s), F.col("size").alias(f"size_{s}"), F.col("members").alias(f"members_{s}"))
    full = pairs.distinct().hint("merge").join(side("a"), ["a", "size_a"]).hint("merge").join(side("b"), ["b", "size_b"])
    return full.select("a", "size_a", "b", "size_b", "members_a", "members_b").mapInArrow(exact, PAIRS)


def widened(members: DataFrame, needed: DataFrame) -> DataFrame:
    """class, size, bitmap: wide bitmaps of the classes needed."""

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            maps = pa.array([signature(np.frombuffer(b.as_buffer(), np.uint64), WIDE).tobytes() for b in batch.column("members")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("size"), maps], names=["class", "size", "bitmap"])

    found = members.select("class", "size", "members").hint("merge").join(needed.select("class", "size").distinct(), ["class", "size"], "left_semi")
    return materialize(found.mapInArrow(wide, "class bigint, size bigint, bitmap binary"), "wide-bitmaps")


def mixed(rows: DataFrame) -> DataFrame:
    """Buckets that hold more than one component."""
    return rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows (bucket, class, size, rest, component, own, sketch) with block: their number within the bucket, from 0.

    Blocks are runs of at most BLOCK rows in order of own, size band and sketch, of one own each. The
    order is made by a range sort, so a bucket is spread over tasks; the numbers of each task's runs
    are added up afterwards.
    """
    # Sets whose bands are two apart cannot be linked.
    band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(DENOMINATOR / NUMERATOR))).cast("int")
    order = ["bucket", "own", "band", "sketch", "class", "size"]
    columns = ["bucket", "class", "size", "rest", "component"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        bucket = own = None
        block = held = 0
        for batch in batches:
            each = np.zeros(batch.num_rows, np.int64)
            keys = np.stack(numbers(pa.Table.from_batches([batch]), "bucket", "own"), axis=1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
            for lo, hi in zip(starts, [*starts[1:], len(keys)]):
                if bucket != keys[lo, 0]:
                    bucket, own, block, held = keys[lo, 0], keys[lo, 1], 0, 0
                elif own != keys[lo, 1]:
                    own, block, held = keys[lo, 1], block + (held > 0), 0
                places = held + np.arange(hi - lo)
                each[lo:hi] = block + places // BLOCK
                block, held = block + (held + hi - lo) // BLOCK, (held + hi - lo) % BLOCK
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(np.full(len(each), part), pa.int64()), pa.array(each)], names=[*columns, "part", "seq"])

    placed = rows.withColumn("band", band).repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = materialize(placed.select(*columns, "own").mapInArrow(number, ", ".join(f"{c} bigint" for c in [*columns, "part", "seq"])), "sequences")
    runs = placed.groupBy("bucket", "part").agg((F.max("seq") + 1).alias("runs"))
    before = runs.withColumn("before", F.sum("runs").over(Window.partitionBy("bucket").orderBy("part")) - F.col("runs")).drop("runs")
    return placed.hint("merge").join(before, ["bucket", "part"]).withColumn("block", F.col("before") + F.col("seq")).drop("part", "seq", "before")


NODE = ["lo", "hi", "rest", "spare", "first", "last"]


def upper_nodes(rows: DataFrame) -> DataFrame:
    """bucket, node, words (of the bitmap), what NODE names, bits: rows merged by bucket, node and width.

    lo, hi: range of sizes; rest: the most left to share; spare: the most members beyond bits; first,
    last: range of components.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        now = None

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                columns = list(zip(*held.values()))
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(held), pa.int64()), pa.array([now[1]] * len(held), pa.int64()), pa.array(list(held), pa.int64()), *[pa.array(c, pa.int64()) for c in columns[:6]], pa.array([b.tobytes() for b in columns[6]], pa.binary())], names=["bucket", "node", "words", *NODE, "bits"])

        for batch in batches:
            for bucket, node, lo, hi, rest, spare, first, last, bits in zip(*(batch.column(c).to_pylist() for c in ("bucket", "node", *NODE, "bits"))):
                if now != (bucket, node):
                    yield from out()
                    held, now = {}, (bucket, node)
                bits = np.frombuffer(bits, np.uint64)
                have = held.get(len(bits))
                if have is None:
                    held[len(bits)] = [lo, hi, rest, spare, first, last, bits.copy()]
                else:
                    have[:6] = min(have[0], lo), max(have[1], hi), max(have[2], rest), max(have[3], spare), min(have[4], first), max(have[5], last)
                    have[6] |= bits
        yield from out()

    parts = shuffle_partitions(rows.sparkSession)
    schema = ", ".join(f"{c} bigint" for c in ["bucket", "node", "words", *NODE]) + ", bits binary"
    placed = rows.select("bucket", "node", *NODE, "bits").repartition(parts, "bucket", "node").sortWithinPartitions("bucket", "node")
    return materialize(placed.mapInArrow(merge, schema), "nodes")


def with_spare(rows: DataFrame) -> DataFrame:
    """Rows of sets with a bitmap as the lowest nodes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [int(np.bitwise_count(np.frombuffer(b.as_buffer(), np.uint64)).sum()) for b in batch.column("bits")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits, pa.int64())], names=[*batch.schema.names, "ones"])

    rows = rows.select("bucket", F.col("block").alias("node"), F.col("size").alias("lo"), F.col("size").alias("hi"), "rest", F.col("component").alias("first"), F.col("component").alias("last"), F.col("bitmap").alias("bits"))
    counted = rows.mapInArrow(count, StructType([*rows.schema.fields, StructField("ones", LongType())]))
    return counted.withColumn("spare", F.col("lo") - F.col("ones"))


def block_pairs(levels: list[DataFrame]) -> DataFrame:
    """bucket, a, b: blocks that may hold links between components, found from the roots of each bucket down."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in batch.to_pylist():
                x, y = (tuple(np.array([row[f"{c}_{s}"]]) for c in NODE[:4]) + (np.frombuffer(row[f"bits_{s}"], np.uint64)[None],) for s in "ab")
                keep.append(bool(bounds(x, np.zeros(1, int), y, np.zeros(1, int))[0][0]))
            yield batch.select(["bucket", "node_a", "words_a", "node_b", "words_b"]).filter(pa.array(keep, pa.bool_()))

    fits = (DENOMINATOR * F.col("hi_a") >= NUMERATOR * F.col("lo_b")) & (DENOMINATOR * F.col("hi_b") >= NUMERATOR * F.col("lo_a"))
    apart = F.least("first_a", "first_b") < F.greatest("last_a", "last_b")
    pairs = None
    for level in reversed(levels):
        side = lambda s: level.select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in level.columns if c != "bucket"])  # noqa: B023, E731
        if pairs is None:
            found = side("a").join(side("b"), "bucket").filter("words_a <= words_b")  # roots: one for each bucket and width
        else:
            up = lambda s: [F.shiftright(f"node_{s}", UPPER_BITS).alias(f"up_{s}"), F.col(f"words_{s}").alias(f"of_{s}")]
            above = pairs.select("bucket", *[F.col(f"{c}_{s}").alias(f"{n}_{s}") for s in "ab" for c, n in (("node", "up"), ("words", "of"))])
            found = above.join(side("a").select("*", *up("a")), ["bucket", "up_a", "of_a"]).join(side("b").select("*", *up("b")), ["bucket", "up_b", "of_b"])
            found = found.filter("up_a <> up_b or of_a <> of_b or node_a <= node_b")  # a node with itself: each pair of children once
        found = found.filter(fits & apart)
        schema = "bucket bigint, node_a bigint, words_a bigint, node_b bigint, words_b bigint"
        columns = ["bucket", *[f"{c}_{s}" for s in "ab" for c in ("node", "words", *NODE, "bits")]]
        pairs = materialize(found.select(columns).mapInArrow(prune, schema), "node-pairs")
    return pairs.select("bucket", F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def blocks_apart(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of large buckets with wide bitmaps, grouped by the pairs of blocks that may hold links between components.

    A component with many sets in a bucket has blocks of its own, which are never compared with each other.
    """
    here = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("here")).filter(F.col("here") >= BLOCK // 2).select("bucket", "component", F.col("component").alias("own"))
    wide = widened(members, rows)
    sketched = rows.join(here, ["bucket", "component"], "left").withColumn("own", F.coalesce("own", F.lit(0))).join(members.select("class", "size", "sketch"), ["class", "size"])
    blocks = materialize(in_blocks(sketched), "blocks")
    levels = [upper_nodes(with_spare(blocks.join(wide, ["class", "size"])))]
    last = blocks.agg(F.max("block")).first()[0] or 0
    while last:
        last >>= UPPER_BITS
        levels.append(upper_nodes(levels[-1].withColumn("node", F.shiftright("node", UPPER_BITS))))
    group = F.xxhash64("bucket", "a", "b").alias("group")
    sides = F.expr("IF(a = b, array(named_struct('block', a, 'side', 0)), array(named_struct('block', a, 'side', 0), named_struct('block', b, 'side', 1)))")
    to = block_pairs(levels).select(group, "bucket", F.explode(sides).alias("to")).select("group", "bucket", "to.block", "to.side")
    return blocks.join(to, ["bucket", "block"]).join(wide, ["class", "size"])


def large_links(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Links inside blocks of large buckets: each set in one of its buckets, the largest, dealt by sketch and by hash."""
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("here"))
    chosen = rows.join(counts, "bucket").groupBy("class", "size").agg(F.max_by(F.struct("bucket", "rest", "here"), F.struct("here", "bucket")).alias("in")).select("class", "size", "in.*")
    chosen = materialize(chosen.join(members.select("class", "size", "sketch"), ["class", "size"]).withColumns({"component": F.col("class"), "own": F.lit(0).cast("bigint")}), "largest-buckets")
    by_sketch = in_blocks(chosen).withColumn("group", F.xxhash64("bucket", "block"))
    by_hash = chosen.withColumn("group", F.xxhash64("bucket", F.lit("hash"), F.pmod(F.xxhash64("class", "size"), F.ceil(F.col("here") / BLOCK))))
    columns = ["group", "class", "size", "rest", "component", F.lit(0).alias("side")]
    return verified(by_sketch.select(columns).unionByName(by_hash.select(columns)), members)


def find_links(docs: DataFrame, sets: DataFrame, frequent: DataFrame, by_class: bool) -> DataFrame:
    """Verified links (a, size_a, b, size_b) between classes, enough to connect all that are linked."""
    rows = buckets(docs, frequent)
    stored = members_of(docs, sets, rows, by_class)
    members = docs.sparkSession.table(stored)
    any_large = not rows.filter("large").isEmpty()
    # First round: every set is its own component; a forest of likely links in each bucket.
    first = rows.filter("not large").withColumn("group", F.col("bucket")).hint("merge").join(members.select("class", "size", "bitmap"), ["class", "size"])
    first = first.withColumns({"component": F.col("class"), "side": F.lit(0)})
    links = materialize(verify(materialize(dealt(first, likely, PAIRS, "bitmap"), "likely-pairs"), members), "links")
    if any_large:
        links = links.unionByName(materialize(large_links(rows.filter("large"), members), "large-links"))
    # Second round: what is left between different components.
    known = components(links.select("a", "b"))
    labelled = rows.join(known.withColumnsRenamed({"node": "class", "root": "component"}), "class", "left").withColumn("component", F.coalesce("component", "class"))
    labelled = materialize(labelled, "labelled")
    apart = labelled.hint("merge").join(mixed(labelled), "bucket", "left_semi")
    small = materialize(apart.filter("not large").select(F.col("bucket").alias("group"), "class", "size", "rest", "component", F.lit(0).alias("side")), "small-apart")
    left = dealt(small.join(widened(members, small), ["class", "size"]), undecided, UNDECIDED, "bitmap")
    if any_large:
        large = materialize(apart.filter("large").drop("large"), "large-apart")
        left = left.unionByName(dealt(blocks_apart(large, members), undecided, UNDECIDED, "bitmap"))
    links = links.unionByName(materialize(verified(materialize(left, "undecided"), members), "more-links"))
    docs.sparkSession.sql(f"DROP TABLE {stored}")
    return links


def place(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Rows (doc_id, n, class) of the documents; class, n, first, component, stays of each class of non-empty sets; irregular().

    first: the class's smallest id. component: the smallest id of its group. stays: whether it is the
    class that names the group. Groups are made of classes, so rows that share an id stay apart.
    """
    sets, frequent = describe(docs)
    by_class = irregular(sets)
    links = find_links(docs, sets, frequent, by_class)
    # A class goes by its smallest id, then by itself, so that roots hold the ids asked for; one without ids comes last.
    node = F.struct(F.col("first").isNull().cast("int").alias("none"), F.coalesce("first", F.lit(0)).alias("first"), "class", "n")
    firsts = materialize(sets.filter("n > 0").groupBy("class", "n").agg(F.min("doc_id").alias("first")).withColumn("node", node), "classes")
    named = lambda s: firsts.select(F.col("class").alias(s), F.col("n").alias(f"size_{s}"), F.col("node").alias(f"node_{s}"))
    between = links.join(named("a"), ["a", "size_a"]).join(named("b"), ["b", "size_b"]).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    roots = components(between)
    placed = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = placed.select("class", "n", "first", F.when(F.col("root.none") == 0, F.col("root.first")).alias("component"), (F.col("root") == F.col("node")).alias("stays"))
    return sets, materialize(placed, "class-roots"), by_class


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    sets, placed, _ = place(docs)
    return sets.hint("merge").join(placed, ["class", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def with_class(docs: DataFrame, name: str, n: str) -> DataFrame:
    """docs with the class and set size of each text."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [shingles(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([class_of(s) for s in rows], pa.int64()), pa.array([len(s) for s in rows], pa.int64())], names=[*batch.schema.names, name, n])

    return docs.mapInArrow(add, StructType([*docs.schema.fields, StructField(name, LongType()), StructField(n, LongType())]))


def keep_documents(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, with all columns.

    Texts with empty sets all stay. Where several rows have the smallest id and one set, one of them stays.
    """
    sets, placed, by_class = place(docs)
    kept_id, name, n = fresh(docs, "kept_id", "class", "n")
    kept = placed.filter("stays").select(F.col("first").alias(kept_id), F.col("class").alias(name), F.col("n").alias(n))
    if not by_class:
        ids = materialize(kept.select(kept_id).unionByName(sets.filter("n = 0").select(F.col("doc_id").alias(kept_id))), "kept-ids")
        return docs.hint("merge").join(ids, F.col("doc_id") == F.col(kept_id)).select(docs.columns)
    # Ids alone do not tell the rows apart: the set is part of the key.
    on = (F.col(f"d.{name}") == F.col(f"k.{name}")) & (F.col(f"d.{n}") == F.col(f"k.{n}")) & F.col("d.doc_id").eqNullSafe(F.col(f"k.{kept_id}"))
    chosen = with_class(docs.filter(F.coalesce("text", F.lit("")).rlike(WORD)), name, n).alias("d").join(kept.alias("k"), on, "left_semi")
    return chosen.dropDuplicates([name, n]).select(docs.columns).unionByName(docs.filter(~F.coalesce("text", F.lit("")).rlike(WORD)))


def op4_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"))


SQL = {
    "op4_jaccard_components": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
  FROM w
), t AS (
  SELECT doc_id, len(shingles)::BIGINT AS n, unnest(shingles) AS shingle FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, r.component_id
FROM s JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) r ON r.node = s.doc_id
"""
}
