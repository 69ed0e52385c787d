"""Collocations: phrases of two or three words that occur more often than their parts suggest.

Texts are tokenised once, into slices that later passes read. Counting goes level by level. Words are counted outright; a longer phrase is a candidate only if
all its parts may be frequent (Apriori), which fixed-size bit maps tell: one of frequent shorter
phrases, and one of hash buckets whose total over all documents reaches the least count. Neither
drops a frequent phrase. The candidates get a minimal perfect hash, in shards; every mapper counts
its occurrences into numpy arrays by slot, verified against the stored key, and the arrays are
summed as a tree. Counts of phrases and of the parts on either side of a cut are read by slot.

Keys are two 64-bit hashes of words and language. What is taken for a candidate is told by the
stored one of them: for n distinct phrases a mistake has the odds of n to 2^64.

Defined results: a null text counts as empty and has no words, a null lang is ``und``; rows count as
often as they repeat, whatever their ids; texts of any length are read whole; a table without
candidates gives an empty result; other columns are not read. Counts must stay below 10^15.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm import slot_index
from pathloom.llm.common import discard, materialize, table
from pathloom.llm.slot_index import Group, mix

MIN_COUNT, LONGEST, TOP = 10, 3, 2000
SCALE, ABSORBED_PERCENT = 1_000_000, 50
NO_LANG = "und"
#: What ends a piece, then what parts words inside it. Bytes 0xFF do not occur in UTF-8.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
BREAK = b"\xff"
TO_MARKS = bytes.maketrans(ENDS + BLANKS, BREAK * len(ENDS) + b" " * len(BLANKS))
#: Bytes of text that a mapper tokenises at a time, words it remembers, buckets it gathers before it emits them.
SLICE_BYTES, REMEMBERED, GATHERED = 1_000_000, 120_000, 1_500_000
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
#: Input splits that one task looks for candidates in.
DISCOVER_TOGETHER = 4
#: Keys (as a power of two) that a mapper remembers to have emitted.
LATELY_BITS = 22
#: Words of the corpus for each bucket, and the least and most buckets (as powers of two): 2^30 bits are 128 MB.
WORDS_A_BUCKET, FEWEST_BITS, MOST_BITS = 4, 16, 30
BLOCK_BITS = 16
ARITY = 32
ODD = np.uint64(0xD6E8FEB86659FD93)
SUMS = "block int, task int, at binary, counts binary"
#: Salts of the ranking: each language is cut to its best in parts first.
RANK_PARTS = 64


def hashes(words: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each word, as two rows."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2).T


class Lexicon(dict):
    """Numbers of the words met by a mapper, and their hashes; 0 is the break between pieces."""

    def __init__(self):
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self[BREAK] = 0
        self.words, self.hashes = [BREAK], np.zeros((2, 1), np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.words.append(word)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.words) > self.hashes.shape[1]:
            self.hashes = np.concatenate([self.hashes, hashes(self.words[self.hashes.shape[1] :])], axis=1)
        return out


def seeds(lang: bytes) -> tuple[np.uint64, np.uint64]:
    return np.uint64(xxhash.xxh3_64_intdigest(lang, 2)), np.uint64(xxhash.xxh3_64_intdigest(lang, 3))


def key(seed, parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of words from theirs."""
    return reduce(lambda so_far, h: mix(so_far + h * ODD), parts[1:], mix(parts[0] + seed))


class Slice:
    """Some texts of one language: numbers of their words in order, the words, and keys of their phrases."""

    def __init__(self, lang: bytes, ids: np.ndarray, words: list[bytes], hashed: np.ndarray):
        self.lang, self.ids, self.words, self.hashed = lang, ids, words, hashed
        self.seeds, self.inside = seeds(lang), ids != 0
        self._keys: dict = {}

    def whole(self, width: int) -> np.ndarray:
        """Whether a phrase of this width starts at each place."""
        n = max(0, self.ids.size - width + 1)
        return reduce(np.logical_and, [self.inside[k : k + n] for k in range(width)])

    def keys(self, width: int, side: int) -> np.ndarray:
        if (width, side) not in self._keys:
            if width == 1:
                self._keys[1, side] = mix(self.hashed[side] + self.seeds[side])[self.ids]
            else:
                h, n = (self.hashed[side] * ODD)[self.ids], max(0, self.ids.size - width + 1)
                self._keys[width, side] = mix(self.keys(width - 1, side)[:n] + h[width - 1 : width - 1 + n])
        return self._keys[width, side]

    def row(self) -> tuple:
        """lang, words, ids to store: only the words that occur, numbered anew."""
        seen = np.bincount(self.ids, minlength=1) > 0
        seen[0] = True
        local = np.cumsum(seen) - 1
        return self.lang, b" ".join([self.words[i] for i in np.flatnonzero(seen)[1:].tolist()]), local[self.ids].astype(np.uint32).tobytes()


def stored_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    """Slices from rows (lang, words, ids)."""
    for batch in batches:
        for lang, words, ids in zip(*[batch.column(c) for c in ("lang", "words", "ids")]):
            own = [BREAK, *words.as_py().split(b" ")]
            yield Slice(lang.as_py(), np.frombuffer(ids.as_py(), np.uint32), own, hashes(own))


def slices(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, full: Callable[[], Iterator]) -> Iterator:
    """Slices of all rows (lang, text as binary); what full() yields is passed on before the lexicon is emptied."""
    held: dict[bytes, list[bytes]] = {}
    size = 0

    def emit() -> Iterator:
        for lang, texts in held.items():
            words = BREAK.join(texts).lower().translate(TO_MARKS).replace(BREAK, b" \xff ").split()
            if words:
                ids = lexicon.numbers(words)
                yield Slice(lang, ids, lexicon.words, lexicon.hashes)
            if len(lexicon) > REMEMBERED:
                yield from full()
                lexicon.forget()
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            text = text.as_py()
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= SLICE_BYTES:
                yield from emit()
                size = 0
    yield from emit()
    yield from full()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(NO_LANG)).cast("binary").alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _blocks(at: np.ndarray, counts: np.ndarray, task: int) -> list[tuple]:
    """SUMS rows of ascending places: each block's places as 16-bit offsets, counts in the least width that holds them."""
    block = at >> BLOCK_BITS
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    out = []
    for s, e in zip(starts, [*starts[1:], at.size]):
        part = counts[s:e]
        out.append((int(block[s]), task, (at[s:e] & 0xFFFF).astype(np.uint16).tobytes(), part.astype(np.min_scalar_type(int(part.max()))).tobytes()))
    return out


def unpack(at: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    places = np.frombuffer(at, np.uint16).astype(np.int64)
    return places, np.frombuffer(counts, f"u{len(counts) // max(1, places.size)}" if places.size else np.uint8).astype(np.int64)


class Buckets:
    """Counts of hashed keys, gathered until there are many."""

    def __init__(self, bits: int, most: int):
        self.bits, self.most, self.parts, self.size = bits, most, [], 0

    def add(self, keys: np.ndarray) -> list[tuple]:
        self.parts.append((keys >> np.uint64(64 - self.bits)).astype(np.uint32))
        self.size += keys.size
        return self.take() if self.size >= GATHERED else []

    def take(self) -> list[tuple]:
        if not self.size:
            return []
        at, counts = np.unique(np.concatenate(self.parts), return_counts=True)
        self.parts, self.size = [], 0
        return _blocks(at.astype(np.int64), np.minimum(counts, self.most), TaskContext.get().partitionId())


def tree_sum(rows: DataFrame, tasks: int, most: int | None = None, least: int | None = None) -> DataFrame:
    """SUMS with one row for each block: the rows of ARITY tasks are added at a time, up to most.

    With least, the last sum leaves packed bits only, of the places that reach it, in the column at.
    """

    def total(part: pd.DataFrame) -> np.ndarray:
        out = np.zeros(1 << BLOCK_BITS, np.int64)
        for at, counts in zip(part["at"], part["counts"]):
            places, n = unpack(at, counts)
            out[places] += n
        return out

    def add(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        sums = total(part)
        at = np.flatnonzero(sums)
        return pd.DataFrame(_blocks((int(group[0]) << BLOCK_BITS) + at, np.minimum(sums[at], most or sums.max()), int(group[1])), columns=["block", "task", "at", "counts"])

    def flags(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(group[0])], "task": [0], "at": [np.packbits(total(part) >= least, bitorder="little").tobytes()], "counts": [b""]})

    while True:
        tasks = -(-tasks // ARITY)
        last = least is not None and tasks <= 1
        rows = rows.groupBy("block", (F.col("task") / ARITY).cast("int").alias("task")).applyInPandas(flags if last else add, SUMS)
        if tasks <= 1:
            return rows


def bit_map(flags: DataFrame, bits: int) -> np.ndarray:
    """2^bits packed bits from the rows of a tree_sum with least: the driver gets bits, not counts."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (BLOCK_BITS - 3)
    for row in flags.select("block", "at").collect():
        out[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(row["at"], np.uint8)
    return out


def has(flags: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - int(flags.size * 8).bit_length() + 1)
    return (flags[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _record(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


_SUM_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def first_pass(docs: DataFrame, bits: int) -> DataFrame:
    """Tokenised slices, counts of words by language and mapper, and bucket counts of all pairs of words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, pairs, counts = Lexicon(), Buckets(bits, MIN_COUNT), {}
        names = ["lang", "words", "ids", "word", "n", "block", "task", "at", "counts"]
        types = [pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), *_SUM_TYPES]
        sums = lambda rows: _record([(None, None, None, None, None, *r) for r in rows], names, types)

        def full() -> Iterator[pa.RecordBatch]:
            for lang, n in counts.items():
                hit = np.flatnonzero(n)
                hit = hit[hit > 0]
                for k in range(0, hit.size, 50_000):
                    some = hit[k : k + 50_000]
                    empty = pa.nulls(some.size, pa.binary())
                    columns = [pa.array([lang] * some.size, pa.binary()), empty, empty, pa.array([lexicon.words[i] for i in some.tolist()], pa.binary()), pa.array(n[some], pa.int64()), *[pa.nulls(some.size, t) for t in _SUM_TYPES]]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
            counts.clear()

        for part in slices(batches, lexicon, full):
            if isinstance(part, pa.RecordBatch):
                yield part
                continue
            n = np.bincount(part.ids, minlength=len(lexicon))
            before = counts.get(part.lang)
            if before is not None:
                n[: len(before)] += before
            counts[part.lang] = n
            yield _record([(*part.row(), None, None, None, None, None, None)], names, types)
            yield sums(pairs.add(part.keys(2, 0)[part.whole(2)]))
        yield sums(pairs.take())

    return _texts(docs).mapInArrow(scan, f"lang binary, words binary, ids binary, word binary, n long, {SUMS}")


def discover(tokens: DataFrame, width: int, shorter, buckets, onward: int | None = None) -> DataFrame:
    """Phrases of this width that may be frequent: their parts are in shorter (bit maps by width), their bucket in buckets.

    With onward, also bucket counts of the phrases one word longer whose parts may be frequent.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longer = Buckets(onward or FEWEST_BITS, MIN_COUNT)
        names, types = ["lang", "phrase", "block", "task", "at", "counts"], [pa.binary(), pa.binary(), *_SUM_TYPES]
        sums = lambda rows: _record([(None, None, *r) for r in rows], names, types)
        #: Keys emitted lately, by their low bits: most repetitions end here, the rest in distinct().
        lately = np.zeros(1 << LATELY_BITS, np.uint64)
        for part in stored_slices(batches):
            good = has(shorter.value, part.keys(width - 1, 0))
            safe = part.whole(width)
            safe = safe & good[: safe.size] & good[1 : safe.size + 1]
            at = np.flatnonzero(safe)
            at = at[has(buckets.value, part.keys(width, 0)[at])]
            if onward:
                runs = np.zeros(safe.size, bool)
                runs[at] = True
                both = np.flatnonzero(runs[:-1] & runs[1:])
                yield sums(longer.add(part.keys(width + 1, 0)[both]))
            a, first = np.unique(part.keys(width, 0)[at], return_index=True)
            at, low = at[first], (a & np.uint64(lately.size - 1)).astype(np.int64)
            new = lately[low] != a
            lately[low[new]] = a[new]
            spans = zip(*[part.ids[at[new] + k].tolist() for k in range(width)])
            phrases = [b" ".join([part.words[i] for i in span]) for span in spans]
            columns = [pa.array([part.lang] * len(phrases), pa.binary()), pa.array(phrases, pa.binary()), *[pa.nulls(len(phrases), t) for t in _SUM_TYPES]]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        yield sums(longer.take())

    # Fewer, larger tasks: a phrase comes once from each that has it.
    few = tokens.coalesce(max(1, -(-_tasks(tokens) // DISCOVER_TOGETHER)))
    return few.mapInArrow(scan, f"lang binary, phrase binary, {SUMS}")


def part_keys(rows: pd.DataFrame, width: int, parts: list[tuple[int, int]]) -> pd.DataFrame:
    """The keys a0, b0, a1, b1 ... of these ranges of the words of rows (lang, phrase, as binary)."""
    words = sorted({w for p in rows["phrase"] for w in bytes(p).split(b" ")})
    number, hashed = {w: k for k, w in enumerate(words)}, hashes(words)
    ids = np.fromiter((number[w] for p in rows["phrase"] for w in bytes(p).split(b" ")), np.int64).reshape(-1, width)
    own = {lang: seeds(bytes(lang)) for lang in set(rows["lang"])}
    out = {}
    for side, name in enumerate("ab"):
        seed = np.array([own[x][side] for x in rows["lang"]], np.uint64)
        for k, (start, stop) in enumerate(parts):
            out[f"{name}{k}"] = key(seed, [hashed[side][ids[:, j]] for j in range(start, stop)]).view(np.int64)
    return rows.assign(**out)


def keyed(phrases: DataFrame, width: int) -> DataFrame:
    """Rows of phrases (lang, phrase, as binary) with their keys a0, b0."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (part_keys(rows, width, [(0, width)]) for rows in batches if len(rows))

    return phrases.mapInPandas(read, ", ".join(f"{n} {t}" for n, t in phrases.dtypes) + ", a0 long, b0 long")


class Level:
    """Phrases of one width behind a minimal perfect hash, and their counts by slot."""

    def __init__(self, keys: DataFrame, count: int):
        self.spark, self.shards = keys.sparkSession, slot_index.shards_for(count)
        self.index = materialize(slot_index.build_shards(keys, self.shards), "slot-index")
        self.parts = slot_index.groups_of(self.shards)
        self.counts: list[np.ndarray] = []

    def groups(self) -> Iterator[tuple[Group, int]]:
        for part in self.parts:
            one = slot_index.group(self.index, part, self.shards)
            yield one, one.first[-1]

    def fill(self, tallied: Callable[[object], DataFrame], tasks: int) -> Level:
        """Sum what tallied makes of each group: SUMS rows whose block is a shard and whose places are its slots."""
        for one, n in self.groups():
            shipped = self.spark.sparkContext.broadcast(one)
            sums = tree_sum(tallied(shipped), tasks)
            total = np.zeros(n, np.int64)
            for row in sums.collect():
                at, counts = unpack(row["at"], row["counts"])
                total[one.first[one.local[row["block"]]] + at] = counts
            self.counts.append(total)
            shipped.destroy()
        return self


def read_counts(rows: DataFrame, lookups: list[tuple[Level, str, str, str]], width: int = 0, parts: list[tuple[int, int]] | None = None) -> DataFrame:
    """rows with counts by slot: for each (level, a, b, into), of the key in the columns a and b; 0 where it is none.

    With parts, the keys are those of ranges of the phrase's words. Levels of several groups are read
    in as many passes, each written before the next, so that a worker holds one group of each level.
    """
    into = [name for *_, name in lookups]
    rows = rows.withColumns({name: F.lit(0).cast("long") for name in into})
    columns, levels = rows.columns, list({id(level): level for level, *_ in lookups}.values())
    for turn in range(max(len(level.parts) for level in levels)):
        held = {id(level): (slot_index.group(level.index, level.parts[turn], level.shards), level.counts[turn]) for level in levels if turn < len(level.parts)}
        shipped = rows.sparkSession.sparkContext.broadcast(held)
        wanted = [(id(level), a, b, name) for level, a, b, name in lookups if id(level) in held]

        def look(batches: Iterator[pd.DataFrame], shipped=shipped, wanted=wanted) -> Iterator[pd.DataFrame]:
            for part in batches:
                if not len(part):
                    continue
                keys = part_keys(part, width, parts) if parts else part
                found = {}
                for level, a, b, name in wanted:
                    group, by_slot = shipped.value[level]
                    slot = group.slots(keys[a].to_numpy(np.int64).view(np.uint64), keys[b].to_numpy(np.int64).view(np.uint64))
                    found[name] = part[name].to_numpy(np.int64) + np.append(by_slot, 0)[slot]
                yield part.assign(**found)[columns]

        if turn:
            rows = materialize(rows, "counts-by-slot")
        rows = rows.mapInPandas(look, rows.schema)
    return rows


def _shard_rows(held: Group, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts by slot as SUMS rows, one for each shard that has any."""
    if np.diff(held.first).max(initial=0) > 1 << BLOCK_BITS:
        raise ValueError("a shard holds more keys than a block")
    at = np.flatnonzero(total)
    shard = np.searchsorted(held.first, at, "right") - 1
    rows = _blocks((held.ids[shard] << BLOCK_BITS) + at - held.first[shard], total[at], TaskContext.get().partitionId()) if at.size else []
    yield _record(rows, ["block", "task", "at", "counts"], _SUM_TYPES)


def occurrences(tokens: DataFrame, width: int, buckets) -> Callable:
    """Counts of the occurrences in all slices: each mapper counts slots into an array of its own."""

    def tallied(shipped) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shipped.value
            total, found = np.zeros(held.first[-1], np.uint32), []
            for part in stored_slices(batches):
                at = np.flatnonzero(part.whole(width) & has(buckets.value, part.keys(width, 0)))
                slot = held.slots(part.keys(width, 0)[at], part.keys(width, 1)[at])
                found.append(slot[slot >= 0].astype(np.int32))
                if sum(x.size for x in found) >= GATHERED:
                    total += np.bincount(np.concatenate(found), minlength=total.size).astype(np.uint32)
                    found = []
            if found:
                total += np.bincount(np.concatenate(found), minlength=total.size).astype(np.uint32)
            yield from _shard_rows(held, total)

        return tokens.mapInArrow(scan, SUMS)

    return tallied


def stated(rows: DataFrame, count: str) -> Callable:
    """Counts that rows (a0, b0, count) already have."""

    def tallied(shipped) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shipped.value
            total = np.zeros(held.first[-1], np.int64)
            for part in batches:
                slot = held.slots(*[part.column(c).to_numpy().view(np.uint64) for c in ("a0", "b0")])
                total[slot[slot >= 0]] = part.column(count).to_numpy()[slot >= 0]
            yield from _shard_rows(held, total)

        return rows.select("a0", "b0", count).mapInArrow(scan, SUMS)

    return tallied


def _tasks(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())


def _map_of(keys: DataFrame, bits: int, spark: SparkSession):
    """Bit map of the keys a0."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Buckets(bits, 1)
        for part in batches:
            yield _record(held.add(part.column("a0").to_numpy().view(np.uint64)), ["block", "task", "at", "counts"], _SUM_TYPES)
        yield _record(held.take(), ["block", "task", "at", "counts"], _SUM_TYPES)

    sums = tree_sum(keys.select("a0").mapInArrow(emit, SUMS), _tasks(keys), 1, 1)
    return spark.sparkContext.broadcast(bit_map(sums, bits))


def _bucket_map(scanned: DataFrame, bits: int, tasks: int, spark: SparkSession):
    sums = tree_sum(scanned.filter("block is not null").select("block", "task", "at", "counts"), tasks, MIN_COUNT, MIN_COUNT)
    return spark.sparkContext.broadcast(bit_map(sums, bits))


def _score(a, l, r):
    return F.expr(f"({SCALE}BD * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES at most, for what runs inside: rows here are whole texts and slices."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def mine(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    with small_batches(docs.sparkSession):
        found, totals = count(docs)
    return ranked(absorbed(found), totals, top)


def count(docs: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Written rows lang, phrase, a, l, r, score of each width's frequent phrases, and lang, n."""
    spark = docs.sparkSession
    tasks = _tasks(docs)
    octets = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(octets / 6 / WORDS_A_BUCKET + 1))))

    first = materialize(first_pass(docs, bits), "words-and-buckets")
    tokens = first.filter("ids is not null").select("lang", "words", "ids")
    words = materialize(first.filter("word is not null").groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("f")), "words")
    pairs = _bucket_map(first, bits, tasks, spark)
    frequent = materialize(keyed(words.filter(F.col("f") >= MIN_COUNT), 1), "frequent-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = [Level(frequent.select(F.col("a0").alias("a"), F.col("b0").alias("b")), frequent.count()).fill(stated(frequent, "f"), _tasks(frequent))]
    shorter, buckets, found = _map_of(frequent, bits, spark), pairs, []
    for width in range(2, LONGEST + 1):
        last = width == LONGEST
        scanned = materialize(discover(tokens, width, shorter, buckets, None if last else bits), "discovered")
        candidates = materialize(keyed(scanned.filter("phrase is not null").select("lang", "phrase").distinct(), width), "candidates")
        longer = None if last else _bucket_map(scanned, bits, max(tasks, _tasks(tokens)), spark)
        level = Level(candidates.select(F.col("a0").alias("a"), F.col("b0").alias("b")), candidates.count()).fill(occurrences(tokens, width, buckets), max(tasks, _tasks(tokens)))
        counted = materialize(read_counts(candidates, [(level, "a0", "b0", "f")]).filter(F.col("f") >= MIN_COUNT), "frequent-phrases")
        levels.append(level)
        # The cuts of each phrase: the counts of both sides, read from the levels of their widths.
        sides = [side for k in range(1, width) for side in ((0, k), (k, width))]
        lookups = [(levels[stop - start - 1], f"a{n}", f"b{n}", f"{'lr'[n % 2]}{n // 2 + 1}") for n, (start, stop) in enumerate(sides)]
        cut = read_counts(counted.select("lang", "phrase", "f"), lookups, width, sides)
        best = F.least(*[F.struct(_score("f", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, width)]) if width > 2 else F.struct(_score("f", "l1", "r1").alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"), F.col("r1").alias("r"))
        found.append(materialize(cut.withColumn("best", best).select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("f").alias("a"), "best.l", "best.r", "best.score"), "cuts"))
        for used in (shorter, buckets):
            used.destroy()
        shorter, buckets = (None, None) if last else (_map_of(counted, bits, spark), longer)
        discard(scanned, candidates, counted)
    discard(first, frequent, *[level.index for level in levels])
    return found, totals


def absorbed(found: list[DataFrame]) -> DataFrame:
    """Phrases of all widths without those that a longer one mostly stands for."""
    kept = [found[-1]]
    for width, rows in enumerate(found[:-1], 2):
        inner = []
        for longer_width, longer in enumerate(found[width - 1 :], width + 1):
            spans = F.expr(f"transform(sequence(1, {longer_width - width + 1}), k -> array_join(slice(split(phrase, ' '), k, {width}), ' '))")
            inner.append(longer.select("lang", F.explode(spans).alias("phrase"), "a"))
        most = reduce(DataFrame.unionByName, inner).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        kept.append(rows.join(most, ["lang", "phrase"], "left").filter((F.col("longer").isNull()) | (100 * F.col("longer") < ABSORBED_PERCENT * F.col("a"))).drop("longer"))
    return reduce(DataFrame.unionByName, kept)


def ranked(rows: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    few = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select(F.col("lang").cast("string").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


SQL = {
    "op12_collocations": f"""
WITH p AS (
  SELECT doc_id, lang, generate_subscripts(pieces, 1) AS piece, unnest(pieces) AS words FROM (
    SELECT doc_id, coalesce(lang, '{NO_LANG}') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents)
), q AS (
  SELECT lang, [w FOR w IN string_split_regex(words, '[\\x20\\x09]+') IF w <> ''] AS w FROM p
), g AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM q
), u AS (
  SELECT lang, w[i] AS phrase, count(*) AS f FROM g GROUP BY ALL
), b AS (
  SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM g WHERE i < len(w) GROUP BY ALL
), t AS (
  SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM g WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= {MIN_COUNT}
), s AS (
  SELECT b.lang, b.x || ' ' || b.y AS phrase, b.f AS a, p.f AS l, r.f AS r, 1 AS k FROM b JOIN u p ON p.lang = b.lang AND p.phrase = b.x JOIN u r ON r.lang = b.lang AND r.phrase = b.y WHERE b.f >= {MIN_COUNT}
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, p.f, r.f, 1 FROM t JOIN u p ON p.lang = t.lang AND p.phrase = t.x JOIN b r ON r.lang = t.lang AND r.x = t.y AND r.y = t.z
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, p.f, r.f, 2 FROM t JOIN b p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN u r ON r.lang = t.lang AND r.phrase = t.z
), c AS (
  SELECT *, ({SCALE}::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM s
), d AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM c
), e AS (
  SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, x || ' ' || y AS phrase, f FROM t UNION ALL SELECT lang, y || ' ' || z, f FROM t) GROUP BY ALL
), h AS (
  SELECT d.lang, d.phrase, a, l, r, score, row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, d.phrase) AS rank
  FROM d LEFT JOIN e ON e.lang = d.lang AND e.phrase = d.phrase WHERE cut = 1 AND NOT coalesce(100 * longer >= {ABSORBED_PERCENT} * a, false)
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM u GROUP BY lang
)
SELECT h.lang, rank, phrase, a, l, r, n, score FROM h JOIN n USING (lang) WHERE rank <= {TOP}
"""
}
