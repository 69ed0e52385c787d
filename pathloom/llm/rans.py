"""Token ids in a file format of their own: entropy coded, checked, decodable in parallel.

A segment holds whole documents and stands for itself: a table of how often each id occurs in it,
scaled to a power of two, serves all its blocks. A block is a run of ids dealt to LANES interleaved
coders (range variant of asymmetric numeral systems, 64-bit states that give off 32-bit words), and
needs no other block. The directory of a segment is its checkpoints: for each block where its bytes
begin, how many ids it has and the checksum of its bytes, so that any stretch of ids is read by
decoding its blocks alone. Blocks of a segment are coded side by side, as arrays.

Segments are written as binary values of one table, in the order of ids: its tasks commit as one,
a lost executor's task is done again, and each reader decodes the segments that it is dealt.

Defined results: a null text counts as empty and holds the end id only; documents follow each other
by ascending id, null ids first, repeated ids in the order of the table; texts of any length are
encoded whole and stay in one segment; an empty table writes no segment; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.session import ship
from pathloom.llm.common import fresh, table, work_path

MAGIC, VERSION = b"PLRS", 1
END_ID = 2
#: Scale of the table of frequencies; least state; ids of a block and its interleaved coders.
SCALE_BITS, LEAST_STATE = 18, 1 << 31
LANES, BLOCK_IDS = 32, 32_768
#: Blocks coded side by side, ids after which a segment ends, bytes of text for each task that writes.
ABREAST, SEGMENT_IDS, PART_BYTES = 64, 2_000_000, 64_000_000
#: Words whose ids a worker remembers, and words encoded in one call.
REMEMBERED, TOGETHER = 450_000, 256
#: Marks that part from the letters before them; letters below this character do not change their kind, but for one.
MARKS, PLAIN_BELOW, DOTTED = ".,;:!?", "\u0180", "\u0130"
WORD_END = "</w>"
#: How a tokenizer is built whose words can be encoded by themselves.
WORD_STEPS = [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A byte that UTF-8 does not have, for the end of a text; what stands for it in a text that has it all the same.
END, REPLACED = b"\xff", b"\xef\xbf\xbd"
#: 1: small ASCII letters, 2: marks, 3: white space.
_KINDS = np.zeros(256, np.uint8)
_KINDS[ord("a") : ord("z") + 1] = 1
_KINDS[[ord(m) for m in MARKS]] = 2
_KINDS[[9, 10, 11, 12, 13, 32]] = 3
SEGMENTS = "part int, segment int, first long, n_ids long, n_docs long, data binary"
DIGESTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
_HEADER = struct.Struct("<4sHBBIIQII")


def plain(word: str) -> bool:
    """Whether a word is letters that stay single letters in any normal form and case: one match of the pattern."""
    return word.isalpha() and (word.isascii() or (max(word) < PLAIN_BELOW and DOTTED not in word))


class Growing:
    """An array that numbers are appended to."""

    def __init__(self, kind):
        self.held, self.size = np.zeros(1024, kind), 0

    def extend(self, more: np.ndarray) -> None:
        if self.size + more.size > self.held.size:
            self.held = np.resize(self.held, 2 * (self.size + more.size))
        self.held[self.size : self.size + more.size] = more
        self.size += more.size


def small_words(text: bytes) -> bytes:
    """A text with the same ids, of fewer different words: ASCII letters small, a single mark parted from the letter before it."""
    if b"<|" in text:
        return text
    text = text.lower()
    kinds = _KINDS[np.frombuffer(text, np.uint8)]
    at = np.flatnonzero((kinds[1:-1] == 2) & (kinds[:-2] == 1) & (kinds[2:] == 3)) + 1
    return np.insert(np.frombuffer(text, np.uint8), at, 32).tobytes() if at.size else text


class Words(dict):
    """Numbers of words; a new word gets the next one and waits to be learned."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class WordCoder:
    """Ids of texts by a tokenizer that drops white space: its words are encoded once and remembered.

    White space ends every match of the tokenizer's pattern, so what lies between is encoded by
    itself. A plain word with one mark of punctuation behind it has the ids of the word and of the
    mark. New plain words are encoded many at a time, small and without the steps that leave them as
    they are: each is one match, whose last id is one that ends a word. ids of all words met lie in
    one array, from which texts are gathered. Word 0 stands for the end of a text. Texts of a
    tokenizer of another build are encoded as they are.
    """

    def __init__(self, blob: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob)
        build = json.loads(blob)
        steps = [[x["type"] for x in (build[k] or {}).get(inner, ())] for k, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.by_words = steps == WORD_STEPS and all("<|" in t["content"] for t in build["added_tokens"]) and build["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") == WORD_PATTERN
        build |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *(build["pre_tokenizer"] or {}).get("pretokenizers", [])[1:]]}}
        self.quick = Tokenizer.from_str(json.dumps(build)) if self.by_words else None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.marks = {mark: self._apart([mark])[0] for mark in MARKS}
        self.forget()

    def forget(self) -> None:
        self.known = Words({END: 0})
        self.known.new = []
        self.start, self.length, self.flat = Growing(np.int64), Growing(np.int64), Growing(np.uint32)
        self.start.extend(np.zeros(1, np.int64))
        self.length.extend(np.ones(1, np.int64))
        self.flat.extend(np.array([END_ID], np.uint32))

    def _apart(self, words: list[str]) -> list[list[int]]:
        return [e.ids for k in range(0, len(words), TOGETHER) for e in self.tokenizer.encode_batch_fast(words[k : k + TOGETHER], add_special_tokens=False)]

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain small words one after the other, and how many each has."""
        flat, lengths = [], []
        for k in range(0, len(words), TOGETHER):
            some = words[k : k + TOGETHER]
            ids = np.array(self.quick.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if cuts.size != len(some) or cuts[-1] != ids.size:
                apart = self._apart(some)
                ids, cuts = np.fromiter(chain.from_iterable(apart), np.uint32), np.cumsum([len(x) for x in apart])
            flat.append(ids)
            lengths.append(np.diff(cuts, prepend=0))
        return np.concatenate([np.zeros(0, np.uint32), *flat]), np.concatenate([np.zeros(0, np.int64), *lengths])

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words; the numbers of words follow their order."""
        simple = np.fromiter(map(bytes.isalpha, words), bool, len(words))
        marks, other = [], []
        stems = b" ".join(w for w, s in zip(words, simple) if s).decode().lower().split()
        for word in (w for w, s in zip(words, simple) if not s):
            text = word.decode("utf-8", "replace")
            mark = text[-1] if text[-1] in MARKS else ""
            stem = text[:-1] if mark else text
            marks.append(mark if plain(stem) else None)
            (other if marks[-1] is None else stems).append(text if marks[-1] is None else stem.lower())
        flat, lengths = self._together(stems)
        n = int(simple.sum())
        cut = int(lengths[:n].sum())
        together, apart = iter(np.split(flat[cut:], np.cumsum(lengths[n:])[:-1])), iter(self._apart(other))
        lists = [next(apart) if mark is None else [*next(together).tolist(), *self.marks.get(mark, ())] for mark in marks]
        own = np.empty(len(words), np.int64)
        own[simple], own[~simple] = lengths[:n], [len(x) for x in lists]
        place = np.empty(len(words), np.int64)
        place[simple] = np.cumsum(lengths[:n]) - lengths[:n]
        place[~simple] = cut + np.cumsum(own[~simple]) - own[~simple]
        self.start.extend(self.flat.size + place)
        self.length.extend(own)
        self.flat.extend(flat[:cut])
        self.flat.extend(np.fromiter(chain.from_iterable(lists), np.uint32))

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by END_ID, and the number of each text's ids."""
        if not self.by_words:
            lists = [[*ids, END_ID] for ids in self._apart([text.decode("utf-8", "replace") for text in texts])]
            return np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))
        if len(self.known) > REMEMBERED:
            self.forget()
        words = small_words(b"".join(chain.from_iterable((text.replace(END, REPLACED) if END in text else text, b" \xff ") for text in texts))).split()
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        length = self.length.held[at]
        upto = np.cumsum(length)
        place = np.arange(upto[-1] if upto.size else 0) - np.repeat(upto - length - self.start.held[at], length)
        return self.flat.held[place], np.diff(upto[at == 0], prepend=0)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of occurring ids that add up to 2^SCALE_BITS, none of them 0."""
    total = 1 << SCALE_BITS
    if not 0 < counts.size <= total:
        raise ValueError("a table has from 1 to 2^SCALE_BITS different ids")
    out = np.maximum(1, counts * total // counts.sum())
    over = int(out.sum()) - total
    # The rounding is settled by the ids that occur most.
    order = np.argsort(-out, kind="stable")
    if over < 0:
        out[order[0]] -= over
    for k in order:
        if over <= 0:
            break
        take = min(over, int(out[k]) - 1)
        out[k] -= take
        over -= take
    return out


def _encode(symbols: np.ndarray, freq: np.ndarray, low: np.ndarray) -> list[bytes]:
    """Bytes of blocks side by side: symbols is (block, step, lane)."""
    blocks, steps, lanes = symbols.shape
    state = np.full((blocks, lanes), LEAST_STATE, np.uint64)
    words, given = np.zeros((steps, blocks, lanes), np.uint32), np.zeros((steps, blocks, lanes), bool)
    f_all, c_all = freq.astype(np.uint64), low.astype(np.uint64)
    room = np.uint64(31 - SCALE_BITS + 32)
    for t in range(steps - 1, -1, -1):
        s = symbols[:, t, :]
        f = f_all[s]
        full = state >= f << room
        given[t], words[t] = full, state
        state = np.where(full, state >> np.uint64(32), state)
        q, r = np.divmod(state, f)
        state = (q << np.uint64(SCALE_BITS)) + r + c_all[s]
    return [state[b].astype("<u8").tobytes() + words[:, b][given[:, b]].astype("<u4").tobytes() for b in range(blocks)]


def _decode(data: list[bytes], steps: int, freq: np.ndarray, low: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The inverse of _encode."""
    blocks = len(data)
    state = np.stack([np.frombuffer(d, "<u8", LANES) for d in data])
    streams = [np.frombuffer(d, "<u4", offset=8 * LANES) for d in data]
    flat = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
    at = np.append(0, np.cumsum([x.size for x in streams]))[:-1]
    out = np.empty((blocks, steps, LANES), symbol.dtype)
    f_all, c_all = freq.astype(np.uint64), low.astype(np.uint64)
    mask = np.uint64((1 << SCALE_BITS) - 1)
    for t in range(steps):
        slot = state & mask
        s = symbol[slot]
        out[:, t, :] = s
        state = f_all[s] * (state >> np.uint64(SCALE_BITS)) + slot - c_all[s]
        short = state < LEAST_STATE
        upto = np.cumsum(short, axis=1)
        word = flat[np.where(short, at[:, None] + upto - 1, flat.size - 1)]
        state = np.where(short, (state << np.uint64(32)) | word, state)
        at = at + upto[:, -1]
    return out


def pack_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """Header, documents (null flags, ids, lengths), table, directory of blocks, blocks."""
    occurs = np.bincount(ids)
    seen = np.flatnonzero(occurs)
    symbols = (np.cumsum(occurs > 0) - 1).astype(np.int32)[ids]
    freq = scaled(occurs[seen])
    low = np.cumsum(freq) - freq
    sizes = np.full(-(-ids.size // BLOCK_IDS), BLOCK_IDS)
    sizes[-1] = ids.size - BLOCK_IDS * (sizes.size - 1)
    filler = int(np.argmax(freq))
    blocks: list[bytes] = []
    whole = ids.size // BLOCK_IDS
    for k in range(0, whole, ABREAST):
        n = min(ABREAST, whole - k)
        blocks += _encode(symbols[k * BLOCK_IDS : (k + n) * BLOCK_IDS].reshape(n, -1, LANES), freq, low)
    rest = symbols[whole * BLOCK_IDS :]
    if rest.size:
        blocks += _encode(np.append(rest, np.full(-rest.size % LANES, filler)).reshape(1, -1, LANES), freq, low)
    starts = np.append(0, np.cumsum([len(b) for b in blocks]))
    directory = np.zeros(len(blocks), [("at", "<u8"), ("n", "<u4"), ("crc", "<u4")])
    directory["at"], directory["n"], directory["crc"] = starts[:-1], sizes, [zlib.crc32(b) for b in blocks]
    known = np.array([i is not None for i in doc_ids], np.uint8)
    meta = b"".join([known.tobytes(), np.array([i or 0 for i in doc_ids], "<i8").tobytes(), counts.astype("<u8").tobytes(), seen.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), directory.tobytes()])
    return _HEADER.pack(MAGIC, VERSION, SCALE_BITS, LANES, len(doc_ids), seen.size, ids.size, len(blocks), zlib.crc32(meta)) + meta + b"".join(blocks)


class Segment:
    """A segment's documents, table and checkpoints; blocks are decoded when asked for."""

    def __init__(self, data: bytes):
        magic, version, scale, lanes, docs, kinds, self.n_ids, blocks, crc = _HEADER.unpack_from(data)
        if (magic, version, scale, lanes) != (MAGIC, VERSION, SCALE_BITS, LANES):
            raise ValueError("no segment of this format")
        at = _HEADER.size

        def take(kind, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        known, ids, self.counts, self.ids, self.freq = take("u1", docs), take("<i8", docs), take("<u8", docs).astype(np.int64), take("<u4", kinds), take("<u4", kinds)
        self.directory = take([("at", "<u8"), ("n", "<u4"), ("crc", "<u4")], blocks)
        if zlib.crc32(data[_HEADER.size : at]) != crc:
            raise ValueError("the segment's directory is damaged")
        self.doc_ids = [int(i) if k else None for k, i in zip(known, ids)]
        self.low = np.cumsum(self.freq.astype(np.int64)) - self.freq
        self.symbol = np.repeat(np.arange(kinds, dtype=np.min_scalar_type(kinds)), self.freq)
        self.payload = data[at:]

    def block(self, k: int) -> bytes:
        start = int(self.directory["at"][k])
        stop = int(self.directory["at"][k + 1]) if k + 1 < len(self.directory) else len(self.payload)
        held = self.payload[start:stop]
        if zlib.crc32(held) != self.directory["crc"][k]:
            raise ValueError(f"block {k} is damaged")
        return held

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from start up to stop: only the blocks that hold them are decoded."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK_IDS, (stop - 1) // BLOCK_IDS
        out, k = [], first
        while k <= last:
            full = [j for j in range(k, min(k + ABREAST, last + 1)) if self.directory["n"][j] == BLOCK_IDS]
            some = full or [k]
            n = int(self.directory["n"][some[0]])
            symbols = _decode([self.block(j) for j in some], -(-n // LANES), self.freq, self.low, self.symbol)
            out.append(symbols.reshape(len(some), -1)[:, :n].ravel())
            k += len(some)
        ids = self.ids[np.concatenate(out)]
        return ids[start - first * BLOCK_IDS : stop - first * BLOCK_IDS]


_coders: dict[str, WordCoder] = {}


def coder(blob: str) -> WordCoder:
    """The worker's coder for this tokenizer: made once, kept while the worker lives."""
    name = hashlib.sha256(blob.encode()).hexdigest()
    if name not in _coders:
        _coders.clear()
        _coders[name] = WordCoder(blob)
    return _coders[name]


def write_ids(docs: DataFrame, path: str, tokenizer_path: str | None = None) -> None:
    """Encode every text, in ascending order of ids, into segments under path.

    Tasks take ranges of ids of about PART_BYTES of text; rows that repeat an id are told apart by
    their place in the table, so that an id that holds a large share of all rows spreads as well.
    """
    import public_tokenizers

    with open(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as held:
        blob = held.read()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, part = coder(blob), TaskContext.get().partitionId()
        names, counts, ids = [], [], []
        segment = first = size = 0

        def close() -> pa.RecordBatch:
            nonlocal names, counts, ids, segment, first, size
            row = (part, segment, first, size, len(names), pack_segment(names, np.concatenate(counts), np.concatenate(ids)))
            names, counts, ids, segment, first, size = [], [], [], segment + 1, first + size, 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "segment", "first", "n_ids", "n_docs", "data"])

        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                rows = batch.slice(k, 128)
                got, n = one.encode_all(rows.column("text").to_pylist())
                names += rows.column("doc_id").to_pylist()
                counts.append(n)
                ids.append(got)
                size += got.size
                if size >= SEGMENT_IDS:
                    yield close()
        if names:
            yield close()

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    place = fresh(docs, "place")[0]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.monotonically_increasing_id().alias(place))
    ordered = rows.repartitionByRange(parts, "doc_id", place).sortWithinPartitions("doc_id", place).select("doc_id", "text")
    ordered.mapInArrow(encode, SEGMENTS).write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """SEGMENTS and start: how many ids come before the segment. The driver sums one number for each writing task."""
    rows = ship(spark).read.schema(SEGMENTS).parquet(path)
    totals = sorted(map(tuple, rows.groupBy("part").agg(F.sum("n_ids")).collect()))
    starts = np.append(0, np.cumsum([n for _, n in totals])).tolist()
    frame = spark.createDataFrame([(p, s) for (p, _), s in zip(totals, starts)], "part int, before long")
    return rows.join(F.broadcast(frame), "part").withColumn("start", F.col("before") + F.col("first")).drop("before")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids of every document, in the files' order within each segment."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, start in zip(batch.column("data"), batch.column("start").to_pylist()):
                held = Segment(data.as_py())
                ids, ends = held.read(), np.cumsum(held.counts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(held.doc_ids, pa.int64()), pa.array(start + ends - held.counts, pa.int64()), lists], names=["doc_id", "start", "ids"])

    return read_segments(spark, path).select("data", "start").mapInArrow(decode, "doc_id bigint, start bigint, ids array<int>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """DIGESTS of every document, from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, start in zip(batch.column("data"), batch.column("start").to_pylist()):
                held = Segment(data.as_py())
                raw, ends = memoryview(held.read().astype("<u4").tobytes()), np.cumsum(held.counts)
                begins = ends - held.counts
                crc = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(held.doc_ids, pa.int64()), pa.array(start + begins, pa.int64()), pa.array(held.counts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_segments(spark, path).select("data", "start").mapInArrow(decode, DIGESTS)


def op13_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), path)
    return digests(spark, path)
