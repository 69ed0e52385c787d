"""Byte-level BPE through sentencepiece: the model is written out from a rank file, not trained.

Each vocabulary entry becomes a piece: its bytes mapped one to one to characters, its score the
negative rank, so that the highest-scoring merge is the lowest rank. The normaliser is the
identity. Pre-tokens are encoded one by one; ids are ranks, and decoding maps them back to bytes.

Defined results: a null text counts as empty and has no ids; texts of any length are encoded
whole; repeated rows give repeated results; an empty table gives an empty result; other columns
are never read, whatever their names.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pathloom.llm.common import table

#: Byte b is written as the character with this offset: two bytes of UTF-8, none of them white space.
BYTE_OFFSET = 0x100
UNKNOWN_PIECES = 1
#: Chunks whose ids a worker remembers before it starts afresh, and texts encoded in one call.
REMEMBERED = 300_000
TOGETHER = 128

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in order of rank. Ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in ranked]


_BYTE_CHARS = "".join(chr(BYTE_OFFSET + b) for b in range(256))


def mapped(token: bytes) -> str:
    return codecs.charmap_decode(token, "strict", _BYTE_CHARS)[0]


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model with one piece for each token, after the unknown piece."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=mapped(token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id, model.trainer_spec.bos_id, model.trainer_spec.eos_id, model.trainer_spec.pad_id = 0, -1, -1, -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes texts to ranks and decodes ranks to bytes.

    A text without two white-space characters in a row is cut before its single spaces: no match
    of the pattern crosses such a space, so the chunks can be encoded, and remembered, apart.
    """

    def __init__(self, tokens: list[bytes], pattern: str):
        import sentencepiece

        self.tokens, self.names = tokens, [str(i) for i in range(len(tokens))]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
        self.pretokens = regex.compile(pattern).findall
        self.tangled = regex.compile(r" \s|\s ").search
        self.known: dict[str, list[int]] = {}

    def _encode_chunks(self, chunks: list[str]) -> None:
        pieces = [self.pretokens(chunk) for chunk in chunks]
        flat = [mapped(p.encode()) for p in chain.from_iterable(pieces)]
        ids = iter(self.model.encode(flat, num_threads=1)) if flat else iter(())
        for chunk, own in zip(chunks, pieces):
            self.known[chunk] = [i - UNKNOWN_PIECES for _ in own for i in next(ids)]

    def chunks(self, text: str) -> list[str]:
        if self.tangled(text):
            return self.pretokens(text)
        first, *rest = text.split(" ")
        return [first, *[f" {x}" for x in rest]]

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; what is not yet known in all of them is encoded in one call."""
        cut = [self.chunks(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        missing = set(chain.from_iterable(cut)).difference(self.known)
        if missing:
            self._encode_chunks(list(missing))
        for chunks in cut:
            yield list(chain.from_iterable(map(self.known.__getitem__, chunks)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digest_row(self, ids: list[int]) -> tuple[int, str, str]:
        listed = " ".join(map(self.names.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(blob: bytes, pattern: str) -> Codec:
    """The worker's codec for this vocabulary: made once, kept while the worker lives."""
    key = (hashlib.sha256(blob).hexdigest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec([base64.b64decode(x) for x in blob.split(b"\n")], pattern)
    return _codecs[key]


def _vocabulary(vocab_path: str | None, pattern: str | None) -> tuple[bytes, str]:
    import public_tokenizers

    tokens = read_ranks(vocab_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return b"\n".join(map(base64.b64encode, tokens)), pattern or public_tokenizers.PATTERN


def digests(docs: DataFrame, vocab_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per document: token count, digest of its ids, digest of the decoded bytes.

    The vocabulary is read by the driver and goes out with the function: its size is that of one
    rank file. Rows are encoded where they are read; nothing is shuffled.
    """
    blob, pattern = _vocabulary(vocab_path, pattern)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(blob, pattern)
        for batch in batches:
            texts = batch.column("text")
            rows = [one.digest_row(ids) for start in range(0, len(texts), TOGETHER) for ids in one.encode_all([t or "" for t in texts.slice(start, TOGETHER).to_pylist()])]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(encode, SCHEMA)


def encode_documents(docs: DataFrame, vocab_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and token ids of each document, for writing training shards."""
    blob, pattern = _vocabulary(vocab_path, pattern)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(blob, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                ids = list(one.encode_all([t or "" for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """The inverse of encode_documents: doc_id and the text that the ids stand for."""
    blob, pattern = _vocabulary(vocab_path, None)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(blob, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([one.decode(x.as_py() or []).decode("utf-8", "replace") for x in batch.column("ids")], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, text string")


def op5_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
