"""Quality classifier: a generalised additive model with pairwise interactions.

Learning is cyclic gradient boosting of shallow trees: each round visits the features in turn and
adds a small tree of one feature's bins to that feature's lookup table, then the strongest pairs of
features get tables of their own in the same way. Scoring is one table lookup and addition for
each term, vectorised over the rows of a batch.

The features describe the form of a text (symbols, capitals, repetition, line shape), never its
label, language, source or id. Learning uses a bounded sample of labelled rows (SAMPLE_ROWS); its
features, not its texts, go to the driver.

Defined results: null and empty texts are scored like any other, from the features of an empty
text; texts are read whole; repeated rows get repeated scores; with no labelled rows, or only one
class of them, every score is the share of label 1 (0.5 without rows); a null id is never held
out; extra columns are carried by keep_documents and ignored elsewhere.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import fresh, materialize, table

#: At most so many labelled rows are learned from, those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
FOLDS, HELD_OUT_FOLD = 5, 0
THRESHOLD = 0.3

FEATURES = (
    "log_chars", "log_words", "word_length", "longest_word", "upper_share", "digit_share", "symbol_share",
    "bar_share", "bang_share", "stop_share", "white_share", "line_words", "distinct_share", "top_word_share",
    "repeat_share", "distinct_line_share", "symbol_word_share",
)

_UPPER, _DIGIT = np.arange(65, 91), np.arange(48, 58)
_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@\\^_`~{}[]", np.uint8)


def features(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    n = max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    m = max(len(words), 1)
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(1 for w, k in seen.items() for _ in range(k) if not w[-1:].isalpha() and w[-1:] not in b".,;:?" and w[-1] < 128)
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        float(lengths.mean()) if len(words) else 0.0,
        np.log1p(lengths.max()) if len(words) else 0.0,
        counts[_UPPER].sum() / n,
        counts[_DIGIT].sum() / n,
        counts[_SYMBOLS].sum() / n,
        counts[ord("|")] / n,
        counts[ord("!")] / n,
        counts[ord(".")] / m,
        (counts[32] + counts[9:14].sum()) / n,
        np.log1p(m / len(lines)),
        len(seen) / m,
        max(seen.values(), default=0) / m,
        repeats / m,
        len(set(lines)) / len(lines),
        marked / m,
    ]


def feature_matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py() or "") for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class AdditiveModel:
    """Bin edges, a table for each feature, and a table for each chosen pair of features."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables)):
            out += values[np.searchsorted(edges, x[:, j], side="right")]
        coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]
        for (i, j), values in zip(self.pairs, self.pair_tables):
            out += values[coarse[i], coarse[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def quantile_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]


def shallow_tree(gradient: np.ndarray, hessian: np.ndarray, splits: int, ridge: float) -> np.ndarray:
    """Newton steps of a tree with so many splits over ordered bins: one value for each bin."""
    gain = lambda g, h: g * g / (h + ridge)
    leaves = [(0, len(gradient))]
    for _ in range(splits):
        best = (1e-9, None, 0)
        for at, (lo, hi) in enumerate(leaves):
            g, h = np.cumsum(gradient[lo:hi]), np.cumsum(hessian[lo:hi])
            if hi - lo < 2:
                continue
            gains = gain(g[:-1], h[:-1]) + gain(g[-1] - g[:-1], h[-1] - h[:-1]) - gain(g[-1], h[-1])
            k = int(np.argmax(gains))
            best = max(best, (float(gains[k]), at, lo + k + 1), key=lambda x: x[0])
        if best[1] is None:
            break
        lo, hi = leaves.pop(best[1])
        leaves += [(lo, best[2]), (best[2], hi)]
    values = np.zeros(len(gradient))
    for lo, hi in leaves:
        values[lo:hi] = gradient[lo:hi].sum() / (hessian[lo:hi].sum() + ridge)
    return values


def pair_tree(gradient: np.ndarray, hessian: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """One cut of each axis: the four quadrants' Newton steps, and their gain."""
    g, h = gradient.cumsum(0).cumsum(1), hessian.cumsum(0).cumsum(1)
    quads = lambda s: np.array([s[:-1, :-1], s[:-1, -1:] - s[:-1, :-1], s[-1:, :-1] - s[:-1, :-1], s[-1, -1] - s[-1:, :-1] - s[:-1, -1:] + s[:-1, :-1]])
    if min(gradient.shape) < 2:
        return np.zeros_like(gradient), 0.0
    qg, qh = quads(g), quads(h)
    gains = (qg**2 / (qh + ridge)).sum(0)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    step = (qg / (qh + ridge))[:, i, j]
    values = np.zeros_like(gradient)
    values[: i + 1, : j + 1], values[: i + 1, j + 1 :], values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = step
    return values, float(gains[i, j])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 48, pair_bins: int = 8, pairs: int = 6, pair_rounds: int = 40, ridge: float = 2.0) -> AdditiveModel:
    """Cyclic boosting on the logistic loss: first the features in turn, then the strongest pairs."""
    share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.edges = quantile_edges(x, bins)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    cells = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    margin = np.full(len(y), model.bias)
    slopes = lambda: (y - (p := 1 / (1 + np.exp(-margin))), p * (1 - p))
    for _ in range(rounds):
        for cell, values in zip(cells, model.tables):
            g, h = slopes()
            step = rate * shallow_tree(np.bincount(cell, g, len(values)), np.bincount(cell, h, len(values)), 2, ridge)
            values += step
            margin += step[cell]
    model.pair_edges = quantile_edges(x, pair_bins)
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    shape = [len(e) + 1 for e in model.pair_edges]

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * shape[j] + coarse[j], v, shape[i] * shape[j]).reshape(shape[i], shape[j])

    g, h = slopes()
    strength = {(i, j): pair_tree(sums(i, j, g), sums(i, j, h), ridge)[1] for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])}
    model.pairs = sorted(strength, key=lambda p: (-strength[p], p))[:pairs]
    model.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), values in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = rate * pair_tree(sums(i, j, g), sums(i, j, h), ridge)[0]
            values += step
            margin += step[coarse[i], coarse[j]]
    return model


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on labelled rows outside the held-out fold. The ids sent to the scan are at most sample_rows."""
    chosen = labels.filter("doc_id is not null and quality is not null").filter(fold(F.col("doc_id")) != HELD_OUT_FOLD)
    chosen = chosen.select("doc_id", F.col("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_matrix(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    labelled = docs.select("doc_id", "text").join(F.broadcast(materialize(chosen, "quality-sample")), "doc_id").select("label", "text")
    rows = labelled.mapInArrow(describe, "label int, x array<double>").collect()
    rows.sort(key=lambda r: (r["label"], r["x"]))  # tasks end in any order; sums of floats should not show it
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["label"] for r in rows], dtype=np.float64))


def score(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; rows are scored where they are read."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(feature_matrix(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(s)], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(rate, "doc_id bigint, score double")
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with all their columns: a filter where rows are read."""
    model = train(docs, labels)

    @F.pandas_udf("double")
    def quality(text):
        return _scores(model, text)

    (score,) = fresh(docs, "score")
    return docs.withColumn(score, quality("text")).filter(F.col(score) >= threshold).drop(score)


def _scores(model: AdditiveModel, text):
    import pandas as pd

    return pd.Series(model.score(feature_matrix(pa.array(text, pa.string(), from_pandas=True))))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
