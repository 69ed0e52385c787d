"""Toxicity by classifier chains.

Categories are predicted in sequence: each has a linear model over the indicator terms and the
probabilities of all earlier categories. While learning, those probabilities come from models that
had not seen the row (out-of-fold), so that later models meet inputs as good as they will be.

Terms are words and their first four to six letters: abuse is often inflected. A term becomes an
indicator when enough sampled toxic texts hold it and few others do; the strongest are kept.

Defined results: null and empty texts have no indicators and get the models' base rates; texts are
read whole; repeated rows get repeated results; without labelled rows, or with one class only,
every probability is the base rate (0 without rows); extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import materialize, table

#: At most so many labelled rows of each class are learned from, those with the smallest id hashes.
SAMPLE_ROWS = 10_000
#: At most so many indicator terms, each held by so many sampled toxic texts at least.
INDICATORS, SUPPORT = 4_000, 4
FOLDS = 5
THRESHOLD = 0.5
PREFIXES = (4, 5, 6)

#: Name and condition on the labelled rows, in the order of the chain. The last is toxicity as such.
CATEGORIES = (
    ("toxic_en", "toxic = 1 and lang = 'en'"),
    ("toxic_de", "toxic = 1 and lang = 'de'"),
    ("toxic_fr", "toxic = 1 and lang = 'fr'"),
    ("toxic_es", "toxic = 1 and lang = 'es'"),
    ("toxic", "toxic = 1"),
)

_words = re.compile(r"\w+").findall


def terms(text: str) -> set[str]:
    """Words, and prefixes marked with a star."""
    words = set(_words(text.lower()))
    return words.union(f"{w[:k]}*" for w in words for k in PREFIXES if len(w) > k)


@dataclass
class Chain:
    """One weight vector for each category: indicators, then earlier categories, then the bias."""

    names: tuple[str, ...]
    index: dict[str, int]
    weights: list[np.ndarray]

    def rows(self, text: str) -> list[int]:
        return [self.index[t] for t in terms(text) if t in self.index] if self.index else []

    def predict(self, sparse: list[list[int]]) -> np.ndarray:
        """Probabilities: one row for each text, one column for each category."""
        return run_chain(self.weights, csr(sparse), len(sparse), len(self.index))


def csr(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row number and column of each present indicator."""
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.fromiter((c for r in rows for c in r), np.int64, sum(map(len, rows)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def run_chain(weights: list[np.ndarray], x: tuple[np.ndarray, np.ndarray], n: int, width: int) -> np.ndarray:
    row, column = x
    out = np.zeros((n, len(weights)))
    for k, w in enumerate(weights):
        out[:, k] = sigmoid(np.bincount(row, w[column], n) + out[:, :k] @ w[width : width + k] + w[-1])
    return out


def fit_linear(x: tuple[np.ndarray, np.ndarray], earlier: np.ndarray, y: np.ndarray, width: int, steps: int = 150, rate: float = 0.3, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by full-batch Adam with an L2 penalty on all but the bias."""
    row, column = x
    n, k = len(y), earlier.shape[1]
    w = np.zeros(width + k + 1)
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if n else 1e-4
    w[-1] = np.log(share / (1 - share))
    if n == 0 or y.min() == y.max():
        return w
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        error = sigmoid(np.bincount(row, w[column], n) + earlier @ w[width : width + k] + w[-1]) - y
        g = np.concatenate([np.bincount(column, error[row], width), earlier.T @ error, [error.sum()]])
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * 0.5 ** (step / 50) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def fit_chain(rows: list[list[int]], y: np.ndarray, width: int, folds: np.ndarray, allowed: np.ndarray | None = None) -> list[np.ndarray]:
    """Each category's model on all rows; what it hands on while learning is out-of-fold.

    allowed: for each fold, and last for all rows, which indicators were chosen without that fold; all if not given.
    """
    x = csr(rows)
    allowed = np.ones((FOLDS + 1, width), bool) if allowed is None else allowed
    handed = np.zeros((len(rows), 0))
    weights = []
    for k in range(y.shape[1]):
        out = np.zeros(len(rows))
        for f in range(FOLDS):
            learn, test = folds != f, folds == f
            at = np.cumsum(learn) - 1
            known = allowed[f][x[1]]
            take = learn[x[0]] & known
            w = fit_linear((at[x[0][take]], x[1][take]), handed[learn], y[learn, k], width)
            z = np.bincount(x[0][known], w[x[1][known]], len(rows)) + handed @ w[width : width + k] + w[-1]
            out[test] = sigmoid(z[test])
        known = allowed[FOLDS][x[1]]
        w = fit_linear((x[0][known], x[1][known]), handed, y[:, k], width)
        w[:width][~allowed[FOLDS]] = 0
        weights.append(w)
        handed = np.column_stack([handed, out])
    return weights


def choose_indicators(sample: DataFrame, limit: int = INDICATORS, support: int = SUPPORT) -> tuple[list[str], np.ndarray]:
    """Terms that toxic texts hold far more often than others, and in which choices they are.

    One choice without each fold and one with all: what a fold's rows say decides nothing in the model
    that rates them. Terms are counted for each fold; the counts of at most 8 * limit terms are looked at.
    """
    each = range(FOLDS)

    def counts(kept: set | None):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: dict[str, list[int]] = {}
                for text, fold in zip(batch.column("text"), batch.column("fold").to_pylist()):
                    held = terms(text.as_py() or "")
                    for term in held if kept is None else held & kept:
                        found.setdefault(term, [0] * FOLDS)[fold] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *[pa.array([c[k] for c in found.values()], pa.int64()) for k in each]], names=["term", *[f"n{k}" for k in each]])

        return count

    def counted(rows: DataFrame, kept: set | None = None) -> DataFrame:
        found = rows.select("text", "fold").mapInArrow(counts(kept), "term string, " + ", ".join(f"n{k} long" for k in each))
        return found.groupBy("term").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in each])

    # Clean texts matter only for terms that toxic ones hold often enough: a first count drops the long tail.
    times = sum((F.col(f"n{k}") for k in each), F.lit(0))
    common = counted(sample.filter("toxic = 1")).withColumn("t", times).filter(F.col("t") >= support).orderBy(F.desc("t"), "term").limit(8 * limit)
    toxic = {r["term"]: [r[f"n{k}"] for k in each] for r in common.collect()}
    clean = {r["term"]: [r[f"n{k}"] for k in each] for r in counted(sample.filter("toxic = 0"), set(toxic)).collect()}
    rows_in = {(r["toxic"], r["fold"]): r["count"] for r in sample.groupBy("toxic", "fold").count().collect()}
    words = sorted(toxic)
    t = np.array([toxic[w] for w in words], np.int64).reshape(-1, FOLDS)
    c = np.array([clean.get(w, [0] * FOLDS) for w in words], np.int64).reshape(-1, FOLDS)
    size = {k: np.array([rows_in.get((k, f), 0) for f in each]) for k in (0, 1)}
    allowed = np.zeros((FOLDS + 1, len(words)), bool)
    for f in range(FOLDS + 1):
        seen = np.arange(FOLDS) != f
        ours, theirs = t[:, seen].sum(1), c[:, seen].sum(1)
        odds = (ours / max(size[1][seen].sum(), 1)) / ((theirs + 0.5) / max(size[0][seen].sum(), 1))
        strong = np.flatnonzero((ours >= support) & (odds >= 8))
        allowed[f, strong[np.argsort(-np.log(odds[strong]) * np.sqrt(ours[strong]), kind="stable")][:limit]] = True
    used = allowed.any(0)
    return [w for w, u in zip(words, used) if u], allowed[:, used]


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Fit on a bounded sample: at most sample_rows ids of each class go to the scan."""
    names = tuple(name for name, _ in categories)
    valid = labels.filter("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    of = lambda k: valid.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = materialize(of(0).unionByName(of(1)), "toxicity-sample")
    conditions = [F.coalesce(F.expr(c), F.lit(False)).cast("int").alias(f"y{k}") for k, (_, c) in enumerate(categories)]
    labelled = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")
    sample = materialize(labelled.select("text", "toxic", F.abs(F.xxhash64("doc_id") % FOLDS).cast("int").alias("fold"), F.array(*conditions).alias("y")), "toxicity-texts")
    words, allowed = choose_indicators(sample)
    chain = Chain(names, {t: i for i, t in enumerate(words)}, [])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [sorted(chain.rows(t.as_py() or "")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("y"), pa.array(x, pa.list_(pa.int64()))], names=["fold", "y", "x"])

    rows = sample.select("text", "fold", "y").mapInArrow(sparse, "fold int, y array<int>, x array<long>").collect()
    rows.sort(key=lambda r: (r["fold"], r["y"], r["x"]))  # tasks end in any order; sums of floats should not show it
    y = np.array([r["y"] for r in rows], dtype=np.float64).reshape(-1, len(names))
    chain.weights = fit_chain([r["x"] for r in rows], y, len(words), np.array([r["fold"] for r in rows], np.int64), allowed)
    return chain


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a probability p_<category> for each category, and toxic: whether the last one reaches the threshold."""
    columns = [f"p_{name}" for name in chain.names]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain.predict([chain.rows(t.as_py() or "") for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(p[:, k]) for k in range(p.shape[1])]], names=["doc_id", *columns])

    scored = docs.select("doc_id", "text").mapInArrow(rate, "doc_id bigint, " + ", ".join(f"{c} double" for c in columns))
    return scored.withColumn("toxic", (F.col(columns[-1]) >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
