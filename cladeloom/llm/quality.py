"""Quality classifier: random-indexing word vectors, pooled, and a small numpy network.

Every token bucket has a sparse random index vector; a bucket's context vector is the sum of the
index vectors that stand within two tokens of it in the training sample.  A word vector is index
and context vector together.  A document is the mean of its word vectors over its tokens and over
its distinct tokens.  A network with one hidden layer of tanh units and one output is fitted with
Adam; its probabilities are calibrated by one temperature, fitted on a part of the sample that
the network did not see.

Tokens are runs of letters (lower-cased), of digits and of other signs, and two marks: an
upper-case word and a word equal to the one before it.

Parameters bound what is learned and shipped: at most ``TRAIN_ROWS`` labelled documents, and
tables of ``BUCKETS`` rows.  Scoring covers every whole text, in one pass without a shuffle.

Defined cases: null and empty texts get the score of a document without tokens (a zero vector);
repeated rows get equal scores; a missing or one-sided label table gives every document the score
of its label share (0.5 without labels); null ids are scored, held_out is null; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, with_bytes
from .labelled import fold, training_sample

TRAIN_ROWS = 8000
BUCKETS = 1 << 15
DIM = 48
SPARSE = 6
HIDDEN = 24
FOLDS, HELD_OUT = 5, 0
CACHE = 300_000
THRESHOLD = 0.3

_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
_UPPER, _REPEAT = 0, 1  # buckets of the two marks


def index_vectors(seed: int = 17) -> np.ndarray:
    """One sparse ternary vector per bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIM), np.float32)
    at = rng.integers(0, DIM, (BUCKETS, SPARSE))
    sign = rng.choice(np.array([-1, 1], np.float32), (BUCKETS, SPARSE))
    np.add.at(out, (np.arange(BUCKETS)[:, None], at), sign)
    return out


class Buckets(dict):
    """Token to bucket, with the upper-case mark in the sign; a bounded cache."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        word = token.decode("utf-8", "replace")
        low = word.lower()
        b = 2 + xxhash.xxh64_intdigest(low.encode(), 7) % (BUCKETS - 2)
        value = -b if len(word) > 1 and word.isupper() else b
        self[token] = value
        return value


def token_ids(raw: bytes, buckets: Buckets) -> np.ndarray:
    found = _TOKEN.findall(raw)
    if not found:
        return np.empty(0, np.int64)
    ids = np.array([buckets[t] for t in found], np.int64)
    upper = ids < 0
    ids = np.abs(ids)
    again = np.zeros(len(ids), bool)
    again[1:] = ids[1:] == ids[:-1]
    marks = np.concatenate([np.full(int(upper.sum()), _UPPER), np.full(int(again.sum()), _REPEAT)])
    return np.concatenate([ids, marks]) if len(marks) else ids


def add_contexts(ids: np.ndarray, index: np.ndarray, into: np.ndarray) -> None:
    """Add the index vectors within two tokens; the marks at the end are context as well."""
    for shift in (1, 2):
        if len(ids) > shift:
            np.add.at(into, ids[shift:], index[ids[:-shift]])
            np.add.at(into, ids[:-shift], index[ids[shift:]])


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector over tokens and over distinct tokens."""
    if not len(ids):
        return np.zeros(2 * vectors.shape[1], np.float32)
    own, n = np.unique(ids, return_counts=True)
    rows = vectors[own]
    return np.concatenate([(n[None].astype(np.float32) / len(ids)) @ rows, rows.mean(axis=0, keepdims=True)], axis=1)[0]


def word_vectors(contexts: np.ndarray, index: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(contexts, axis=1, keepdims=True)
    return np.concatenate([index / np.sqrt(SPARSE), contexts / np.maximum(norm, 1.0)], axis=1).astype(np.float32)


@dataclass
class Network:
    """Standardised inputs, tanh hidden units, one logit, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def constant(p: float, width: int) -> Network:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on the log loss; a fifth of the rows is kept for the temperature."""
    if len(np.unique(y)) < 2:
        return constant(float(y.mean()) if len(y) else 0.5, x.shape[1])
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    late, own = order[:cut], order[cut:]
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    z = (x - mean) / scale
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    step = 0
    for _ in range(epochs):
        deal = rng.permutation(own)
        for at in range(0, len(deal), 128):
            rows = deal[at : at + 128]
            h = np.tanh(z[rows] @ net.w1 + net.b1)
            d = (sigmoid(h @ net.w2 + net.b2) - y[rows]) / len(rows)
            dh = d[:, None] * net.w2 * (1 - h * h)
            grads = [z[rows].T @ dh + decay * net.w1, dh.sum(axis=0), h.T @ d + decay * net.w2, np.array([d.sum()])]
            step += 1
            moves = []
            for m, g in zip(moments, grads):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                moves.append(rate * m[0] / (1 - 0.9**step) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))
            net.w1, net.b1, net.w2, net.b2 = net.w1 - moves[0], net.b1 - moves[1], net.w2 - moves[2], net.b2 - float(moves[3][0])
    net.temperature = temperature(net.logits(x[late]), y[late])
    return net


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    loss = lambda t: float(np.mean(np.logaddexp(0, logits / np.exp(t)) - y * logits / np.exp(t)))
    lo, hi, g = -2.0, 2.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, Network]:
    """Word vectors and network from a bounded sample."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    sample = scratch.table(training_sample(docs, labels, label, folds, held_out, rows, id_col, text_col).repartition(8, "id"), "sample")
    index = index_vectors()

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, buckets, vectors = np.zeros((BUCKETS, DIM), np.float32), Buckets(), index_vectors()
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                add_contexts(token_ids(raw, buckets), vectors, table)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["part"])

    total = np.zeros((BUCKETS, DIM), np.float32)
    for part in sample.select("raw").coalesce(8).mapInArrow(contexts, "part binary").toLocalIterator():
        total += np.frombuffer(part[0], np.float32).reshape(BUCKETS, DIM)
    vectors = word_vectors(total, index)
    shared = spark.sparkContext.broadcast(vectors)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            got = [pool(token_ids(raw, buckets), shared.value).astype(np.float32).tobytes() for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.binary())], names=["id", "y", "x"])

    kind = sample.schema["id"].dataType.simpleString()
    got = sample.mapInArrow(pooled, f"id {kind}, y int, x binary").toPandas().sort_values(["id", "x"], kind="stable")
    x = np.stack([np.frombuffer(v, np.float32) for v in got["x"]]) if len(got) else np.zeros((0, 2 * vectors.shape[1]), np.float32)
    scratch.close(sample)
    return vectors, fit(x, got["y"].to_numpy(float))


def score(docs: DataFrame, vectors: np.ndarray, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = shared.value
        buckets = Buckets()
        for batch in batches:
            x = np.stack([pool(token_ids(raw, buckets), table) for raw in batch.column(1).to_pylist()]) if batch.num_rows else np.zeros((0, len(model.mean)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(x.astype(np.float64)), pa.float64())], names=[id_col, "score"])

    return with_bytes(docs, text_col).select(id_col, "_bytes").mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, in one pass."""
    vectors, net = train(docs, labels, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = shared.value
        buckets = Buckets()
        for batch in batches:
            if batch.num_rows:
                x = np.stack([pool(token_ids((t or "").encode(), buckets), table) for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(model.probability(x.astype(np.float64)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    vectors, net = train(docs, read(spark, sf_dir, "labels"))
    got = score(docs, vectors, net)
    return got.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
