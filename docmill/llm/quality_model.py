"""Quality classifier with supervised subword embeddings.

Features of a text: every word, every character n-gram of ``NGRAMS`` bytes
within a word (with the blank before and after it), and for every word the
power of two below the number of its earlier occurrences in the text; each is
hashed into one of 2**``BITS`` buckets. Every bucket has a learned vector; a
document is the average of its features' vectors, and a softmax over two
labels is put on top. Vectors and output are trained together by stochastic
gradient descent in numpy, with a step per vector that shrinks with what it
has moved (Adagrad).

As average and output are both linear, scoring needs one number for each
bucket: its vector times the output's difference between the labels.

Bounds: at most ``MAX_DOCS`` labelled documents of each label, those with the
smallest hash of the id, are used for training; their features, summed by
bucket, are collected. All texts are scored whole, with constant memory.

Edge cases: null and empty texts have the one feature "empty"; without rows of
both labels every score is the share of label 1 among the training rows (0.5
without any). Null ids are scored and never used for training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches
from .toxicity import _worker_model, fold, training_ids

BITS = 17
NGRAMS = (3, 4)
DIM = 8
EPOCHS = 6
RATE = 0.3
MINI_BATCH = 32
MAX_DOCS = 1_200
THRESHOLD = 0.7
SEED = 20240115

_TABLE = bytes(32 if 9 <= i <= 13 else i for i in range(256))
_POWERS = np.power(np.uint64(0x9E3779B97F4A7C15), np.arange(256, dtype=np.uint64))


def _bucket(x: np.ndarray, salt: int) -> np.ndarray:
    z = (x + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (z >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: str | None) -> np.ndarray:
    """Bucket of each feature of the text, in no order."""
    raw = (text or "").encode().translate(_TABLE).strip(b" ")
    if not raw:
        return _bucket(np.zeros(1, np.uint64), 99)
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint64)
    word = b != 32
    got = []
    for n in NGRAMS:
        if len(b) >= n:
            g, ok = np.zeros(len(b) - n + 1, np.uint64), np.ones(len(b) - n + 1, bool)
            for i in range(n):
                g |= b[i:len(b) - n + 1 + i] << np.uint64(8 * i)
                if 0 < i < n - 1:
                    ok &= word[i:len(b) - n + 1 + i]
            got.append(_bucket(g[ok], n))
    start = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    length = np.flatnonzero(word[:-1] & ~word[1:]) + 1 - start
    place = np.arange(len(b)) - np.repeat(np.r_[0, start], np.diff(np.r_[0, start, len(b)]))
    h = np.add.reduceat(np.where(word, b + np.uint64(1), np.uint64(0)) * _POWERS[place & 255], start) + length.astype(np.uint64)
    got.append(_bucket(h, 1))
    # how often each word came before
    order = np.argsort(h, kind="stable")
    first = np.r_[True, h[order][1:] != h[order][:-1]]
    before = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    got.append(_bucket(np.log2(before + 1).astype(np.uint64), 2))
    return np.concatenate(got)


class Model:
    def __init__(self, per_bucket: np.ndarray, bias: float):
        self.per_bucket, self.bias = per_bucket, bias

    def score(self, text: str | None) -> float:
        z = float(self.per_bucket[features(text)].mean(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """From (label, buckets, share of each) of the training documents."""
    rng = np.random.default_rng(SEED)
    n = 1 << BITS
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (n, DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    moved, moved_out = np.full(n, 1e-8, np.float32), np.full((DIM + 1, 2), 1e-8, np.float32)
    weight = np.array([len(rows) / 2 / max(1, sum(r[0] == v for r in rows)) for v in (0, 1)], np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(rows))
        for s in range(0, len(rows), MINI_BATCH):
            part = [rows[i] for i in order[s:s + MINI_BATCH]]
            y = np.array([r[0] for r in part])
            idx, val = np.concatenate([r[1] for r in part]), np.concatenate([r[2] for r in part])
            sizes = np.array([len(r[1]) for r in part])
            hidden = np.add.reduceat(vectors[idx] * val[:, None], np.r_[0, np.cumsum(sizes)[:-1]])
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            err = (p - np.eye(2, dtype=np.float32)[y]) * weight[y][:, None] / len(part)
            back = err @ out.T
            uniq, inv = np.unique(idx, return_inverse=True)
            grad = np.zeros((len(uniq), DIM), np.float32)
            np.add.at(grad, inv, val[:, None] * np.repeat(back, sizes, axis=0))
            grad_out = np.vstack([hidden.T @ err, err.sum(axis=0)])
            moved[uniq] += (grad * grad).mean(axis=1)
            moved_out += grad_out * grad_out
            vectors[uniq] -= rate * grad / np.sqrt(moved[uniq])[:, None]
            step = rate * grad_out / np.sqrt(moved_out)
            out -= step[:-1]
            bias -= step[-1]
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality") -> Model:
    # at most 2 * MAX_DOCS rows of 12 bytes
    ids = F.broadcast(training_ids(labels, label, usable, MAX_DOCS))
    rows = docs.select("doc_id", "text").join(ids, "doc_id").select(F.col("y").cast("int").alias("y"), "text")
    schema = "y int, buckets binary, shares binary"

    def run(it):
        out = pa.schema([("y", pa.int32()), ("buckets", pa.binary()), ("shares", pa.binary())])

        def got(b):
            for y, t in zip(b.column(0).to_pylist(), b.column(1)):
                idx, n = np.unique(features(t.as_py()), return_counts=True)
                yield y, idx.astype("<i4").tobytes(), (n / n.sum()).astype("<f4").tobytes()

        for b in it:
            yield from batches(got(b), out)

    found = [(r["y"], np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["shares"], "<f4"))
             for r in rows.mapInArrow(run, schema).orderBy("y", F.xxhash64("buckets", "shares")).toLocalIterator()]
    if len({r[0] for r in found}) < 2:
        share = np.mean([r[0] for r in found]) if found else 0.5
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    return fit(found)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` without its text, with ``out``, the probability of label 1."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(f for f in docs.schema if f.name != text), T.StructField(out, T.DoubleType())])

    def run(it):
        model = _worker_model(shared)
        for b in it:
            got = [model.score(t.as_py()) for t in b.column(b.schema.names.index(text))]
            others = [(f.name, b.column(i)) for i, f in enumerate(b.schema) if f.name != text]
            yield pa.record_batch([*(c for _, c in others), pa.array(got, pa.float64())], names=[*(n for n, _ in others), out])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels, fold("doc_id", 4) != 2)
    got = score(docs.select("doc_id", "text"), model)
    return got.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
