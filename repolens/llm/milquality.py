"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from what its bytes and words look like; gated
attention weighs the encodings, and the weighted sum is scored. Only the document's label is known: the
attention weights, the encoder and the scorer are learned together from it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import blocks, drawn, stored, text_bytes

#: Bytes of a passage, cut after white space.
PASSAGE = 1024
#: Labelled documents to learn from, and passages of a document that train at most, drawn from its whole text.
SAMPLE, SAMPLE_PASSAGES = 4000, 64
HIDDEN, GATES, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 16, 30, 64, 3e-3, 1e-4, 7

_CLASSES = 13


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, 0, np.uint8)  # control bytes
    kinds[ord("a") : ord("z") + 1] = 1
    kinds[ord("A") : ord("Z") + 1] = 2
    kinds[ord("0") : ord("9") + 1] = 3
    kinds[[32, 9]] = 4
    kinds[[10, 13]] = 5
    for i, group in enumerate((b".", b",;:", b"!?", b"'\"-()", b"#$%&*+=@\\^_`~", b"|<>[]{}/"), 6):
        kinds[list(group)] = i
    kinds[128:] = 12
    return kinds


FEATURES = _CLASSES * _CLASSES + 6


def _encoded(part: bytes, kinds: np.ndarray) -> np.ndarray:
    codes = kinds[np.frombuffer(part, np.uint8)].astype(np.int32)
    x = np.zeros(FEATURES, np.float32)
    if len(codes) > 1:
        pairs = np.bincount(codes[:-1] * _CLASSES + codes[1:], minlength=_CLASSES * _CLASSES)
        x[: _CLASSES * _CLASSES] = np.sqrt(pairs / (len(codes) - 1))
    words = part.split()
    n = len(words)
    if n:
        distinct = len(set(words))
        x[-6:] = (
            distinct / n, sum(map(eq, words, words[1:])) / n, sum(map(bytes.isupper, words)) / n,
            min(len(part) / n, 40) / 10, part.count(b"\n") / n, len(part) / PASSAGE,
        )
    return x


def passage_features(text: bytes, kinds: np.ndarray) -> Iterator[np.ndarray]:
    """Features of the passages of a text, up to 256 passages at a time; one row of zeros for an empty text."""
    rows: list[np.ndarray] = []
    for part in blocks(text, PASSAGE):
        rows.append(_encoded(part, kinds))
        if len(rows) == 256:
            yield np.stack(rows)
            rows = []
    if rows or not text:
        yield np.stack(rows) if rows else np.zeros((1, FEATURES), np.float32)


def sampled_features(text: bytes, kinds: np.ndarray, most: int) -> np.ndarray:
    """Features of all passages of a text, or of ``most`` drawn from the whole of a longer one."""
    count = sum(1 for _ in blocks(text, PASSAGE))
    if count <= most:
        return np.concatenate(list(passage_features(text, kinds)))
    places = set(drawn(count, most, zlib.crc32(text)).tolist())
    return np.stack([_encoded(part, kinds) for i, part in enumerate(blocks(text, PASSAGE)) if i in places])


class Weights(NamedTuple):
    encode: np.ndarray
    encode_bias: np.ndarray
    tanh: np.ndarray
    gate: np.ndarray
    attend: np.ndarray
    score: np.ndarray
    score_bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _start(rng: np.random.Generator) -> list[np.ndarray]:
    def random(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    return [random(FEATURES, HIDDEN), np.zeros(HIDDEN), random(HIDDEN, GATES), random(HIDDEN, GATES), random(GATES), random(HIDDEN), np.zeros(1)]


def _gradients(w: Weights, x: np.ndarray, starts: np.ndarray, bags: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss over bags; ``starts`` is each bag's first passage, ``bags`` the bag of each passage."""
    h = np.tanh(x @ w.encode + w.encode_bias)
    t, g = np.tanh(h @ w.tanh), _sigmoid(h @ w.gate)
    e = np.exp((t * g) @ w.attend)
    a = e / np.add.reduceat(e, starts)[bags]
    z = np.add.reduceat(a[:, None] * h, starts)
    d_logit = (_sigmoid(z @ w.score + w.score_bias) - labels) / len(labels)
    d_z = d_logit[:, None] * w.score
    d_a = (d_z[bags] * h).sum(1)
    d_s = a * (d_a - np.add.reduceat(a * d_a, starts)[bags])
    d_tg = d_s[:, None] * w.attend
    d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
    d_h = a[:, None] * d_z[bags] + d_t @ w.tanh.T + d_g @ w.gate.T
    d_pre = d_h * (1 - h * h)
    return [x.T @ d_pre, d_pre.sum(0), h.T @ d_t, h.T @ d_g, (t * g).T @ d_s, z.T @ d_logit, d_logit.sum(keepdims=True)]


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: Weights


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Model:
    """Adam on shuffled batches of documents; ``counts`` passages each, in the order of ``x``."""
    rng = np.random.default_rng(SEED)
    mean, scale = x.mean(0), x.std(0) + 1e-2
    x = (x - mean) / scale
    first = np.concatenate([[0], np.cumsum(counts)])
    params = _start(rng)
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            sizes = counts[docs]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            grads = _gradients(Weights(*params), x[rows], starts, np.repeat(np.arange(len(docs)), sizes), labels[docs])
            step += 1
            for i, g in enumerate(grads):
                g = g + DECAY * params[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] = params[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, Weights(*params))


def score_text(model: Model, text: bytes, kinds: np.ndarray) -> float:
    """The whole text's score; passages are read in blocks, as attention is a ratio of two sums."""
    w = model.weights
    upper, lower = np.zeros(HIDDEN), 0.0
    for x in passage_features(text, kinds):
        h = np.tanh(((x - model.mean) / model.scale) @ w.encode + w.encode_bias)
        e = np.exp((np.tanh(h @ w.tanh) * _sigmoid(h @ w.gate)) @ w.attend)
        upper += e @ h
        lower += e.sum()
    return float(_sigmoid(upper / lower @ w.score + w.score_bias)[0])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE,
          sample_passages: int = SAMPLE_PASSAGES, text: str = "text", doc_id: str = "doc_id") -> Model | float:
    """The model of at most ``sample`` labelled documents, drawn by hash of their ids, with at most
    ``sample_passages`` passages of each, drawn from its whole text. With labels of one kind only, or none, a number:
    the share of ones, or 0.5. Labels other than 0 and 1 and null ids are not used; of documents that
    repeat an id, each has its label."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).where("y in (0, 1) and id is not null").distinct()
    drawn = stored(known.orderBy(F.xxhash64("id"), "id", "y").limit(sample), "drawn")
    bags = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).join(drawn, F.col("doc") == F.col("id"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _byte_classes()
        for batch in batches:
            for doc, y, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                x = sampled_features(content, kinds, sample_passages)
                yield pa.RecordBatch.from_pydict({"id": pa.array([doc], pa.int64()), "y": pa.array([float(y)]), "n": pa.array([len(x)], pa.int32()), "x": pa.array([x.tobytes()])})

    got = bags.select(F.col("id").cast("long").alias("id"), "y", "text").mapInArrow(features, "id long, y double, n int, x binary").toArrow()
    rows = sorted(zip(got["id"].to_pylist(), got["y"].to_pylist(), got["x"].to_pylist(), strict=True))
    y = np.array([r[1] for r in rows])
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.5
    bags_x = [np.frombuffer(r[2], np.float32).reshape(-1, FEATURES) for r in rows]
    return fit(np.concatenate(bags_x).astype(np.float64), np.array([len(b) for b in bags_x]), y)


def with_quality(docs: DataFrame, model: Model | float, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text from 0 to 1, higher for label 1. A null counts as an
    empty text, which has one passage without features. A column named
    ``name`` is replaced."""
    plain = model if isinstance(model, float) else (model.mean, model.scale, tuple(model.weights))
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        kinds, got = _byte_classes(), shared.value
        if isinstance(got, float):
            return pa.array([got] * len(texts), pa.float64())
        model = Model(got[0], got[1], Weights(*got[2]))
        return pa.array([score_text(model, x, kinds) for x in text_bytes(texts)], pa.float64())

    return docs.withColumn(name, score(F.col(text)))
