"""Quality: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Every word has a sparse ternary index vector, fixed by a hash of its bytes, so no word is unknown. Its context vector
is the sum of the index vectors of the words next to it in the sample, so words used alike have vectors alike; a
word's vector is both together. A document is the mean over all its words, beside the mean over its distinct words,
which tells text from repetition. The network has one hidden layer of rectified units; its logit is divided by a
temperature fitted on rows of the sample that it was not trained on.

Words are split at white space, and runs of punctuation are words too, in the case they are written in.

Defined results: null and empty texts score as a zero vector does; without labelled rows of both kinds all scores are
0; rows with null or repeated ids are scored row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, ship, text_of, thrifty
from .words import labelled_sample, slices, split

BUCKETS = 1 << 16
DIMENSIONS = 32
NONZERO = 4
HIDDEN = 32
SAMPLE = {0: 1600, 1: 2400}
MOST_BYTES = 100_000


def index_vectors(seed: int = 5) -> np.ndarray:
    """NONZERO entries of +1 or -1 for each bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    at = rng.random((BUCKETS, DIMENSIONS)).argsort(1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.float32([-1, 1]), at.shape), 1)
    return out


def buckets(words: pa.Array) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % BUCKETS for w in words.to_pylist()), np.int64, len(words))


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    out = []
    for part in slices(texts):
        distinct, codes, borders = split(part, None)
        at = buckets(distinct)
        x = np.zeros((len(part), 2 * DIMENSIONS + 2), np.float32)
        for k, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
            if b > a:
                own, n = np.unique(codes[a:b], return_counts=True)
                v = vectors[at[own]]
                x[k, :DIMENSIONS] = (n[:, None] * v).sum(0) / (b - a)
                x[k, DIMENSIONS:-2] = v.mean(0)
                x[k, -2:] = len(own) / (b - a), np.log1p(b - a) / 10
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, 2 * DIMENSIONS + 2), np.float32)


class Model:
    """Word vectors by bucket, scales of the features, the layers, and the temperature."""

    def __init__(self, vectors, mean, scale, layers, temperature):
        self.vectors, self.mean, self.scale, self.layers, self.temperature = vectors, mean, scale, layers, temperature

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.maximum((x - self.mean) / self.scale @ a + b, 0) @ c + d

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.layers is None:
            return np.zeros(len(texts))
        z = self.logit(pooled(texts, self.vectors)).astype(np.float64) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def word_vectors(texts: list[str]) -> np.ndarray:
    index = index_vectors()
    context = np.zeros_like(index)
    for part in slices(pa.array(texts, pa.large_string())):
        distinct, codes, borders = split(part, None)
        at = buckets(distinct)[codes]
        inner = np.ones(len(at), bool)
        inner[borders[:-1][borders[:-1] < len(at)]] = False  # a text's first word has no neighbour before it
        right = np.flatnonzero(inner)
        for d in range(DIMENSIONS):
            context[:, d] += np.bincount(at[right - 1], index[at[right], d], minlength=BUCKETS) + np.bincount(at[right], index[at[right - 1], d], minlength=BUCKETS)
    size = np.linalg.norm(context, axis=1, keepdims=True)
    return (index / np.sqrt(NONZERO) + context / np.maximum(size, 1)).astype(np.float32)


def fit(sample: list[tuple[str, int]], steps: int = 300, seed: int = 3) -> Model:
    """Layers by Adam on four fifths of the sample, both labels weighing the same; the temperature on the rest."""
    y = np.array([v for _, v in sample], np.float32)
    if not len(y) or y.min() == y.max():
        return Model(None, None, None, None, 1.0)
    rng = np.random.default_rng(seed)
    texts = [t for t, _ in sample]
    vectors = word_vectors(texts)
    x = pooled(pa.array(texts, pa.large_string()), vectors)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    apart = rng.permutation(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    model = Model(vectors, mean, scale, None, 1.0)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    moments = [(np.zeros_like(q), np.zeros_like(q)) for q in p]
    tx, ty = x[~apart], y[~apart]
    weight = np.where(ty == 1, 0.5 / max(1, ty.sum()), 0.5 / max(1, (1 - ty).sum()))
    for t in range(1, steps + 1):
        h = np.maximum(tx @ p[0] + p[1], 0)
        g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - ty) * weight
        gh = np.outer(g, p[2]) * (h > 0)
        for q, grad, (m, v) in zip(p, (tx.T @ gh + 1e-4 * p[0], gh.sum(0), h.T @ g + 1e-4 * p[2], g.sum()), moments, strict=True):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.999
            v += 0.001 * grad**2
            q -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.layers = tuple(p)
    if apart.any():
        z = np.maximum(x[apart] @ p[0] + p[1], 0) @ p[2] + p[3]
        loss = lambda t: np.logaddexp(0, -(2 * y[apart] - 1) * z / t).mean()
        model.temperature = float(min(np.geomspace(0.25, 16, 49), key=loss))
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model fitted on a bounded sample: up to SAMPLE rows of each label, of texts up to MOST_BYTES."""
    return fit(labelled_sample(docs, labels, "quality", SAMPLE, MOST_BYTES))


def score(spark: SparkSession, docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= limit) of every row."""
    ship(spark)
    given = spark.sparkContext.broadcast(model)

    def mark(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(given.value.score(b.column("text")))], ["doc_id", "score"])

    out = docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(thrifty(mark), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
