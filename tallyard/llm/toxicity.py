"""Toxicity: subword-bag embeddings averaged into a linear softmax, both trained together.

A word is the bag of its character n-grams, with marks at both ends, hashed into BUCKETS embeddings; words that share
n-grams share vectors, so misspellings and endings not met in training are scored by what they have in common with
others. N-grams of fewer than LEAST_TEXTS texts of the sample have the zero vector. Words of over LONG_WORD bytes are
taken as several. Embeddings are averaged over a stretch of WINDOW words and go through a linear softmax. A text's score
is that of its worst stretch, so that a long text is not cleared by its length.

Training knows labels of texts only. Each text weighs as much as any other of its label, dealt out over its stretches:
at first evenly, then by how toxic the model finds them so far, so the worst stretches of either kind count most. The
softmax is linear in the average, so for scoring each bucket comes down to one number, a word to the mean of its
buckets' numbers, and a stretch to a moving mean.

Defined results: null and empty texts, and those without letters, score as a stretch without words does (the bias
alone); without labelled rows of both kinds all scores are 0; rows with null or repeated ids are scored row by row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, ship, text_of, thrifty
from .words import cut_long, labelled_sample, slices, split

BUCKETS = 1 << 17
DIMENSIONS = 4
GRAMS = (3, 4, 5)
WINDOW = 6
SAMPLE = {0: 1600, 1: 800}
LEAST_TEXTS = 10
MOST_BYTES = 100_000
#: Bytes from which on a word is taken as several.
LONG_WORD = 200
BYTES_AT_ONCE = 200_000
NOT_LETTERS = r"[^\p{L}]+"
_PRIME = np.uint64(0x100000001B3)


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of each word and of the whole word, and the number of the word it belongs to."""
    n = len(words)
    marked = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_binary()) if isinstance(x, bytes) else x for x in (b"<", words, b">", b"")))
    size = pc.binary_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(marked.to_pylist()), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(n), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))  # bytes from here to the word's end
    buckets, owners = [], []
    rolled = np.zeros(len(data), np.uint64)
    for g in range(1, max(GRAMS) + 1):
        rolled = rolled[: len(data) - g + 1] * _PRIME + data[g - 1 :] + np.uint64(1) if len(data) >= g else rolled[:0]
        if g in GRAMS:
            at = np.flatnonzero(left[: len(rolled)] >= g)
            buckets.append(rolled[at] ^ np.uint64(g))
            owners.append(word[at])
    powers = np.ones(int(size.max()) if n else 0, np.uint64)
    powers[1:] = _PRIME
    powers = np.multiply.accumulate(powers)
    starts = np.cumsum(size) - size
    whole = np.add.reduceat((data + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(starts, size)], starts) if n else np.zeros(0, np.uint64)
    buckets.append(whole)
    owners.append(np.arange(n))
    h = np.concatenate(buckets) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64), np.concatenate(owners)


def _windows(borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of stretches of WINDOW words within the texts, and the text of each."""
    starts = [np.arange(a, b, WINDOW) for a, b in zip(borders, borders[1:], strict=False)]
    return np.concatenate(starts), np.repeat(np.arange(len(starts)), [len(s) for s in starts])


class Model:
    """weights: a number for each bucket; bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def word_values(self, words: pa.Array) -> np.ndarray:
        """The mean of each word's buckets' weights, for words of some BYTES_AT_ONCE at a time."""
        ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False))
        cuts = np.unique([0, *np.searchsorted(ends, np.arange(BYTES_AT_ONCE, ends[-1] if len(words) else 0, BYTES_AT_ONCE)), len(words)])
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = words.slice(a, b - a)
            bucket, owner = subwords(part)
            out.append(np.bincount(owner, self.weights[bucket], minlength=len(part)) / np.bincount(owner, minlength=len(part)))
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, texts: pa.Array) -> np.ndarray:
        out = []
        for part in slices(texts):
            distinct, codes, borders = cut_long(*split(pc.utf8_lower(part), NOT_LETTERS), LONG_WORD)
            value = self.word_values(distinct)
            total = np.concatenate([[0], np.cumsum(value[codes])])
            worst = np.full(len(part), self.bias)
            for k, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
                if b > a:
                    w = min(WINDOW, b - a)
                    worst[k] += (total[a + w : b + 1] - total[a : b - w + 1]).max() / WINDOW
            out.append(1 / (1 + np.exp(-np.clip(worst, -50, 50))))
        return np.concatenate(out) if out else np.zeros(0)


def fit(sample: list[tuple[str, int]], steps: int = 45, even_steps: int = 12, rate: float = 0.1, least: int = LEAST_TEXTS, seed: int = 11) -> Model:
    """Embeddings and softmax by full-batch Adam. A stretch shorter than WINDOW counts as if filled up with nothing."""
    y = np.array([v for _, v in sample])
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), -50.0)
    rng = np.random.default_rng(seed)
    distinct, codes, borders = cut_long(*split(pc.utf8_lower(pa.array([t for t, _ in sample], pa.large_string())), NOT_LETTERS), LONG_WORD)
    bucket, owner = subwords(distinct)
    per_word = np.bincount(owner, minlength=len(distinct)).astype(np.float32)
    texts_of = np.zeros(BUCKETS, np.int64)  # in how many texts each bucket is met
    by_word = np.split(bucket[np.argsort(owner, kind="stable")], np.cumsum(per_word.astype(np.int64))[:-1])
    for i, j in zip(borders, borders[1:], strict=False):
        if j > i:
            texts_of[np.unique(np.concatenate([by_word[w] for w in np.unique(codes[i:j])]))] += 1
    del by_word
    known = texts_of[bucket] >= least
    bucket, owner = bucket[known], owner[known].astype(np.int32)
    used, bucket = np.unique(bucket, return_inverse=True)
    starts, text = _windows(borders)
    window = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
    target = y[text].astype(np.float32)
    E = rng.normal(0, 0.02, (len(used), DIMENSIONS)).astype(np.float32)
    W = rng.normal(0, 1.0, (DIMENSIONS, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)

    def averages():
        words = np.stack([np.bincount(owner, E[bucket, d], minlength=len(distinct)) for d in range(DIMENSIONS)], axis=1) / per_word[:, None]
        return np.stack([np.bincount(window, words[codes, d], minlength=len(starts)) for d in range(DIMENSIONS)], axis=1).astype(np.float32) / WINDOW

    texts_of_label = np.bincount(y, minlength=2)
    by_text = np.flatnonzero(np.diff(text, prepend=-1))  # texts without words have no stretch
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (E, W, b)]
    for t in range(1, steps + 1):
        x = averages()
        z = x @ W + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        margin = z[:, 1] - z[:, 0] if t > even_steps else np.zeros(len(z), np.float32)
        near = np.exp(margin - np.maximum.reduceat(margin, by_text)[np.cumsum(np.diff(text, prepend=-1) > 0) - 1])
        live = near / np.bincount(text, near)[text] * (0.5 / texts_of_label)[y[text]]
        g = ((p - np.stack([1 - target, target], axis=1)) * live[:, None]).astype(np.float32)
        gx = (g @ W.T) / WINDOW
        gword = np.stack([np.bincount(codes, gx[window, d], minlength=len(distinct)) for d in range(DIMENSIONS)], axis=1) / per_word[:, None]
        gE = np.stack([np.bincount(bucket, gword[owner, d], minlength=len(used)) for d in range(DIMENSIONS)], axis=1).astype(np.float32)
        for q, grad, (m, v) in zip((E, W, b), (gE, x.T @ g, g.sum(0)), moments, strict=True):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad**2
            q -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)).astype(np.float32)
    weights = np.zeros(BUCKETS)
    weights[used] = E @ (W[:, 1] - W[:, 0])
    return Model(weights, float(b[1] - b[0]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model fitted on a bounded sample: up to SAMPLE rows of each label, of texts up to MOST_BYTES."""
    return fit(labelled_sample(docs, labels, "toxic", SAMPLE, MOST_BYTES))


def score(spark: SparkSession, docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= limit) of every row."""
    ship(spark)
    given = spark.sparkContext.broadcast(model)

    def mark(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(given.value.score(b.column("text")))], ["doc_id", "score"])

    out = docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(thrifty(mark), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def without_toxic(spark: SparkSession, docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """Rows of docs, all columns, that score below limit. Rows pass through the workers, without a shuffle."""
    ship(spark)
    given, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(given.value.score(b.column(at)) < limit))

    return docs.mapInArrow(thrifty(keep), docs.schema)
