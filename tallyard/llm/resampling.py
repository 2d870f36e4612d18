"""Importance resampling towards a target corpus: weights from hashed word features, then an exact draw by threshold.

Two passes of counts, an array of `buckets` numbers for each corpus, give every bucket's gain; a second pass over the
texts adds the gains up by array lookup. Scores (weight plus Gumbel noise of the id) are stored. The cutoff is found by
bisection of the numbers themselves: each job counts the rows at or above PROBES points between the bounds (five halvings
at once), first of the score, then, among rows that tie at it, of doc_id. Rows beyond the cutoff are dealt by ranges and
numbered in their order; no task and not the driver ever sees them all.

Defined results: null and empty texts have no features and weight 0, and no part in the draw unless it asks for no words
at all; null ids count as the empty text in the noise and come last among ties; rows that repeat an id are rows of their
own, the ones that tie in score and id ordered by n_features and weight, and then as stored; an empty table gives no
rows; an empty target or an empty corpus has only the counts that are added to all buckets; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, ship, text_of, thrifty
from .scans import scan
from .words import slices, split

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PROBES = 31


def features(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some texts at a time: the bucket of every run of 1 to `longest` words, the text that each run is of (counted
    from 0 within those texts), and the texts' numbers of words."""
    for part in slices(texts):
        distinct, codes, borders = split(pc.ascii_lower(part), BETWEEN_WORDS)
        spelt = distinct.to_pylist()
        sums = np.array([crc32(w) for w in spelt], np.int64)
        text = np.repeat(np.arange(len(part)), np.diff(borders))
        found, owner = [sums[codes] % buckets], [text]
        runs, crcs = codes.astype(np.int64), sums
        for n in range(2, longest + 1):
            if len(codes) < n:
                break
            here = text[: len(codes) - n + 1] == text[n - 1 :]
            # A run is the run without its last word, and that word.
            pairs, number = np.unique(runs[: len(codes) - n + 1] * len(spelt) + codes[n - 1 :], return_inverse=True)
            crcs = np.array([crc32(b" " + spelt[p % len(spelt)], int(crcs[p // len(spelt)])) for p in pairs.tolist()], np.int64)
            runs = number.astype(np.int64)
            found.append(crcs[runs[here]] % buckets)
            owner.append(text[: len(codes) - n + 1][here])
        yield np.concatenate(found), np.concatenate(owner), np.diff(borders)


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; a task sends one row a bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for found, _, _ in features(b.column("text"), longest, buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    rows = texts.select(text_of(texts).alias("text")).mapInArrow(thrifty(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most `buckets` rows
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The logarithm of each bucket's share in the target over that in the corpus, one more in every bucket, in thousandths."""
    s, t, n = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the id's SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def score(spark: SparkSession, docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of docs, stored."""
    ship(spark)
    given = spark.sparkContext.broadcast(gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets)))  # `buckets` numbers

    def weigh(batches):
        for b in batches:
            words, runs, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for found, owner, n in features(b.column("text"), longest, buckets):
                words.append(n)
                runs.append(np.bincount(owner, minlength=len(n)))
                total = np.zeros(len(n), np.int64)
                np.add.at(total, owner, given.value[found])
                sums.append(total)
            n = np.concatenate(runs)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, pa.int64()) for x in (np.concatenate(words), n, np.concatenate(sums) // np.maximum(n, 1))]], ["doc_id", "n_words", "n_features", "weight"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(thrifty(weigh), "doc_id long, n_words long, n_features long, weight long")
    return settle(out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")


def _narrowed(rows: DataFrame, at_least: Column | None, counted, low: int, high: int, need: int) -> int:
    """The first number from low to high whose count is `need` or more; counted(x) counts rows up to x, and that for high
    is known to be enough. Each job counts at PROBES points between the bounds."""
    rows = rows if at_least is None else rows.where(at_least)
    while low < high:
        points = sorted({low + (high - low) * k // (PROBES + 1) for k in range(PROBES + 1)})
        counts = rows.agg(*[F.count_if(counted(p)).alias(f"c{k}") for k, p in enumerate(points)]).first()
        enough = [p for k, p in enumerate(points) if counts[k] >= need]
        short = [p for k, p in enumerate(points) if counts[k] < need]
        low, high = max([low, *[p + 1 for p in short]]), min([high, *enough])
    return low


def cutoff(rows: DataFrame, need: int) -> tuple[int, int | None]:
    """(score, doc_id) of the `need`-th row by score, largest first, then doc_id; None is the null id, which comes last.
    rows: score and doc_id, with at least `need` > 0 rows."""
    ends = rows.agg(F.min("score"), F.max("score")).first()
    least = -_narrowed(rows, None, lambda x: F.col("score") >= -x, -ends[1], -ends[0], need)
    at = F.col("score") == least
    r = rows.agg(F.count_if(F.col("score") > least), F.count_if(at & F.col("doc_id").isNotNull()), F.min(F.when(at, F.col("doc_id"))), F.max(F.when(at, F.col("doc_id")))).first()
    rest = need - r[0]
    if r[1] < rest:
        return least, None
    return least, _narrowed(rows, at, lambda x: F.col("doc_id") <= x, r[2], r[3], rest)


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score of every row of docs, and rank: its place in the draw, else null.

    Of the N rows with at least min_words words the floor(percent * N / 100) of the highest scores are drawn.
    """
    rows = score(spark, docs, target, longest, buckets, seed)
    able = F.col("n_words") >= min_words
    draws = rows.where(able).count() * percent // 100
    if not draws:
        return rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    least, doc_id = cutoff(rows.where(able), draws)
    tied = (F.col("score") == least) & (F.lit(True) if doc_id is None else F.col("doc_id") <= doc_id)
    drawn = F.coalesce(able & ((F.col("score") > least) | tied), F.lit(False))
    # Stored rows have a number of their own, so that even rows that are alike are dealt to several ranges.
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("row")]
    first = scan(rows.where(drawn).withColumn("row", F.monotonically_increasing_id()), [], order)
    rank = F.when(F.col("n") <= draws, F.col("n")).alias("rank")
    rest = rows.where(~drawn).withColumn("n", F.lit(draws + 1))
    return first.select("doc_id", "n_features", "weight", "score", "n").unionByName(rest.select("doc_id", "n_features", "weight", "score", "n")).select("doc_id", "n_features", "weight", "score", rank)
