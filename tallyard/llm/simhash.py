"""SimHash fingerprints and their near-duplicate groups, found by pigeonring filtering.

Fingerprints are cut into SEGMENTS consecutive segments on a ring. If two differ in at most t bits, then from some
segment on every chain of l segments differs in at most l * t / SEGMENTS bits (Qin and Xiao, 2018). With t = 4 and 5
segments the budgets are 0, 1, 2, 3, 4: the first segment is equal and the second differs in one bit at most, which is
what candidates are joined on; the longer chains are tested before the whole fingerprint is.

Fingerprints are compared once each, however many documents have them. A key that many fingerprints share is split
into blocks, and each pair of blocks is a task's work of bounded size that gives back a spanning forest of its links,
not the links: components stay the same, and the rows in proportion.

Defined results: null and empty texts, and those of white space alone, have fingerprint zero, linked like any other;
rows that repeat a doc_id are rows of their own; null ids take no part in a component's smallest id; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, settle, ship, text_of, thrifty
from .components import components

SEGMENTS = 5
BLOCK = 1024
#: Bytes of a text that are cut into words and shingles at a time.
RUN_BYTES = 1 << 18
_SPACE = re.compile(rb"[\x09-\x0d ]")


def word_runs(text: str | None, size: int) -> Iterator[list[bytes]]:
    """The text's words in their order, A-Z in lower case, by runs of about size bytes."""
    data, at = (text or "").encode("utf-8", "surrogatepass").lower(), 0
    while at < len(data):
        space = _SPACE.search(data, at + size)
        end = space.start() if space else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None, shingle: int = 4, run_bytes: int = RUN_BYTES) -> int:
    """A bit is set if it is set in over half of the hashes of the text's word shingles. Long texts go by runs of words,
    each with the last words of the one before, so that memory does not follow the text's length in words."""
    digest, bits, n, last = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []

    def add(grams: list[bytes]) -> None:
        nonlocal bits, n
        hashes = np.fromiter((digest(g, 42) for g in grams), np.uint64, len(grams))
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        n += len(grams)

    for run in word_runs(text, run_bytes):
        words = last + run
        if len(words) >= shingle:
            add(list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))))
        last = words[max(0, len(words) - shingle + 1) :]
    if not n and last:
        add([b" ".join(last)])
    return int.from_bytes(np.packbits(bits * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(spark: SparkSession, docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp (the fingerprint's 64 bits as a long) of each row of docs."""
    ship(spark)

    def mark(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fps)], ["doc_id", "text_key", "fp"])

    rows = docs.select("doc_id", F.xxhash64(text_of(docs)).alias("text_key"), text_of(docs).alias("text"))
    return rows.mapInArrow(thrifty(mark), "doc_id long, text_key long, fp long")


def widths(segments: int = SEGMENTS) -> list[int]:
    return [64 // segments + (k < 64 % segments) for k in range(segments)]


def chain_masks(first: int, segments: int = SEGMENTS) -> list[int]:
    """Bits of the chains of 1, 2, ... segments that begin at segment first, on the ring."""
    wide, out, mask = widths(segments), [], 0
    low = [sum(wide[:k]) for k in range(segments)]
    for k in range(segments):
        s = (first + k) % segments
        mask |= ((1 << wide[s]) - 1) << low[s]
        out.append(mask)
    return out


def keyed(classes: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """k, fp, home: each fingerprint under the values of each two neighbouring segments, and, not at home, under those
    with one zero bit of the second set. Two whose first segments are equal and whose second ones differ in one bit at
    most meet at a key at which one at least is at home."""
    wide = widths(segments)
    low = [sum(wide[:k]) for k in range(segments)]
    cut = lambda s: F.shiftrightunsigned("fp", low[s]).bitwiseAND((1 << wide[s]) - 1)
    parts = []
    for s in range(segments):
        n = (s + 1) % segments
        head = F.lit(s << 40).bitwiseOR(F.shiftleft(cut(s), 20))
        key = lambda tail, home, head=head: F.struct(head.bitwiseOR(tail).alias("k"), F.lit(home).alias("home"))
        flips = [F.when(cut(n).bitwiseAND(1 << b) == 0, key(cut(n).bitwiseOR(1 << b), False)) for b in range(wide[n])]
        parts.append(F.array_compact(F.array(key(cut(n), True), *flips)))
    return classes.select("fp", F.explode(F.concat(*parts)).alias("x")).select("x.k", "fp", "x.home")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the components of the given ones, one fewer than the nodes of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        for z in (x, y):
            np.minimum.at(label, label[z], least)
            np.minimum.at(label, z, least)
        label = label[label]
        if (label == before).all():
            break
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _near(k: np.ndarray, fp: np.ndarray, home: np.ndarray, i: np.ndarray, j: np.ndarray, masks: np.ndarray, limit: int) -> np.ndarray:
    """Which of the pairs (i, j) are links: one at home, each chain within its budget, then the whole within the limit."""
    ok = home[i] | home[j]
    i, j, at = i[ok], j[ok], np.flatnonzero(ok)
    diff, chains = fp[i] ^ fp[j], masks[k[i] >> 40]
    n = masks.shape[1]
    for length in range(1, n + 1):
        ok = np.bitwise_count(diff & chains[:, length - 1]) <= length * limit // n
        diff, chains, at = diff[ok], chains[ok], at[ok]
    return at


def links_in_runs(k: np.ndarray, run: np.ndarray, side: np.ndarray, fp: np.ndarray, home: np.ndarray, masks: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within each run of rows with one key. Rows of sides 1 and 2 are two blocks of a split
    key, compared with each other; rows of side 0 are compared among themselves."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def take(i, j):
        ok = side[i] + side[j] != 2
        ok &= ~((side[i] == 2) & (side[j] == 2))
        i, j = i[ok], j[ok]
        at = _near(k, fp, home, i, j, masks, limit)
        if at.size:
            found.append(forest(fp[i[at]], fp[j[at]]))

    rows = np.arange(len(run))
    live = rows[:-1]
    step = 1
    while live.size:  # all pairs step apart, for as long as runs reach
        live = live[live + step < len(run)]
        live = live[run[live] == run[live + step]]
        if live.size:
            take(live, live + step)
        step += 1
    if not found:
        return np.zeros(0, fp.dtype), np.zeros(0, fp.dtype)
    return forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


def near_links(spark: SparkSession, classes: DataFrame, limit: int = 4) -> DataFrame:
    """a, b: links of which the components are those of all pairs of distinct fp that differ in limit bits at most."""
    ship(spark)
    if limit >= SEGMENTS:
        raise ValueError("budgets need more segments than differing bits")
    masks = np.array([chain_masks(s) for s in range(SEGMENTS)], np.uint64)
    # A row becomes some forty: more partitions than the few that the fingerprints fill by themselves.
    rows = keyed(classes.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "fp"))
    heavy = rows.groupBy("k").count().where(F.col("count") > BLOCK).select("k", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    # A heavy key's rows go to one block by their hash, and each block meets each other and itself.
    own = F.pmod(F.xxhash64("fp", "home"), F.coalesce("blocks", F.lit(1))).cast("int")
    spread = rows.join(heavy, "k", "left").select("k", "fp", "home", own.alias("own"), F.coalesce("blocks", F.lit(1)).cast("int").alias("blocks"))
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = spread.select("k", "fp", "home", "own", meets.alias("other")).select(
        "k", "fp", "home", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    spread = spread.repartition("k", "x", "y").sortWithinPartitions("k", "x", "y")

    def compare(batches):
        left = None
        for b in batches:
            now = [b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "x", "y", "side", "fp", "home")]
            if left is not None:
                now = [np.concatenate(p) for p in zip(left, now, strict=True)]
            k, x, y, side, fp, home = now
            last = int(np.flatnonzero((k != k[-1]) | (x != x[-1]) | (y != y[-1]))[-1]) + 1 if (k[0], x[0], y[0]) != (k[-1], x[-1], y[-1]) else 0
            left = [c[last:] for c in now]
            yield from done([c[:last] for c in now])
        if left is not None:
            yield from done(left)

    def done(cols):
        k, x, y, side, fp, home = cols
        if not len(k):
            return
        run = np.concatenate([[0], np.cumsum((np.diff(k) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0))])
        a, b = links_in_runs(k, run, side, fp.view(np.uint64), home.astype(bool), masks, limit)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return spread.mapInArrow(thrifty(compare), "a long, b long").distinct()


def near_groups(spark: SparkSession, docs: DataFrame, shingle: int = 4, limit: int = 4) -> DataFrame:
    """doc_id, text_key, fp, root (the group's smallest fp), component_id (its smallest doc_id) of each row of docs."""
    marked = settle(fingerprints(spark, docs, shingle), "fingerprints")
    classes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(near_links(spark, classes.select("fp"), limit)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = settle(rooted.join(ids, "root").select("fp", "root", "component_id"), "groups")
    return marked.join(groups, "fp")


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = 4, limit: int = 4) -> DataFrame:
    """Rows of docs, all columns, of which each group keeps the one with the smallest doc_id."""
    groups = near_groups(spark, docs, shingle, limit)
    # Only rows that carry their group's id remain here; of these, repeated and null ids leave one a group.
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("x"))
    key, kept_id, kept_key = free_names(["text_key", "kept_id", "kept_key"], docs.columns)
    kept = kept.select(F.col("x.doc_id").alias(kept_id), F.col("x.text_key").alias(kept_key))
    one = docs.withColumn(key, F.xxhash64(text_of(docs))).join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key)), "left_semi")
    return one.dropDuplicates(["doc_id", key]).drop(key)
