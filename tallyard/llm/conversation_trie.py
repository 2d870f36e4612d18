"""Prefix trie of conversations, with sums over its subtrees by the Euler tour of the tree.

Conversations are rebuilt (each begins with the first turns of its block's first one), turns become digests, and every
prefix a key: an exclusive or of its turns' hashes, each salted with its depth. Rows of one key are a node; a node is
known by its smallest member and its depth. That all rows of a key share the parent's key and the last turn is checked,
so keys stand for equal sequences.

The tour has two arcs a node, enter and exit. An enter arc leads into the first child, or else to the node's own exit;
an exit arc into the next sibling, or else to the parent's exit. Ranking that list gives positions: runs that lie
together are first contracted within bounded chunks, what is left by rounds in which a hash of each arc decides who takes
in its successor (an expected quarter goes each round), until BASE arcs are left, which one task ranks; then rounds are
undone in reverse. Over the arcs in the order of their positions, sums of leaves and savings run; the difference between
a node's exit and enter is its subtree.

Nothing is grouped by conversation or by parent: places in them come from scans over ranges, so that a conversation, a
parent or a group of copies may hold any share of all rows. Only the SHA-256 of a node's list of ids is one task's work
by its nature; the list comes to it in pieces, and is not kept.

Defined results: rows with a null conv_id take no part; null roles and texts are empty; a null turn comes first; turns
that tie are ordered by role and then by a digest of role and text, and rows that repeat are turns of their own; texts
are hashed whole; an empty table gives no rows (without conversations there is no root); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, ship, thrifty
from .scans import scan

BLOCK, SHARES = 20, 4
#: Arcs that are contracted together, and arcs that one task ranks.
CHUNK, BASE = 100_000, 100_000
#: Ids of a piece of a node's list.
PIECE = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def shared_turns(conv_id: Column) -> Column:
    """How many turns of its block's first conversation a conversation begins with."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARES).cast("long")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, n (from 1), last, d1, d2 (a digest of role and text), words, of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    part = lambda k: F.conv(F.substring("digest", k, 15), 16, 10).cast("long")
    own = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    own = own.select("conv_id", "turn", "role", part(1).alias("d1"), part(16).alias("d2"), "words")
    return scan(own, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("role"), F.asc("d1"), F.asc("d2")]).drop("turn", "role")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, depth, d1, d2, words of every turn of the rebuilt conversations, and of each one's depth 0."""
    convs = settle(turns.where("last").select("conv_id", F.col("n").alias("turns")), "conversations")
    convs = convs.withColumns({"h": shared_turns(F.col("conv_id")), "first": F.col("conv_id") - F.col("conv_id") % BLOCK})
    heads = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("n") < SHARES)).select(F.col("conv_id").alias("first"), F.col("n").alias("depth"), "d1", "d2", "words")
    taken = convs.join(heads, "first").where(F.col("depth") <= F.col("h"))
    # Where the first conversation is too short or absent, own turns move up.
    firsts = convs.select(F.col("conv_id").alias("first"), F.col("turns").alias("there"))
    moved = convs.join(firsts, "first", "left").select("conv_id", (F.col("h") - F.least("h", F.coalesce("there", F.lit(0).cast("long")))).alias("up")).where("up > 0")
    own = turns.where(F.col("n") > shared_turns(F.col("conv_id"))).join(moved, "conv_id", "left").withColumn("depth", F.col("n") - F.coalesce("up", F.lit(0).cast("long")))
    zero = F.lit(0).cast("long")
    tops = convs.select("conv_id", zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), zero.alias("words"))
    columns = ["conv_id", "depth", "d1", "d2", "words"]
    return tops.unionByName(taken.select(*columns)).unionByName(own.select(*columns))


def prefixes(rows: DataFrame) -> DataFrame:
    """rows with the key (k1, k2) of the prefix that ends there, the key (p1, p2) of the one before, and last."""
    salted = rows.withColumns({f"x{k}": F.xxhash64(F.lit(k), "depth", "d1", "d2") for k in (1, 2)})
    out = scan(salted, ["conv_id"], [F.asc("depth")], {"k1": ("xor", "x1"), "k2": ("xor", "x2")})
    return out.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("x1")), "p2": F.col("k2").bitwiseXOR(F.col("x2"))}).drop("x1", "x2", "n")


def nodes_of(rows: DataFrame) -> DataFrame:
    """id, depth, k1, k2, p1, p2, conv_id (smallest member), n_convs, words, stored."""
    same = ["p1", "p2", "d1", "d2"]
    found = rows.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"{c}_") for c in same])
    # Ids are stored once, so they stay what they are.
    out = settle(found.withColumn("id", F.monotonically_increasing_id()), "nodes")
    if out.where(" OR ".join(f"{c} <> {c}_" for c in same)).head(1):
        raise ValueError("two sequences of turns have the same key")
    return out.select("id", "depth", "k1", "k2", "p1", "p2", "conv_id", "n_convs", "words")


def tree_of(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id, place (among its siblings, from 1), n_children, child (id of the first), stored."""
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    known = nodes.join(above, ["depth", "p1", "p2"], "left").drop("p1", "p2").withColumn("parent", F.coalesce("parent_conv_id", "conv_id"))
    family = scan(known, ["depth", "parent"], [F.asc("conv_id")]).withColumnRenamed("n", "place")
    ends = family.where((F.col("depth") > 0) & (F.col("last") | (F.col("place") == 1)))
    children = ends.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv_id")).agg(F.max("place").alias("n_children"), F.min_by("id", "place").alias("child"))
    return settle(family.drop("last").join(children, ["depth", "conv_id"], "left").fillna(0, ["n_children"]), "tree")


def arcs_of(tree: DataFrame) -> DataFrame:
    """a (twice the node's id, and one more for its exit), next (-1 after the last), conv_id and depth, by which arcs that
    follow each other mostly lie together."""
    to_next = tree.where("place > 1").select("depth", "parent", (F.col("place") - 1).alias("place"), (2 * F.col("id")).alias("next"))
    to_parent = tree.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"), F.col("n_children").alias("place"), (2 * F.col("id") + 1).alias("next"))
    linked = tree.join(to_next.unionByName(to_parent), ["depth", "parent", "place"], "left")
    enter = F.struct((2 * F.col("id")).alias("a"), F.coalesce(2 * F.col("child"), 2 * F.col("id") + 1).alias("next"))
    leave = F.struct((2 * F.col("id") + 1).alias("a"), F.coalesce("next", F.lit(-1).cast("long")).alias("next"))
    return linked.select("conv_id", "depth", F.explode(F.array(enter, leave)).alias("x")).select("conv_id", "depth", "x.*")


def contracted(a: np.ndarray, after: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of elements of lists that lie here: the first element that leads to each within them, how far it is, and for those
    first ones what follows their run and how long the run is."""
    by = np.argsort(a)
    at = np.minimum(np.searchsorted(a, after, sorter=by), len(a) - 1)
    found = a[by[at]] == after
    place = np.arange(len(a))
    host, far = place.copy(), np.zeros(len(a), np.int64)
    host[by[at[found]]] = place[found]
    far[by[at[found]]] = w[found]
    while True:
        nearer = host[host]
        if (nearer == host).all():
            break
        far += far[host]
        host = nearer
    follows, length = after.copy(), w.copy()
    ends = ~found
    follows[host[ends]], length[host[ends]] = after[ends], far[ends] + w[ends]
    return host, far, follows, length


RUNS = "a long, host long, far long, next long, w long"


def _runs(rows: DataFrame, chunk: int) -> DataFrame:
    """a, and host and far where it is taken in by another, else next and w; rows: a, next, w, in an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            a, after, w = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
            host, far, follows, length = contracted(a, after, w)
            alone = host == np.arange(len(a))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(a[host], mask=alone), pa.array(far), pa.array(follows), pa.array(length)], ["a", "host", "far", "next", "w"])

        for b in batches:
            for k in range(0, len(b), chunk):
                part = b.slice(k, chunk)
                if n and n + len(part) > chunk:
                    yield out()
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if n:
            yield out()

    return rows.select("a", "next", "w").mapInArrow(thrifty(run), RUNS)


def list_rank(arcs: DataFrame, order: list[str], chunk: int = CHUNK, base: int = BASE) -> DataFrame:
    """a, position (from 0) of every element of one list. arcs: a, next (-1 after the last), and columns by which elements
    that follow each other mostly lie together."""
    dealt = arcs.withColumn("w", F.lit(1).cast("long")).repartitionByRange(*order, "a").sortWithinPartitions(*order, "a")
    runs = settle(_runs(dealt, chunk), "runs")
    levels = [runs.where(F.col("host").isNotNull()).select("a", "host", "far")]
    live, round_ = runs.where(F.col("host").isNull()).select("a", "next", "w"), 0
    while live.count() > base:
        heads = F.xxhash64("a", F.lit(round_)) % 2 == 0
        x = live.where(heads).toDF("a", "next", "w")
        y = live.where(~heads).toDF("a_", "next_", "w_")
        both = settle(x.join(y, F.col("next") == F.col("a_"), "full"), "mates")
        levels.append(both.where("a IS NOT NULL AND a_ IS NOT NULL").select(F.col("a_").alias("a"), F.col("a").alias("host"), F.col("w").alias("far")))
        met = F.col("a").isNotNull() & F.col("a_").isNotNull()
        live = both.select(F.coalesce("a", "a_").alias("a"), F.when(met, F.col("next_")).otherwise(F.coalesce("next", "next_")).alias("next"), F.when(met, F.col("w") + F.col("w_")).otherwise(F.coalesce("w", "w_")).alias("w"))
        round_ += 1
    known = settle(_runs(live.coalesce(1), base).select("a", F.col("far").alias("position")), "positions")  # up to `base` rows
    for taken in reversed(levels):
        far = taken.join(known.select(F.col("a").alias("host"), "position"), "host").select("a", (F.col("position") + F.col("far")).alias("position"))
        known = settle(known.unionByName(far), "positions")
    return known


def subtree_sums(tree: DataFrame, positions: DataFrame) -> DataFrame:
    """id, n_leaves, saved_tokens of every node's subtree."""
    arcs = positions.select(F.shiftright("a", 1).alias("id"), (F.col("a") % 2).alias("leaves"), "position")
    own = tree.select("id", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    arcs = arcs.join(own, "id").withColumns({c: F.when(F.col("leaves") == 0, F.col(c)).otherwise(F.lit(0).cast("long")) for c in ("leaf", "saved")})
    run = scan(arcs, [], [F.asc("position")], {"leaf_sum": ("sum", "leaf"), "saved_sum": ("sum", "saved")})
    between = lambda c: F.max(F.when(F.col("leaves") == 1, F.col(f"{c}_sum"))) - F.max(F.when(F.col("leaves") == 0, F.col(f"{c}_sum"))) + F.max(c)
    return run.groupBy("id").agg(between("leaf").alias("n_leaves"), between("saved").alias("saved_tokens"))


def end_digests(rows: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of every node at which conversations end: the digest of their ids in numeric order.

    Ids are dealt by ranges. A list that lies within a range is hashed there; one that may go on in others, or is long,
    is cut into pieces, which are read in their order and not kept.
    """
    ends = rows.where("last").select("depth", "k1", "k2", "conv_id")
    by = ["depth", "k1", "k2", "conv_id"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, open_ = None, [], True  # open_: the list is longer than what is held, or may have begun before
        out: list[tuple] = []

        def put(final: bool):
            text = ",".join(map(str, ids)).encode()
            whole = final and not open_
            out.append((*key, ids[0], None if whole else text, hashlib.sha256(text).hexdigest() if whole else None))

        for b in batches:
            for *now, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != key:
                    if key is not None:
                        put(True)
                        open_ = False
                    key, ids = now, []
                elif len(ids) == PIECE:
                    open_ = True
                    put(False)
                    ids = []
                ids.append(conv)
            if out:
                yield _batch(out)
                out.clear()
        if key is not None:
            open_ = True
            put(False)
            yield _batch(out)

    kind = "depth long, k1 long, k2 long, first long, text binary, ends_sha256 string"
    found = settle(ends.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(thrifty(pieces), kind), "ends")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        for b in batches:
            for *now, _, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256(text)
                else:
                    digest.update(b"," + text)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("depth", "k1", "k2", "ends_sha256"), r, strict=True)) for r in out])
                out = []
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "k1", "k2", "ends_sha256"), (*key, digest.hexdigest()), strict=True))])

    long_ = found.where("text IS NOT NULL").select("depth", "k1", "k2", "first", "text").repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "first")
    joined = long_.mapInArrow(thrifty(join), "depth long, k1 long, k2 long, ends_sha256 string")
    return found.where("text IS NULL").select("depth", "k1", "k2", "ends_sha256").unionByName(joined)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["depth", "k1", "k2", "first", "text", "ends_sha256"])


def prefix_trie(spark: SparkSession, conversations: DataFrame, chunk: int = CHUNK, base: int = BASE) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    ship(spark)
    rows = prefixes(rebuilt(ordered_turns(conversations)))
    tree = tree_of(nodes_of(rows))
    sums = subtree_sums(tree, list_rank(arcs_of(tree), ["conv_id", "depth"], chunk, base))
    out = tree.join(sums, "id").join(end_digests(rows), ["depth", "k1", "k2"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
