"""The conversation trie against a trie of dictionaries; list ranking against walking the list."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from tallyard.llm import conversation_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, n string, depth double"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    words = lambda s: len([w for w in "".join(" " if x in "\t\n\v\f\r " else x for x in s).split(" ") if w])
    out = set()
    for seq, members in nodes.items():
        below = [s for s in nodes if s[: len(seq)] == seq]
        children = [s for s in below if len(s) == len(seq) + 1]
        leaves = [s for s in below if not any(x[:-1] == s for x in nodes if x)]
        saved = sum((len(nodes[s]) - 1) * words(s[-1][1]) for s in below if s)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(seq)))
        out.add((min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made(seed, convs=45, turns=6):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for k in range(rng.randrange(turns)):
            rows.append((c, rng.choice([k, k, None]) if seed % 2 else k, rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "", None, "long text here"])))
    return [r for r in rows if r[0] != 20]  # a block without its first conversation


def of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA)


@pytest.mark.parametrize(("seed", "chunk", "base"), [(1, 100_000, 100_000), (2, 5, 9)])
def test_against_a_trie(spark, seed, chunk, base):
    rows = made(seed) + [(None, 1, "user", "lost")] + [(300 + k, t, "u", "same words") for k in range(30) for t in range(2)] + [(60, t, "u", "x" * (t == 9) + "y") for t in range(70)]
    rows += rows[:5]  # rows that repeat are turns of their own
    got = T.prefix_trie(spark, of(spark, rows), chunk, base)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)


def test_empty(spark):
    assert T.prefix_trie(spark, of(spark, [])).count() == 0


def test_negative_ids_and_short_first_conversation(spark):
    rows = [(-21, k, "u", f"t{k}") for k in range(4)] + [(-20, 0, "u", "a")] + [(k, t, "u", f"b{t}") for k in (0, 5, 9, 13) for t in range(1 if k == 0 else 5)]
    got = {tuple(r) for r in T.prefix_trie(spark, of(spark, rows)).collect()}
    trunc = lambda c: c - (abs(c) % 20) * (1 if c >= 0 else -1)  # noqa: E731  the remainder has the id's sign
    assert trunc(-21) == -20 and len(got) == len({(g[0], g[1]) for g in got})
    assert sum(g[3] for g in got if g[1] == 0) == 6


def test_list_ranking_by_mates(spark):
    rng = random.Random(4)
    order = list(range(200))
    rng.shuffle(order)
    arcs = spark.createDataFrame([(a, b, a % 7) for a, b in zip(order, [*order[1:], -1], strict=True)], "a long, next long, g long")
    got = {r["a"]: r["position"] for r in T.list_rank(arcs, ["g"], chunk=6, base=8).collect()}
    assert got == {a: k for k, a in enumerate(order)}


def test_contracted_runs():
    a, after, w = np.array([5, 1, 2, 9]), np.array([1, 2, 77, -1]), np.array([2, 3, 4, 1])
    host, far, follows, length = T.contracted(a, after, w)
    assert host.tolist() == [0, 0, 0, 3] and far.tolist() == [0, 2, 5, 0] and (follows[0], length[0]) == (77, 9) and (follows[3], length[3]) == (-1, 1)


def test_lists_of_ids_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 3)
    rows = spark.createDataFrame([(1, 2, 3, c, True) for c in range(50)] + [(1, 2, 4, c, True) for c in (7, 8)] + [(2, 2, 2, 5, False)], "depth long, k1 long, k2 long, conv_id long, last boolean").repartition(5)
    got = {r["k2"]: r["ends_sha256"] for r in T.end_digests(rows).collect()}
    assert got == {3: hashlib.sha256(",".join(map(str, range(50))).encode()).hexdigest(), 4: hashlib.sha256(b"7,8").hexdigest()}
