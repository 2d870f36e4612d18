"""Importance resampling against a brute-force version; scans against plain loops."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tallyard.llm import resampling as R
from tallyard.llm.scans import scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent, min_words, longest=1, buckets=10_000, seed=2024):
    key = lambda f: crc32(f.encode()) % buckets
    s = Counter(key(f) for _, t in docs for f in runs(t, longest))
    t = Counter(key(f) for x in target for f in runs(x, longest))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (sum(s.values()) + buckets) / ((s[b] + 1.0) * (sum(t.values()) + buckets))))
    rows = []
    for i, text in docs:
        found = runs(text, longest)
        weight = sum(gain(key(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= min_words))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = Counter(r[:4] for r in able[: len(able) * percent // 100])
    rank = {}
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        rank.setdefault(r[:4], []).append(k)
    out = []
    for r in rows:
        ranks = rank.get(r[:4]) if r[4] else None
        out.append((*r[:4], ranks.pop(0) if ranks else None))
    assert sum(drawn.values()) == sum(x[4] is not None for x in out)
    return sorted(out, key=str)


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["Étion", "über", "ABC", "x1"]
    return [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 19, 20, 21, 60])))) for k in range(n)]


@pytest.mark.parametrize("longest", [1, 3])
def test_against_brute_force(spark, docs_of, longest):
    docs = made(150, 1) + [(None, "w1 " * 30), (None, "w1 " * 30), (7, "w2 " * 25), (7, "w2 " * 25), (500, None), (501, ""), (502, "long-" * 40_000)]
    target = ["w1 w2 w3 w4 " * 5, None, "", "Étion x1"]
    got = R.resample(spark, docs_of(docs), spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(target)], "item_id long, text string, rank double"), 30, 20, longest, buckets=50)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target, 30, 20, longest, 50)


def test_copies_and_ties_are_drawn_exactly(spark, docs_of):
    """One id and text makes up most rows: the draw ends within them, and ranks have no holes."""
    docs = [(3, "w1 w2 " * 15)] * 60 + [(k, "w1 w2 " * 15) for k in range(10, 20)]
    got = R.resample(spark, docs_of(docs), docs_of([(0, "w1")]), 50, 20).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 36))
    assert [r[4] for r in brute(docs, ["w1"], 50, 20) if r[4]] and len(got) == 70


def test_cutoff_against_sorting(spark):
    rng = random.Random(5)
    rows = [(rng.choice([-9, 0, 0, 4]), rng.choice([None, -(2**60), 5, 6, 2**62])) for _ in range(80)]
    df = spark.createDataFrame(rows, "score long, doc_id long").cache()
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    for need in (1, 17, 40, 80):
        assert R.cutoff(df, need) == order[need - 1]


def test_nothing_to_draw(spark, docs_of):
    assert R.resample(spark, docs_of([]), docs_of([]), 10, 20).count() == 0
    assert [r["rank"] for r in R.resample(spark, docs_of([(1, "a b"), (2, None)]), docs_of([]), 10, 20).collect()] == [None, None]


def test_scan_of_a_group_that_fills_many_ranges(spark):
    rng = random.Random(3)
    rows = [(k, v, rng.randrange(1 << 40)) for k, n in ((1, 3), (2, 500), (3, 1), (4, 40)) for v in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, v long, x long").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {(r["k"], r["v"]): r for r in scan(df, ["k"], [F.asc("v")], {"s": ("sum", "x"), "z": ("xor", "x")}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for k, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        total = mixed = 0
        group = list(group)
        for n, (_, v, x) in enumerate(group, 1):
            total, mixed = total + x, mixed ^ x
            r = got[(k, v)]
            assert (r["n"], r["s"], r["z"], r["last"]) == (n, total, mixed, n == len(group))
