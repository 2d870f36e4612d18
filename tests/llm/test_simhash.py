import random
import tracemalloc

import numpy as np
import xxhash

from tallyard.llm import simhash


def slow_fingerprint(text, k=4):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, f, least.get(find(k))) for k, ((i, _), f) in enumerate(zip(rows, fps)) if i is not None)


def corpus(n=220, seed=5):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "ñ", "A"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "a b c"), (6, "long " * 5000), (7, "long " * 5001)]
    while len(rows) < n:
        words = [r.choice(vocabulary) for _ in range(r.choice([5, 40, 200]))]
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(r.choice([0, 1, 2])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((len(rows), r.choice([" ", "\n", "  "]).join(copy)))
    r.shuffle(rows)
    return [*rows, rows[3], (None, "one"), (None, "by itself and alone")]


def test_groups_equal_brute_force(spark, docs_of, monkeypatch):
    rows = corpus()
    for block in (1024, 2):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = simhash.near_groups(spark, docs_of(rows)).select("doc_id", "fp", "component_id").collect()
        assert sorted((r[0], r[1] & (1 << 64) - 1, r[2]) for r in got if r[0] is not None) == slow_groups(rows)
    assert len(got) == len(rows)


def test_links_of_random_neighbours(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 300, np.int64).astype(np.uint64)
    flips = [base]
    for bits in range(1, 7):
        x = base.copy()
        for k in range(len(x)):
            for b in r.choice(64, bits, replace=False):
                x[k] ^= np.uint64(1) << np.uint64(b)
        flips.append(x)
    fps = np.unique(np.concatenate(flips))
    d = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(fps))
    for _ in range(len(fps)):
        new = np.where(d, label[None, :], len(fps)).min(1)
        if (new == label).all():
            break
        label = new
    from tallyard.llm.components import components

    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    got = {x["node"]: x["root"] for x in components(simhash.near_links(spark, df)).collect()}
    roots = [got.get(int(v), int(v)) for v in fps.view(np.int64)]
    groups = {}
    for k, root in enumerate(roots):
        groups.setdefault(root, set()).add(k)
    want = {}
    for k, v in enumerate(label):
        want.setdefault(v, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_keep_one(spark, docs_of):
    rows = corpus(120)
    docs = docs_of(rows)
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in slow_groups(rows)}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1


def test_clashing_names(spark, docs_of):
    docs = docs_of(corpus(40)).selectExpr("*", *[f"'mine' AS {c}" for c in ("text_key", "KEPT_ID", "_keep_id", "fp", "root", "x", "component_id")])
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns and {r["KEPT_ID"] + r["text_key"] for r in kept.collect()} == {"minemine"}


def test_empty(spark, docs_of):
    assert simhash.near_groups(spark, docs_of([])).count() == 0
    assert simhash.keep_one(spark, docs_of([])).count() == 0


def test_long_texts_by_runs_have_the_same_fingerprint():
    r = random.Random(12)
    for n in (0, 1, 3, 4, 5, 40, 700):
        text = "".join(r.choice(["Ab", "é", "word" * 9, "x"]) + str(r.randrange(30)) + r.choice([" ", "\n\n", "\t", "\x0b", "\u00a0 "]) for _ in range(n))
        for size in (1, 7, 50, 1000):
            assert simhash.fingerprint(text, run_bytes=size) == slow_fingerprint(text)
            assert sum(simhash.word_runs(text, size), []) == text.encode().lower().split()
    tracemalloc.start()
    assert simhash.fingerprint("some words " * 1_000_000) == slow_fingerprint("some words " * 50)
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
