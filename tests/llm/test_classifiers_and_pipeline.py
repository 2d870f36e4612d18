"""Held-out accuracy of the classifiers, and the pipeline stage by stage against brute force."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from test_decontaminate import brute as judged
from test_line_dedup import brute as deduped
from test_simhash import slow_groups
from test_token_tables import library

import corpus_pipeline
from tallyard.llm import quality, toxicity, words
from tallyard.llm.common import settle

SF = "/root/testdata/sf0.01"


def accuracy(rows, labels):
    known = [(p, labels[i]) for i, p in rows if i in labels]
    return sum(p == y for p, y in known) / len(known)


@pytest.mark.parametrize(("operator", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(spark, operator, label):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = operator.train(docs, labels)
    got = operator.score(spark, docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    assert accuracy([(r["doc_id"], r["predicted"]) for r in got if r["held_out"]], truth) >= 0.9
    scored = operator.score(spark, docs, model, limit=0.0).agg({"predicted": "min"}).first()[0]
    assert scored == 1


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_odd_texts(spark, docs_of, operator):
    r = random.Random(1)
    word = lambda bad: ("ugly" + r.choice("abcdefgh") if bad and r.random() < 0.3 else "w" + str(r.randrange(60)))
    sample = [(" ".join(word(y) for _ in range(40)), y) for y in (0, 1) for _ in range(60)] + [("", 0), ("123 !!", 1)]
    model = operator.fit(sample)
    texts = ["", None, "?!", "ugly" * 3, "w1 w2 w3", "x " * 20000, "ÉÉ 日本"]
    p = model.score(pa.array(texts, pa.string()))
    assert len(p) == len(texts) and np.isfinite(p).all() and (p >= 0).all() and (p <= 1).all() and p[0] == p[1]
    assert np.array_equal(p[3:5], model.score(pa.array(texts[3:5])))
    assert (operator.fit([]).score(pa.array(["a", ""])) < 1e-9).all() and (operator.fit([("a", 1)]).score(pa.array(["a"])) < 1e-9).all()
    rows = [(1, "a"), (1, "a"), (None, "b"), (2, None)]
    assert operator.score(spark, docs_of(rows), model).count() == 4 and operator.score(spark, docs_of([]), model).count() == 0


def slow_toxicity(model, text):
    """Word by word, n-gram by n-gram, stretch by stretch."""
    words = [w.encode() for w in regex.split(r"[^\p{L}]+", (text or "").lower()) if w]
    words = [w[k : k + toxicity.LONG_WORD] for w in words for k in range(0, len(w), toxicity.LONG_WORD)]
    values, mask = [], (1 << 64) - 1
    for w in words:
        w, hashes = b"<" + w + b">", []
        for g in toxicity.GRAMS:
            for k in range(len(w) - g + 1):
                h = 0
                for c in w[k : k + g]:
                    h = (h * 0x100000001B3 + c + 1) & mask
                hashes.append(h ^ g)
        hashes.append(sum((c + 1) * pow(0x100000001B3, k, 1 << 64) for k, c in enumerate(w)) & mask)
        buckets = [(h * 0x9E3779B97F4A7C15 & mask) >> (64 - (toxicity.BUCKETS.bit_length() - 1)) for h in hashes]
        values.append(sum(model.weights[b] for b in buckets) / len(buckets))
    n = min(toxicity.WINDOW, len(values))
    worst = max((sum(values[k : k + n]) for k in range(len(values) - n + 1)), default=0.0) if values else 0.0
    return 1 / (1 + np.exp(-(model.bias + worst / toxicity.WINDOW)))


def slow_quality(model, text):
    """Vector by vector, in plain loops."""
    words = [w.encode() for w in regex.sub(r"([^\p{L}\p{N}\s]+)", r" \1 ", text or "").split()]
    x = np.zeros(2 * quality.DIMENSIONS + 2)
    if words:
        vector = lambda w: model.vectors[zlib.crc32(w) % quality.BUCKETS].astype(float)
        x[: quality.DIMENSIONS] = sum(vector(w) for w in words) / len(words)
        x[quality.DIMENSIONS : -2] = sum(vector(w) for w in set(words)) / len(set(words))
        x[-2:] = len(set(words)) / len(words), np.log1p(len(words)) / 10
    a, b, c, d = model.layers
    hidden = [max(0.0, sum((x[i] - model.mean[i]) / model.scale[i] * a[i, j] for i in range(len(x))) + b[j]) for j in range(len(b))]
    return 1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, c)) + d) / model.temperature))


@pytest.mark.parametrize(("operator", "slow"), [(toxicity, slow_toxicity), (quality, slow_quality)])
def test_scores_equal_plain_loops(operator, slow):
    r = random.Random(5)
    word = lambda bad: "vile" + r.choice(["", "ly", "st"]) if bad and r.random() < 0.3 else r.choice("abcdefgéñ") * 2 + r.choice(["x", "yz", ""]) + r.choice("klmno")
    text = lambda y, n: " ".join(word(y) + r.choice(["", ",", ".", " -"]) for _ in range(n))
    model = operator.fit([(text(y, 40), y) for y in (0, 1) for _ in range(60)])
    texts = [None, "", "?!", "one", *[text(k % 2, r.choice([1, 3, 7, 60])) for k in range(30)], "Über" * 300 + " vile", "a " * 5000]
    assert np.allclose(model.score(pa.array(texts, pa.string())), [slow(model, t) for t in texts], rtol=1e-4, atol=1e-5)


def test_a_long_word_takes_little_memory():
    model = toxicity.fit([("good day " * 20, 0), ("vile scoundrel " * 20, 1)] * 30)
    tracemalloc.start()
    model.score(pa.array(["ab" * 2_000_000, "c"]))
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def test_rows_kept_by_toxicity(spark, docs_of):
    model = toxicity.fit([("good day " * 20, 0), ("vile scoundrel " * 20, 1)] * 30)
    docs = docs_of([(1, "good day"), (1, "good day"), (2, "vile scoundrel vile scoundrel vile scoundrel"), (None, None), (3, "")]).withColumn("score", F.lit("mine"))
    kept = toxicity.without_toxic(spark, docs, model)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r["doc_id"] != 2)


def test_misspellings_share_n_grams():
    r = random.Random(2)
    clean = lambda n: [f"w{r.randrange(300)}" for _ in range(n)]
    sample = [(" ".join(clean(50)), 0) for _ in range(150)]
    for _ in range(150):
        t = clean(50)
        t[r.randrange(50)] = r.choice(["scoundrel", "scoundrels", "scoundrell"])
        sample.append((" ".join(t), 1))
    model = toxicity.fit(sample)
    p = model.score(pa.array([" ".join([*clean(30), "scoundrelz", *clean(30)]), " ".join(clean(2000))]))
    assert p[0] > 0.7 > p[1]


def test_a_repeated_id_gives_the_same_sample(spark, docs_of):
    rows = [(k % 20, f"text {k} " * 3) for k in range(200)] + [(30, None), (31, ""), (32, "x" * 900)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(33)], "doc_id long, toxic int")
    drawn = [words.labelled_sample(docs_of(rows[::step]).repartition(n), labels, "toxic", {0: 50, 1: 50}, 500) for step, n in ((1, 1), (-1, 5), (1, 3))]
    assert drawn[0] == drawn[1] == drawn[2] and {t for t, _ in drawn[0]} <= {t for _, t in rows[:200]}
    assert len(drawn[0]) == len({k for k in range(20) if zlib.crc32(str(k).encode()) % 3 != 1})


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Empty documents, then repeated and null ids, null, empty and very long texts; a column that clashes with results."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, text_key string, score string"
    labels = spark.createDataFrame([(k, 1, int(k % 2)) for k in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    r = random.Random(4)
    text = lambda k: " ".join(f"w{r.randrange(10**6)}" for _ in range(30)) + " vile scoundrel" * (3 * (k % 2))
    long = " ".join(f"v{k}" for k in range(120_000))
    rows = [(k, text(k)) for k in range(40)] + [(50, None), (51, ""), (52, long), (52, long), (None, "a text of its own " * 5)]
    for table in ([], rows):
        now = spark.createDataFrame([(i, t, "en", "s", 0, "mine", "own") for i, t in table], schema)
        for name, stage in corpus_pipeline.STAGES:
            columns = now.columns
            now = settle(stage(spark, now, f"file://{tmp_path}"), f"odd-{name}")
            assert name == "packing" or now.columns == columns
            if name == "near_dedup":
                kept = [x["doc_id"] for x in now.collect()]
        got = {x["doc_id"] for x in now.collect()}
        assert got == set(kept) and len(kept) == len(got)
    # Texts without words are one group, of which the smallest id stays; copies of the long one likewise.
    assert {50, 52, None} <= got and 51 not in got and not got & set(range(1, 40, 2)) and set(range(0, 40, 2)) <= got


def test_pipeline(spark, tmp_path):
    r = random.Random(7)
    line = lambda n: " ".join(r.choice("abcdefghij") + str(r.randrange(300)) for _ in range(n))
    passage, item = "\n".join(line(30) for _ in range(3)), line(30)
    docs = []
    for k in range(150):
        parts = [line(r.randint(20, 60)) for _ in range(3)]
        if k % 3 == 0:
            parts.insert(1, passage)
        if k % 10 == 1:
            parts.append(item)
        if k % 4 == 2:
            parts.append("vile scoundrel " * 3)
        docs.append((k, "\n".join(parts)))
    docs += [(200 + k, docs[k][1] + " z") for k in range(12)] + [(300, None), (301, ""), (302, docs[5][1])]
    labels = [(k, 1, int(k % 4 == 2)) for k in range(150)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, results = now.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, f"file://{tmp_path}")
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        results.append(now)
    assert all(x.columns == columns for x in results[:-1])
    rows = [sorted(((r["doc_id"], r["text"]) for r in x.collect()), key=lambda r: r[0]) for x in results[:-1]]
    assert [i for i, _ in rows[0]] == sorted(i for i, t in docs if "scoundrel" not in (t or ""))
    assert [t for _, t in rows[1]] == deduped(rows[0]) and [i for i, _ in rows[1]] == [i for i, _ in rows[0]]
    keep = {c for _, _, c in slow_groups(rows[1])}
    assert rows[2] == [x for x in rows[1] if x[0] in keep]
    bad = {i for i, *_, b in judged(rows[2], [(1, item)]) if b}
    assert bad and rows[3] == [x for x in rows[2] if x[0] not in bad]
    packed = results[-1].collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in rows[3]}
    assert sum(r["length"] for r in packed) == sum(len(library("word_bpe_49k.json", t, 1)) // 4 for _, t in rows[3])
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == len(packed)
