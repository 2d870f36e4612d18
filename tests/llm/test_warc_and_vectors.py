import hashlib
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyard.llm import ann, warc


def pages(seed=1):
    r = random.Random(seed)
    big = ["<html>" + "".join(r.choice("abcdef é\r\n") for _ in range(n)) + "</html>" for n in (999, 1500, 3000, 40000)]
    rows = [(0, "http://a/", None), (1, None, ""), (2, "http://b/x y\r\nEvil: 1", "small"), (3, "http://c/é%20", "small"), (None, "http://d/", big[1]), (None, "http://e/", "\r\n\r\n")]
    return rows + [(k, f"http://h{k % 3}/{k}", r.choice(big)) for k in range(4, 60)] + [(59, "http://again/", big[1]), (59, "http://again/", big[1])]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rows = pages()
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    archives = warc.write_archives(spark, df)
    got = warc.read_archives(spark, archives).collect()
    largest = {}
    for i, _, h in rows:
        h = h or ""
        if len(h.encode()) >= 1000 and i is not None:
            largest[h] = max(i, largest.get(h, i))
    want = []
    for i, u, h in rows:
        data, keeper = (h or "").encode(), largest.get(h or "")
        seen = keeper is not None and keeper != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if seen else "response", keeper if seen else None, None if seen else data))
    key = lambda x: str(x)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got), key=key) == sorted(want, key=key)
    assert {r["url"] for r in got} == {u and warc.target(u) for _, u, _ in rows}
    assert archives.count() > 2
    slim = warc.read_archives(spark, archives, payloads=False)
    assert "payload" not in slim.columns and slim.count() == len(rows)
    assert warc.write_archives(spark, df.limit(0)).count() == 0


def test_damage_is_found(tmp_path):
    data = warc.record(1, "http://x/", b"hello" * 10, hashlib.sha1(b"hello" * 10).digest(), None)
    assert warc.parse(data)["payload"] == b"hello" * 10
    for bad, why in ((data.replace(b"hellohello", b"jellohello", 1), "digest"), (data[:-1], "Content-Length"), (data.replace(b"WARC/1.1", b"WARC/9.9"), "version"), (data.replace(b"WARC-Date", b"WARC-Dat"), "warc-date"), (data.replace(b"HTTP/1.1", b"FTPX/1.1"), "HTTP")):
        with pytest.raises(ValueError, match=why):
            warc.parse(bad)
    whole = b"".join(warc.archive(warc.dictionary([]), iter([data, data])))
    path = tmp_path / "x"
    for cut, why in ((whole[:-3], "cut short"), (struct.pack("<I", 1) + whole[4:], "dictionary"), (whole[:20], "cut short")):
        path.write_bytes(cut)
        with pytest.raises(ValueError, match=why), path.open("rb") as f:
            list(warc.frames(f))


def vectors(n=3000, d=16, seed=0):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(20, d)) * 3
    x = (centre[r.integers(0, 20, n)] + r.normal(size=(n, d))).astype(np.float32)
    x[r.random(n) < 0.3] = x[7]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(n, None), (n + 100, [0.0] * d), (n + 200, [float("nan")] + [1.0] * (d - 1)), (n + 300, [float("inf")] + [1.0] * (d - 1)), (n + 400, [None] + [1.0] * (d - 1)), (n + 500, [1.0, 2.0]), (None, x[3].tolist()), (500, x[9].tolist())]
    return rows, x


def brute(rows, d, every=100, k=10):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) == d and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    ids, m = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    out = {}
    for i, v in good:
        if i % every == 0:
            s = np.sqrt(((m - v) ** 2).sum(1))
            ok = ids != i
            order = np.lexsort((ids[ok], s[ok]))[:k]
            out.setdefault(i, []).append(list(zip(ids[ok][order].tolist(), s[ok][order].tolist())))
    return out


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 300)
    monkeypatch.setattr(ann, "QUERY_ROWS", 5)
    rows, x = vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cell int")
    got = ann.nearest_neighbours(spark, df).where("query_id <> 500").collect()
    want = brute(rows, x.shape[1])
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(by) == set(want) - {500}
    hits = 0
    exact = {i: np.array(v, np.float64) for i, v in rows if v is not None and i is not None and None not in v and len(v) == x.shape[1] and i != 500}
    for q, ranks in by.items():
        assert sorted(ranks) == list(range(1, 11))
        got_rows = [ranks[k] for k in range(1, 11)]
        assert got_rows == sorted(got_rows, key=lambda a: (a[1], a[0])) and all(i != q for i, _ in got_rows)
        assert all(s == pytest.approx(np.sqrt(((exact[i] - exact[q]) ** 2).sum()), abs=1e-12) for i, s in got_rows if i in exact)
        hits += len({i for i, _ in got_rows} & {i for i, _ in want[q][0]})
    assert hits >= 0.9 * 10 * len(by)


def test_recall_without_clusters(spark):
    x = np.random.default_rng(3).normal(size=(6000, 48)).astype(np.float32)
    rows = list(enumerate(x.tolist()))
    want = brute(rows, 48)
    got = ann.nearest_neighbours(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).groupBy("query_id").agg(F.collect_set("vec_id").alias("x")).collect()
    assert sum(len(set(r["x"]) & {i for i, _ in want[r["query_id"]][0]}) for r in got) >= 9 * len(want)


def test_recall_within_a_large_group_of_near_copies(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(24_000, 32))
    group = r.permutation(len(x))[:4000]
    x[group] = x[group[0]] + r.normal(size=(len(group), 32)) * 0.001
    asked = {int(i) for i in group if i % 100 == 0}
    got = ann.nearest_neighbours(spark, spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).groupBy("query_id").agg(F.collect_set("vec_id").alias("x")).collect()
    hits = 0
    for q in (q for q in got if q["query_id"] in asked):
        s = np.sqrt(((x - x[q["query_id"]]) ** 2).sum(1))
        s[q["query_id"]] = np.inf
        hits += len(set(q["x"]) & set(np.argsort(s, kind="stable")[:10].tolist()))
    assert hits >= 9.9 * len(asked)


def test_the_nearest_of_a_list_are_found(spark):
    r = np.random.default_rng(6)
    near = r.normal(size=32) + r.normal(size=(3000, 32)) * 0.001
    model = ann.Quantiser(np.concatenate([r.normal(size=(3000, 32)), near[:5]]), 8)
    cell, codes = model.encode(near)
    at = np.flatnonzero(cell == np.bincount(cell).argmax())
    assert len(at) > 2000
    rows = pd.DataFrame({"vec_id": at, "codes": [c.tobytes() for c in codes[at]], "error": model.errors(near, cell, codes)[at], "vector": [v.tobytes() for v in near[at]]})
    asked = at[::100]
    got = ann.search_block(int(cell[at[0]]), pd.DataFrame({"query_id": asked, "vector": [near[i].tobytes() for i in asked]}), rows, model, 10, 256)
    for q in asked:
        s = np.sqrt(((near[at] - near[q]) ** 2).sum(1))
        order = [int(i) for i in at[np.lexsort((at, s))] if i != q][:10]
        assert got.loc[got["query_id"] == q, "vec_id"].tolist() == order


def test_few_and_none(spark):
    one = lambda rows: ann.nearest_neighbours(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert one([]) == [] and one([(0, [0.0, 0.0])]) == [] and one([(0, [1.0, 0.0])]) == []
    assert [(r["vec_id"], r["score"]) for r in one([(0, [1.0, 0.0]), (5, [1.0, 1.0]), (3, [1.0, 1.0])])] == [(3, 1.0), (5, 1.0)]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute(rows, len(rows[0][1]))
    got = ann.nearest_neighbours(spark, df).groupBy("query_id").agg(F.collect_set("vec_id").alias("x")).collect()
    assert sum(len(set(r["x"]) & {i for i, _ in want[r["query_id"]][0]}) for r in got) >= 9 * len(want)
