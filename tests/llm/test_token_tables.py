"""Token counts, sorted tables and packing against the libraries, by exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyard.llm import packing, sstable, token_counts, tokens


def corpus(n=60, seed=9):
    r = random.Random(seed)
    rows = [(0, None), (1, ""), (2, "a\n\nb  c\t"), (3, "<|endoftext|> x"), (-4, "é ñ"), (5, "word " * 9000 + "."), (6, "same text"), (7, "same text")]
    rows += [(k, " ".join(r.choice(["the", "of", "ing", "Xyz", "é", "12", "foo."]) + str(r.randrange(50)) for _ in range(r.choice([3, 60, 900])))) for k in range(8, n)]
    return [*rows, (8, rows[8][1]), (8, "another text under one id"), (None, "without an id")]


def library(name, text, end):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokens.place(name)).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, end], "<u4").tobytes()


def test_counts_and_cache(spark, docs_of, tmp_path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.place("piece_bpe_32k.model"))
    rows, cache = corpus(), f"file://{tmp_path}/cache"
    for again in (False, True):
        got = token_counts.token_counts(spark, docs_of(rows), "piece_bpe_32k.model", cache)
        assert {r["cached"] for r in got.collect()} == {again}  # the second run finds every count
        assert sorted(map(str, got.drop("cached").collect())) == sorted(f"Row(doc_id={i}, n_bytes={len((t or '').encode())}, n_tokens={len(sp.encode(t or ''))}, over_limit={len(sp.encode(t or '')) > 4096})" for i, t in rows)
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})  # the second run encodes nothing
    more = token_counts.token_counts(spark, docs_of([(1, "new"), (2, "new"), (3, "same text")]), "piece_bpe_32k.model", cache)
    assert {r["doc_id"]: r["cached"] for r in more.collect()} == {1: False, 2: False, 3: True} and spark.read.parquet(cache).count() == len({t or "" for _, t in rows}) + 1
    assert token_counts.token_counts(spark, docs_of([]), "byte_bpe_50k.json").count() == 0


def test_a_run_reads_its_own_part_of_the_cache(spark, docs_of, tmp_path, monkeypatch):
    cache, texts = f"file://{tmp_path}/cache", [f"text number {k}" for k in range(60)]
    first = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(spark, docs_of(list(enumerate(texts))), "piece_bpe_32k.model", cache).collect()}
    mine = hashlib.sha256(texts[7].encode()).hexdigest()[:2].upper()
    files = list((tmp_path / "cache").glob("version=*/part=*/*.parquet"))
    others = [f for f in files if f.parent.name != f"part={mine}"]
    assert len(others) > 20 and len(files) - len(others) >= 1
    for f in others:  # a run that looked into them would fail
        f.write_bytes(b"not a parquet file")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    for few in (token_counts.FEW_DIGESTS, 0):  # sent to all tasks, or joined by a shuffle
        monkeypatch.setattr(token_counts, "FEW_DIGESTS", few)
        got = token_counts.token_counts(spark, docs_of([(1, texts[7]), (2, texts[7])]), "piece_bpe_32k.model", cache).collect()
        assert [(r["n_tokens"], r["cached"]) for r in got] == [(first[7], True)] * 2
    other = token_counts.token_counts(spark, docs_of([(1, texts[7])]), "byte_bpe_50k.json", cache).collect()
    assert [r["cached"] for r in other] == [False]  # another vocabulary's counts are its own


def test_contents_that_differ_in_spaces_alone_share_a_count(spark, docs_of, tmp_path):
    assert tokens.drops_spaces("word_bpe_49k.json") and not tokens.drops_spaces("byte_bpe_50k.json") and not tokens.drops_spaces("piece_bpe_32k.model")
    texts, cache = ["a b\n c", " a   b\n  c ", "a b\nc", "  ", ""], f"file://{tmp_path}/cache"
    got = token_counts.token_counts(spark, docs_of(list(enumerate(texts))), "word_bpe_49k.json", cache).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(library("word_bpe_49k.json", t, 0)) // 4 - 1 for t in texts]
    assert [r["n_bytes"] for r in got] == [len(t) for t in texts] and spark.read.parquet(cache).count() == 3


def test_sorted_tables_round_trip(spark, docs_of, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 2000)
    rows = corpus()
    manifest = sstable.write_shards(spark, docs_of(rows), "byte_bpe_50k.json", 2)
    got = sstable.read_shards(spark, manifest).orderBy("start").collect()
    came = [zlib.crc32(r["ids"]) for r in got]  # the order of rows that share an id is free
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, came.index(zlib.crc32(library("byte_bpe_50k.json", r[1], 2)))))
    want, start = [], 0
    for i, t in order:
        data = library("byte_bpe_50k.json", t, 2)
        want.append((i, start, len(data) // 4, zlib.crc32(data)))
        start += len(data) // 4
    assert [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in got] == want
    shards = [sstable.Shard(r["path"]) for r in manifest.collect()]
    for i in (-4, 5, 8, None):
        assert sorted(v for s in shards for v in s.get(i)) == sorted(library("byte_bpe_50k.json", t, 2) for j, t in rows if j == i)
    assert not any(s.get(10**9) for s in shards)
    assert sstable.write_shards(spark, docs_of([]), "byte_bpe_50k.json", 2).count() == 0
    one_id = docs_of([(5, f"text {k} " * 40) for k in range(400)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert sstable.write_shards(spark, one_id, "byte_bpe_50k.json", 2).count() > 1  # dealt to several shards
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_shards_and_ranges_go_by_bytes(spark, docs_of):
    rows = [(k, "some words of a text " * (1 + k % 7)) for k in range(300)] + [(400, "long " * 5000), (401, None), (402, "")]
    docs, name = docs_of(rows), "byte_bpe_50k.json"
    want = {i: library(name, t, 2) for i, t in rows}
    whole = sstable.write_shards(spark, docs.coalesce(1), name, 2).count()
    small = sstable.write_shards(spark, docs, name, 2, most_bytes=3000)
    shards = small.orderBy("first_key").collect()
    assert len(shards) > 5 * whole and all(r["n_docs"] == 1 or 4 * r["n_ids"] + sstable.ENTRY_BYTES * r["n_docs"] <= 3000 for r in shards)
    assert all(a["last_key"] < b["first_key"] for a, b in zip(shards, shards[1:], strict=False))
    got = sstable.read_shards(spark, small).orderBy("start").collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: v for i, v in want.items()} and [r["doc_id"] for r in got] == sorted(want)
    assert [r["start"] for r in got] == [sum(len(want[i]) // 4 for i in sorted(want)[:k]) for k in range(len(want))]
    size = sum(len(t or "") for _, t in rows)
    ranged = sstable.write_shards(spark, docs, name, 2, range_bytes=size // 20).count()
    assert ranged > int(spark.conf.get("spark.sql.shuffle.partitions"))  # more ranges than the session's number


def test_a_damaged_shard_is_refused(tmp_path):
    path = tmp_path / "shard"
    path.write_bytes(b"".join(sstable.shard_bytes(iter([(k, b"\1\0\0\0" * k) for k in range(50)]), {})))
    assert sstable.Shard(str(path)).get(7) == [b"\1\0\0\0" * 7]
    data = bytearray(path.read_bytes())
    data[3] ^= 255
    path.write_bytes(data)
    with pytest.raises(ValueError, match="checksum"):
        sstable.Shard(str(path)).get(7)
    path.write_bytes(data[:-1])
    with pytest.raises(ValueError, match="shard"):
        sstable.Shard(str(path))


def slow_sum_of_squares(lengths, capacity):
    bins = []
    for s in sorted(lengths, reverse=True):
        best = None
        for g in sorted({capacity - sum(b) for b in bins} | {capacity}):
            if g < s:
                continue
            trial = [capacity - sum(b) for b in bins]
            if g in trial:
                trial[trial.index(g)] = g - s
            else:
                trial.append(g - s)
            if g == capacity and g not in trial and capacity - s not in trial:
                continue
            cost = sum(trial.count(x) ** 2 for x in set(trial) - {0})
            if best is None or cost < best[0]:
                best = (cost, g)
        spot = next((b for b in bins if capacity - sum(b) == best[1]), None)
        if spot is None:
            bins.append([s])
        else:
            spot.append(s)
    return sorted(sum(b) for b in bins)


def test_sum_of_squares_equals_brute_force():
    r = random.Random(4)
    for _ in range(40):
        capacity = r.choice([7, 12, 20])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 30))]
        where, offset, free = packing.sum_of_squares(np.array(lengths), capacity)
        fill = np.zeros(len(free), np.int64)
        np.add.at(fill, where, lengths)
        assert sorted(fill) == slow_sum_of_squares(lengths, capacity)
        for b in range(len(free)):
            spans = sorted((offset[k], lengths[k]) for k in np.flatnonzero(where == b))
            assert spans[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(spans, spans[1:]))


def test_places_of_the_last_partitions(spark):
    rows = [((1 << 31) - 1 << 32 | k, n) for k, n in enumerate([100, 60, 40, 100])] + [(k, 50) for k in range(3)]
    got = {r["row_id"]: (r["sequence_id"], r["offset"]) for r in packing.assign(spark.createDataFrame(rows, "row_id long, length long"), 100).collect()}
    assert len(got) == 7 and len({s for s, _ in got.values()}) == 5
    assert all(s == r for r, (s, _) in got.items() if dict(rows)[r] == 100) and all(s < 0 for r, (s, _) in got.items() if dict(rows)[r] < 100)


def test_packing(spark, docs_of, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 40)
    rows = corpus(120)
    got = packing.pack(spark, docs_of(rows), "word_bpe_49k.json", 1, 1000).collect()
    docs = {}
    for r in got:
        docs.setdefault(r["doc_id"], []).append((r["start"], r["piece"], r["length"], bytes(r["ids"])))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(library("word_bpe_49k.json", t, 1))
    for i, whole in want.items():
        assert sum(len(x) for x in whole) == sum(len(p[3]) for p in docs[i])
        if len(whole) == 1:
            assert b"".join(p[3] for p in sorted(docs[i])) == whole[0]
            assert all(n == 1000 for _, _, n, _ in sorted(docs[i])[:-1])
    fill = {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in fill.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 1000
    room = []  # no more sequences than first fit, longest first, over all pieces at once, and one for each further shard
    for n in sorted((r["length"] for r in got), reverse=True):
        k = next((k for k, x in enumerate(room) if x >= n), None)
        if k is None:
            room.append(1000 - n)
        else:
            room[k] -= n
    assert len(fill) <= len(room) + 3
    assert packing.pack(spark, docs_of([]), "word_bpe_49k.json").count() == 0
