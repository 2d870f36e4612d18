import random
import re

import pytest

from tallyard.llm import decontaminate


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, n=13, share=20):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for j, x in items:
            v = words(x)
            for k in range(max(1, len(v) - n + 1) if v else 0):
                win = v[k : k + n]
                for a in range(len(w) - len(win) + 1):
                    if w[a : a + len(win)] == win:
                        hit |= set(range(a, a + len(win)))
                        if j is not None:
                            found.add(j)
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and share * len(hit) >= len(w)))
    return sorted(out, key=str)


def corpus(seed=3):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(["the", "of", "And", "née"]) + str(r.randrange(25)) for _ in range(n))
    items = [(k, text(r.choice([3, 13, 20, 40]))) for k in range(12)] + [(12, None), (13, "?!"), (None, text(15)), (4, text(15))]
    items.append((20, items[0][1]))
    docs = [(0, None), (1, ""), (2, "..."), (3, "the " * 3000)]
    for k in range(4, 70):
        parts = [text(r.randrange(60))]
        for _ in range(r.randrange(3)):
            x = (r.choice(items)[1] or "").split()
            a = r.randrange(len(x) + 1)
            parts += [r.choice([" ".join(x).upper(), ", ".join(x), " ".join(x[a:])]), text(r.randrange(300))]
        docs.append((k, "\n".join(parts)))
    return [*docs, docs[10], (None, items[1][1])], items


@pytest.mark.parametrize(("block", "item_bytes"), [(1_000_000, 16 << 20), (50, 300)])
def test_equals_brute_force(spark, docs_of, monkeypatch, block, item_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", item_bytes)
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judge(spark, docs_of(docs), bench).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got), key=str) == brute(docs, items)
    assert all(r["n_items"] == len(r["items"]) for r in got)


def test_stage_keeps_what_is_clean(spark, docs_of):
    docs, items = corpus(8)
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.without_contaminated(spark, docs_of(docs), bench)
    want = [i for i, _, _, _, bad in brute(docs, items) if not bad]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, want)) and kept.columns == docs_of(docs).columns


def test_ids_of_another_type_and_clashing_names(spark, docs_of):
    docs, items = corpus()
    bench = spark.createDataFrame([(None if i is None else f"item {i}", t) for i, t in items], "item_id string, text string")
    clash = docs_of(docs).selectExpr("*", *[f"'mine' AS {c}" for c in ("text_key", "BAD_ID", "items", "block", "_dc_bad")])
    got = {r["doc_id"]: r["items"] for r in decontaminate.judge(spark, clash, bench).collect()}
    assert all(got[i] == sorted(f"item {x}" for x in found) for i, _, _, found, _ in brute(docs, items) if i is not None)
    kept = decontaminate.without_contaminated(spark, clash, bench)
    assert kept.columns == clash.columns and kept.count() == sum(not bad for *_, bad in brute(docs, items))


def test_blocks_close_by_rows_too(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 10)
    docs = [(k, "") for k in range(200)] + [(200, "one two three")]
    index = decontaminate.build_index(spark, docs_of(docs))
    assert max(len(r["doc_ids"]) for r in index.collect()) == 10
    assert decontaminate.judge(spark, docs_of(docs), spark.createDataFrame([(1, "one two")], "item_id long, text string")).where("n_hit = 2").count() == 1


def test_proximity(spark, docs_of):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = docs_of([(1, "x alpha beta gamma delta"), (2, "alpha so beta gamma delta"), (3, "delta gamma"), (4, "alpha beta"), (5, "gamma delta")])
    index = decontaminate.build_index(spark, docs)
    assert decontaminate.matches(spark, index, bench, 4).count() == 1
    assert decontaminate.matches(spark, index, bench, 4, near=1).count() == 2
    with pytest.raises(ValueError, match="reach"):
        decontaminate.matches(spark, index, bench, 80)


def test_empty(spark, docs_of):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judge(spark, docs_of([]), bench).count() == 0
    assert [r["n_words"] for r in decontaminate.judge(spark, docs_of([(1, "a b")]), bench).collect()] == [2]


def test_rows_that_repeat_an_item_do_not_fill_a_block(spark, docs_of, monkeypatch):
    docs, items = corpus()
    taken, query = [], decontaminate._query
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 400)
    monkeypatch.setattr(decontaminate, "_query", lambda spark, index, mine, window: taken.append(mine) or query(spark, index, mine, window))
    result = lambda rows: sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "items", "contaminated")) for r in decontaminate.judge(spark, docs_of(docs), spark.createDataFrame(rows, "item_id long, text string")).collect()), key=str)
    once = result(items)
    taken.clear()
    assert result(items + [items[3]] * 500) == once
    assert sum(map(len, taken)) == len({(i, t or "") for i, t in items})
