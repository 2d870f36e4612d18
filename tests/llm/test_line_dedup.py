import hashlib
import random
import re

from pyspark.sql import functions as F

from tallyard.llm import line_dedup


def units(text):
    """Each line with the wordless lines after it."""
    out = []
    for line in text.split("\n"):
        if out and not re.search("[^ \t\r]", line):
            out[-1].append(line)
        else:
            out.append([line])
    return out


def brute(rows, min_words=50, spread=2):
    """Chunks between least rolling hashes and around long lines; those found again grow line by line, and with what
    they overlap go if long enough."""
    count = lambda x: len(re.findall("[^ \t\r\n]+", x))
    order = sorted((k for k in range(len(rows)) if rows[k][1]), key=lambda k: (rows[k][0] if rows[k][0] is not None else 1 << 62, k))
    parts = {k: units(rows[k][1]) for k in order}
    lines = {k: [x[0] for x in parts[k]] for k in order}
    places, gone = {}, {k: [] for k in order}
    for k in order:
        digits = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines[k]]
        roll = {i: (digits[i - 1] * 31 + digits[i]) % 268_435_399 for i in range(1, len(digits))}
        long = [count(x) * 2 * spread >= min_words for x in lines[k]] + [False]
        ends = {min(range(s, s + spread), key=lambda i: (roll[i], i)) for s in range(1, len(digits) - spread + 1)}
        ends |= {i for i in range(len(digits)) if long[i] or long[i + 1] or i == len(digits) - 1}
        a = 0
        for b in sorted(ends):
            body = tuple(lines[k][a : b + 1])
            if any(map(count, body)):
                source = places.setdefault(body, (k, a))
                if source != (k, a):
                    gone[k].append((source[0], a - source[1], a, b))
            a = b + 1
    out = {k: rows[k][1] for k in range(len(rows))}
    for k in order:
        own, merged = lines[k], []
        reached = set()
        for source, shift, a, b in gone[k]:
            near = lambda i: 0 <= i < len(own) and 0 <= i - shift < len(lines[source]) and own[i] == lines[source][i - shift]  # noqa: B023, E731
            for _ in range(spread + 1):
                a -= near(a - 1)
            for _ in range(spread + 1):
                b += near(b + 1)
            reached |= {(source, shift, i) for i in range(a, b + 1)}
        for source, shift, i in sorted(reached, key=lambda x: x[2]):  # a stretch is what stands together in one source
            if (source, shift, i - 1) not in reached:
                b = i
                while (source, shift, b + 1) in reached:
                    b += 1
                merged.append((i, b))
        done = []
        for a, b in sorted(merged):
            if done and a <= done[-1][1]:
                done[-1][1] = max(b, done[-1][1])
            else:
                done.append([a, b])
        done = [(a, b) for a, b in done if sum(map(count, own[a : b + 1])) >= min_words]
        out[k] = "\n".join("\n".join(x) for j, x in enumerate(parts[k]) if not any(a <= j <= b for a, b in done))
    return [out[k] for k in range(len(rows))]


def corpus(seed=2):
    r = random.Random(seed)
    line = lambda n: " ".join(r.choice("abcdefghij") + str(r.randrange(200)) for _ in range(n))
    passages = [[line(r.choice([5, 20, 60])) for _ in range(r.randint(1, 6))] for _ in range(12)]
    boiler = line(8)
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "x"), (4, line(20000)), (5, "\n".join([line(9)] * 30))]
    for k in range(6, 90):
        parts = [[line(r.randint(1, 30)) for _ in range(r.randint(0, 4))] for _ in range(2)]
        gap = r.choice(["", "", "\n", "\n \t\n\n"])
        rows.append((k, r.choice(["", "", "\n\n"]) + "\n".join(parts[0] + ([x + gap for x in r.choice(passages)] if r.random() < 0.6 else []) + [boiler] + parts[1]) + gap))
    return [*rows, (90, rows[20][1]), (91, rows[20][1]), (None, rows[21][1])]


def test_equals_brute_force(spark, docs_of):
    rows = corpus()
    docs = docs_of(rows)
    out = line_dedup.dedup_lines(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    for (i, t), want in zip(rows, brute(rows)):
        assert got[i]["text"] == want, i
    plain = line_dedup.without_repeats(docs)
    assert plain.columns == docs.columns and {r["n_words"] for r in plain.collect()} == {"kept"}


def test_spread(spark, docs_of):
    rows = corpus(4)
    for spread in (1, 3):
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(rows), spread=spread).collect()}
        assert [got[i] for i, _ in rows] == brute(rows, spread=spread)
    borders = [  # with no line long enough to be a chunk of its own
        line_dedup.chunks(docs_of(rows), 10**9, s).select("id", "a", "b").distinct().count() for s in (1, 2, 3)
    ]
    assert borders[0] > borders[1] > borders[2]


def test_every_long_repeat_has_a_chunk_in_common(spark, docs_of):
    r = random.Random(8)
    line = lambda n: " ".join(str(r.randrange(10**6)) for _ in range(n))
    rows = []
    for k in range(60):  # passages of just 50 words in lines of any number, each between lines of their own
        n = r.randint(1, 12)
        cuts = sorted(r.sample(range(1, 50), n - 1))
        passage = [line(b - a) for a, b in zip([0, *cuts], [*cuts, 50])]
        rows += [(2 * k + j, "\n".join([line(3), *passage, line(4), line(9)][j:])) for j in (0, 1)]
        rows[-1] = (rows[-1][0], "\n".join([line(5), line(2), *passage, line(6)]))
    got = {r["doc_id"]: r["n_removed_words"] for r in line_dedup.dedup_lines(docs_of(rows)).collect()}
    assert all(got[2 * k] == 0 and got[2 * k + 1] == 50 for k in range(60))


def test_blank_lines_part_no_passage(spark, docs_of):
    half = [" ".join(f"{w}{k}" for k in range(30)) for w in ("left", "right")]
    rows = [(1, "own\n" + half[0] + "\n" * 9 + half[1] + "\nend"), (2, "other\n" + half[0] + "\n" + half[1] + "\n \n\nlast"), (3, half[0] + "\n\n" + half[1] + "\n\n"), (4, line_dedup.BLANK + half[0] + "\n\n" + half[1]), (5, "\n\n")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed_lines"], r["n_removed_words"]) for r in line_dedup.dedup_lines(docs_of(rows)).collect()}
    assert got == {1: (rows[0][1], 12, 0, 0), 2: ("other\nlast", 6, 4, 60), 3: ("", 5, 5, 60), 4: (rows[3][1], 3, 0, 0), 5: ("\n\n", 3, 0, 0)}


def test_repeated_rows_change_nothing(spark, docs_of):
    rows = corpus(4)
    a = line_dedup.dedup_lines(docs_of(rows)).select("doc_id", "text").collect()
    b = line_dedup.dedup_lines(docs_of(rows + rows[:40])).select("doc_id", "text").distinct().collect()
    assert sorted(map(str, set(a))) == sorted(map(str, b))


def test_chunks_that_share_a_hash_only_stay(spark, docs_of):
    rows = [(k, "\n".join(f"{w}{k} " * 30 for w in ("one", "two", "ten"))) for k in range(5)] + [(7, "same " * 60), (8, "same " * 60)]
    shared = line_dedup.dedup_lines(docs_of(rows), hash_of=lambda hs: F.when(F.size(hs) > 0, F.when(hs[0] == F.xxhash64(F.lit("same " * 60)), 1).otherwise(2)).cast("long"))
    assert {r["doc_id"]: r["n_removed_lines"] for r in shared.collect()} == {**dict.fromkeys(range(5), 0), 7: 0, 8: 1}


def test_clashing_names(spark, docs_of):
    text = "\n".join(f"{w} " * 30 for w in ("one", "two"))
    docs = docs_of([(1, text), (2, text)]).withColumns({c: F.lit("mine") for c in ("stretches", "ld_id", "LD_KEY", "ld_spans", "ld_lines", "lines", "h", "n_lines", "id")})
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["stretches"], r["ld_id"], r["LD_KEY"], r["n_lines"]) for r in out.collect()) == [(1, text, *["mine"] * 4), (2, "", *["mine"] * 4)]


def test_empty(spark, docs_of):
    assert line_dedup.dedup_lines(docs_of([])).count() == 0
