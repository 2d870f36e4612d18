"""Line dedup by content-defined chunks, in DataFrame functions alone.

The hash of each line rolls into one over WINDOW neighbouring lines, and of each `spread` neighbouring rolling hashes the
least ends a chunk. Borders thus depend on a few lines around them and not on their position, and come back wherever a
passage does. A line of min_words / (2 spread) words or more is a chunk of its own. So any passage of min_words words
that stands at two places has a chunk in common there: with over 2 spread lines it holds two borders that its own lines
decide, and with fewer it holds such a long line.

Blank lines go with the line before them: they are not compared, and part no passage.

A chunk that stands at an earlier place too (by doc_id, then line) is a repeat. Where it does, it is extended line by
line to both sides, and with the chunks beside it that repeat the same document at the same distance it makes up one
stretch, the longest that both places share. Stretches and their sources are then compared byte by byte; where a group
of equal hashes holds different bytes, all of it stays. What overlaps is taken together, and stretches of min_words
words or more go. The first place of any line is never removed: each removed line has an equal one at an earlier place.

min_words tells passages from lines that documents share by nature (headings, greetings, notices); 50 words are about
a paragraph.

Defined results: the blank lines after a removed line go with it (those at a text's beginning stay); null texts stay null and empty ones empty; a document removed whole has an empty text; rows that
repeat both doc_id and text are one document and get the same result; null ids come last; an empty table gives no
rows; all other columns of docs are kept as they are, whatever they are called (but for columns with the names of those
that dedup_lines adds, which it replaces).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, settle

WINDOW = 2
MIN_WORDS = 50
SPREAD = 2
NO_ID = (1 << 63) - 1
#: Rolling hashes are taken modulo a prime, of digits small enough for longs.
DIGITS, BASE, PRIME = 7, 31, 268_435_399
ADDED = ("n_lines", "n_removed_lines", "n_removed_words")


#: A noncharacter that stands for line ends that are followed by a blank line or by nothing.
BLANK = "\ufdd0"


def lines_of(text: Column) -> Column:
    """The lines of a text, each with the blank lines after it, whose line ends are BLANK. Texts that hold that character
    themselves are split at every line end."""
    return F.split(F.when(text.contains(BLANK), text).otherwise(F.regexp_replace(text, r"\n(?=[ \t\r]*(?:\n|\z))", BLANK)), "\n")


def bare_lines(text: Column) -> Column:
    """The same lines without the blank ones after them. What is asked of the whole text is asked once, not by the line."""
    return F.when(text.contains(BLANK), F.split(text, "\n")).otherwise(F.transform(lines_of(text), lambda x: F.substring_index(x, BLANK, 1)))


def words_in(line: Column) -> Column:
    """Runs of anything but white space and BLANK."""
    return F.regexp_count(line, F.lit(rf"[^ \t\r\n{BLANK}]+"))


def border_digit(line: Column) -> Column:
    """A number from the line's MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(line), 1, DIGITS), 16, 10).cast("long")


def chunks(docs: DataFrame, min_words: int = MIN_WORDS, spread: int = SPREAD, hash_of=F.xxhash64) -> DataFrame:
    """id, key, a, b, h, before, after: every chunk with a word in it, by its first and last line, its hash, and the
    hashes of the lines beside it, nearest first."""
    rows = docs.where(F.length("text") > 0).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("key"), "text", F.split("text", "\n").alias("every"))
    # Few texts have blank lines; the others need no second look.
    rows = rows.withColumn("counted", F.transform("every", words_in)).withColumn("blank", F.array_contains("counted", 0))
    rows = rows.withColumn("lines", F.when(F.col("blank"), bare_lines(F.col("text"))).otherwise(F.col("every")))
    rows = rows.withColumn("words", F.when(F.col("blank"), F.transform("lines", words_in)).otherwise(F.col("counted"))).drop("text", "every", "counted", "blank")
    rows = rows.withColumns({"hs": F.transform("lines", lambda x: F.xxhash64(x)), "digits": F.transform("lines", border_digit)})
    n, reach = F.size("lines"), spread + 1
    rolled = lambda i: F.pmod(sum((F.get("digits", i - j) * BASE**j for j in range(1, WINDOW)), F.get("digits", i)), F.lit(PRIME))
    rows = rows.withColumn("roll", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i >= WINDOW - 1, rolled(i))))
    # The first of the least of each group of neighbouring rolling hashes.
    group = lambda s: F.slice("roll", s + 1, F.lit(spread))
    least = lambda s: s - 1 + F.array_position(group(s), F.array_min(group(s)))
    none = F.array().cast("array<long>")
    rolling = F.when(n >= WINDOW - 1 + spread, F.transform(F.sequence(F.lit(WINDOW - 1), n - spread), lambda s: least(s).cast("long"))).otherwise(none)
    alone = lambda i: F.coalesce(F.get("words", i) * (2 * spread) >= min_words, F.lit(False))
    lines = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("long"))
    rows = rows.withColumn("ends", F.array_sort(F.array_distinct(F.concat(rolling, F.filter(lines, lambda i: alone(i.cast("int")) | alone((i + 1).cast("int")) | (i == n - 1))))))
    begins = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("ends", k - 1) + 1).cast("int")
    chunk = lambda a, b: F.struct(
        a.alias("a"), b.alias("b"), hash_of(F.slice("hs", a + 1, b - a + 1)).alias("h"), F.exists(F.slice("words", a + 1, b - a + 1), lambda w: w > 0).alias("has_words"),
        F.reverse(F.slice("hs", F.greatest(a - reach, F.lit(0)) + 1, F.least(a, F.lit(reach)))).alias("before"), F.slice("hs", b + 2, F.lit(reach)).alias("after"),
    )
    every = rows.select("id", "key", F.explode(F.transform("ends", lambda e, k: chunk(begins(k), e.cast("int")))).alias("c"))
    return every.where("c.has_words").select("id", "key", "c.a", "c.b", "c.h", "c.before", "c.after")


def _shared(x: str, y: str, reach: int) -> Column:
    """How many elements two arrays have in common from the start on."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(reach - 1)), lambda k: (F.size(x) > k) & (F.size(y) > k) & (F.slice(x, F.lit(1), k + 1) == F.slice(y, F.lit(1), k + 1))))


def stretches(docs: DataFrame, min_words: int = MIN_WORDS, spread: int = SPREAD, hash_of=F.xxhash64) -> DataFrame:
    """id, key, a, b, id0, key0, a0: lines a to b of a document repeat those from a0 on of one that stands before it, as
    far as hashes tell."""
    every = chunks(docs, min_words, spread, hash_of)
    # Counts first, so that neighbours travel with chunks that repeat and not with all; tables are stored so that plain
    # rows meet in joins, and Spark can split a hash that very many chunks have.
    again = settle(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-hashes")
    found = settle(every.join(again, "h"), "repeated-chunks")
    first = settle(found.groupBy("h").agg(F.min(F.struct("id", "key", "a", "before", "after")).alias("x")), "first-places")
    first = first.select("h", F.col("x.id").alias("id0"), F.col("x.key").alias("key0"), F.col("x.a").alias("a0"), F.col("x.before").alias("before0"), F.col("x.after").alias("after0"))
    later = found.join(first, "h").where(F.struct("id", "key", "a") != F.struct("id0", "key0", "a0"))
    own = ["id", "key", "id0", "key0", "shift"]
    later = later.select("id", "key", "id0", "key0", (F.col("a") - F.col("a0")).alias("shift"), (F.col("a") - _shared("before", "before0", spread + 1)).alias("a"), (F.col("b") + _shared("after", "after0", spread + 1)).alias("b"))
    w = Window.partitionBy(*own).orderBy("a", "b")  # one order for both, so that equal rows follow each other alike
    reached = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(reached + 1 >= F.col("a"), 0).otherwise(1)).withColumn("n", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = later.groupBy(*own, "n").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return whole.select("id", "key", "a", "b", "id0", "key0", (F.col("a") - F.col("shift")).alias("a0"))


SPANS = "array<struct<repeat:boolean,a:int,b:int,g:bigint>>"


def _with_spans(docs: DataFrame, found: DataFrame, names: dict[str, str]) -> DataFrame:
    """docs with the stretches of each, repeats and sources, beside it."""
    g = F.xxhash64("id0", "key0", "a0", F.col("b") - F.col("a"))
    pairs = found.select("id", "key", F.struct(F.lit(True).alias("repeat"), "a", "b", g.alias("g")).alias("s"))
    sources = found.select(F.col("id0").alias("id"), F.col("key0").alias("key"), F.struct(F.lit(False).alias("repeat"), F.col("a0").alias("a"), (F.col("a0") + F.col("b") - F.col("a")).alias("b"), g.alias("g")).alias("s")).distinct()
    spans = pairs.unionByName(sources).groupBy(F.col("id").alias(names["id"]), F.col("key").alias(names["key"])).agg(F.collect_set("s").alias(names["spans"]))
    marked = docs.withColumns({names["own"]: F.coalesce("doc_id", F.lit(NO_ID)), names["text"]: F.xxhash64("text")})
    return marked.join(spans, (F.col(names["own"]) == F.col(names["id"])) & (F.col(names["text"]) == F.col(names["key"])), "left").drop(names["own"], names["text"])


def _differing(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """g of the groups whose stretches are not all the same bytes. Equal ones meet within a task before the shuffle."""
    body = lambda lines, s: F.array_join(F.slice(lines, s["a"] + 1, s["b"] - s["a"] + 1), "\n")
    # The lines are a lambda's argument, and so made once for all stretches of a text.
    bodies = F.transform(F.array(bare_lines(F.col("text"))), lambda lines: F.transform(names["spans"], lambda s: F.struct(s["g"].alias("g"), body(lines, s).alias("body"))))
    each = rows.where(F.col(names["spans"]).isNotNull()).select(F.explode(bodies[0]).alias("s"))
    return each.select("s.g", "s.body").distinct().groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, spread: int = SPREAD, hash_of=F.xxhash64) -> DataFrame:
    """docs with repeated passages taken out of text, and n_lines, n_removed_lines, n_removed_words beside them."""
    docs = docs.drop(*ADDED)
    keys = ["id", "key", "spans", "own", "text", "lines", "gone"]
    names = dict(zip(keys, free_names([f"ld_{k}" for k in keys], docs.columns), strict=True))
    rows = settle(_with_spans(docs, stretches(docs, min_words, spread, hash_of), names), "documents-with-stretches", compression="zstd")
    doubt = settle(_differing(rows, names), "differing-stretches")
    if doubt.head(1):
        # Rare: stretches of these groups are taken off the documents that have them.
        each = rows.select(names["id"], names["key"], F.explode(names["spans"]).alias("s")).distinct().join(doubt, F.col("s.g") == F.col("g"), "left_anti")
        fine = each.groupBy(F.col(names["id"]).alias(names["own"]), F.col(names["key"]).alias(names["text"])).agg(F.collect_set("s").alias(names["lines"]))
        rows = rows.join(fine, (F.col(names["id"]) == F.col(names["own"])) & (F.col(names["key"]) == F.col(names["text"])), "left")
        rows = rows.withColumn(names["spans"], F.col(names["lines"])).drop(names["own"], names["text"], names["lines"])
    rows = rows.withColumn(names["lines"], F.when(F.col(names["spans"]).isNotNull(), lines_of(F.col("text"))).otherwise(F.array().cast("array<string>")))
    repeats = F.array_sort(F.transform(F.filter(F.coalesce(names["spans"], F.array().cast(SPANS)), lambda s: s["repeat"]), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))))
    none = F.array().cast("array<struct<a:int,b:int>>")
    last = lambda done: F.get(done, F.size(done) - 1)
    wider = lambda done, s: F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last(done)["a"].alias("a"), F.greatest(last(done)["b"], s["b"]).alias("b"))))
    joined = F.aggregate(repeats, none, lambda done, s: F.when((F.size(done) > 0) & (last(done)["b"] >= s["a"]), wider(done, s)).otherwise(F.concat(done, F.array(s))))
    size = lambda s: F.aggregate(F.slice(names["lines"], s["a"] + 1, s["b"] - s["a"] + 1), F.lit(0), lambda n, x: n + words_in(x))
    rows = rows.withColumn(names["gone"], F.filter(joined, lambda s: size(s) >= min_words))
    kept = F.filter(names["lines"], lambda x, i: ~F.exists(names["gone"], lambda s: (i >= s["a"]) & (i <= s["b"])))
    ends = lambda x: 1 + F.length(x) - F.length(F.replace(x, F.lit(BLANK), F.lit("")))
    blank = lambda s: F.aggregate(F.slice(names["lines"], s["a"] + 1, s["b"] - s["a"] + 1), F.lit(0), lambda n, x: n + ends(x))
    height = lambda s: F.when(F.col("text").contains(BLANK), s["b"] - s["a"] + 1).otherwise(blank(s))
    whole = F.array_join(kept, "\n")
    whole = F.when(F.col("text").contains(BLANK), whole).otherwise(F.replace(whole, F.lit(BLANK), F.lit("\n")))
    total = lambda f: F.aggregate(names["gone"], F.lit(0), lambda n, s: n + f(s))
    out = [F.when(F.size(names["gone"]) > 0, whole).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(
        *out, F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0).cast("long").alias("n_lines"),
        total(height).cast("long").alias("n_removed_lines"), total(size).cast("long").alias("n_removed_words"),
    )


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, spread: int = SPREAD) -> DataFrame:
    """docs, its own columns alone, with repeated passages taken out of text."""
    kept = dict(zip(ADDED, free_names([f"ld_kept_{c}" for c in ADDED], docs.columns), strict=True))
    there = {c: kept[c] for c in ADDED if c in docs.columns}
    out = dedup_lines(docs.withColumnsRenamed(there), min_words, spread).drop(*ADDED)
    return out.withColumnsRenamed({v: k for k, v in there.items()}).select(*docs.columns)
