"""Queries of the scalar functions, over texts put together from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyard.functions import scalars as S
from tallyard.plans.analogue import entries, table, with_entries
from tallyard.registry import query

_NUM = r"regexp_matches(trim(x), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')"


@query("SELECT o_orderkey AS k, strftime(try_strptime(trim(x), '%d/%m/%Y'), '%Y-%m-%d') AS iso FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE ' ' || strftime(o_orderdate, '%d/%m/%Y') END AS x FROM orders)")
def p1_dmy_to_iso(spark, sf):
    o = table(spark, sf, "orders")
    x = F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "dd/MM/yyyy")))
    return o.select(F.col("o_orderkey").alias("k"), S.dmy_to_iso(x).alias("iso"))


@query(r"""SELECT k, CASE WHEN m THEN regexp_extract(x, '^(.*?)\s*\(([A-Z0-9]{3,5})\)\s*$', 1) ELSE x END AS name, CASE WHEN m THEN regexp_extract(x, '^(.*?)\s*\(([A-Z0-9]{3,5})\)\s*$', 2) ELSE upper(substr(x, 1, 5)) END AS code
FROM (SELECT k, x, regexp_matches(x, '^(.*?)\s*\(([A-Z0-9]{3,5})\)\s*$') AS m FROM (SELECT p_partkey AS k, trim(CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE upper(p_name) || ' (K' || p_partkey % 9000 || ')' END) AS x FROM part))""")
def p2_parse_name_code(spark, sf):
    x = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.concat(F.upper("p_name"), F.lit(" (K"), (F.col("p_partkey") % 9000).cast("string"), F.lit(")")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), S.parse_name_code(x).alias("x")).select("k", "x.name", "x.code")


@query("""SELECT k, CASE WHEN k % 4 = 0 THEN 'UNK' ELSE 'V' || k % 3 END AS venue, CASE WHEN k % 4 = 0 THEN '1' ELSE CAST(k % 11 AS VARCHAR) END AS number FROM (SELECT page_id AS k FROM pages)""")
def p3_url_param(spark, sf):
    k = F.col("page_id")
    url = F.when(k % 4 == 0, F.col("url")).otherwise(F.concat("url", F.lit("?RaceCourse=v"), (k % 3).cast("string"), F.lit("&raceno="), (k % 11).cast("string")))
    return table(spark, sf, "pages").select(k.alias("k"), S.url_param(url, "racecourse").alias("venue"), S.url_param(url, "RaceNo", "1").alias("number"))


_MIXED = "CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '---' WHEN 2 THEN '1 DH' WHEN 3 THEN ' ' || CAST(l_quantity AS VARCHAR) ELSE CAST(l_linenumber AS VARCHAR) END"


def _mixed(spark, sf):
    x = F.when(F.col("l_partkey") % 5 == 0, "").when(F.col("l_partkey") % 5 == 1, "---").when(F.col("l_partkey") % 5 == 2, "1 DH").when(F.col("l_partkey") % 5 == 3, F.concat(F.lit(" "), F.col("l_quantity").cast("string"))).otherwise(F.col("l_linenumber").cast("string"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", x.alias("x"))


@query(f"SELECT l_orderkey, l_partkey, CASE WHEN {_NUM} THEN CAST(trunc(CAST(trim(x) AS DOUBLE)) AS INTEGER) END AS i FROM (SELECT l_orderkey, l_partkey, {_MIXED} AS x FROM lineitem)")
def p4_to_int(spark, sf):
    return _mixed(spark, sf).select("l_orderkey", "l_partkey", S.to_int(F.col("x")).alias("i"))


@query(f"SELECT l_orderkey, l_partkey, CASE WHEN {_NUM} THEN CAST(trim(x) AS DOUBLE) END AS f FROM (SELECT l_orderkey, l_partkey, {_MIXED} AS x FROM lineitem)")
def p5_to_float(spark, sf):
    return _mixed(spark, sf).select("l_orderkey", "l_partkey", S.to_float(F.col("x")).alias("f"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 12 AS INTEGER) END AS n FROM orders")
def p6_contest_no(spark, sf):
    x = F.when(F.col("o_orderkey") % 3 == 0, "TRIAL 4").otherwise(F.concat(F.lit("Race  "), (F.col("o_orderkey") % 12).cast("string"), F.lit(" (674)")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), S.contest_no(x).alias("n"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') || '_R' || o_orderkey AS contest_key FROM orders")
def p7_contest_key(spark, sf):
    return table(spark, sf, "orders").select(S.contest_key(F.col("o_orderdate").cast("date"), F.col("o_orderkey")).alias("contest_key"))


@query("SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS contest_code, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Unknown' END AS participant_code, CASE WHEN p_partkey % 3 = 0 THEN 'Unknown' ELSE CAST(p_size * 100 AS VARCHAR) || 'M' END AS distance FROM part")
def p8_legacy_ids(spark, sf):
    contest = F.concat(F.lit("RACE ("), F.col("p_size").cast("string"), F.lit(")"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(" - "), (F.col("p_size") * 100).cast("string"), F.lit("M "))))
    who = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" ("), F.col("p_brand"), F.lit(")"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), S.legacy_ids(contest, who).alias("x")).select("k", "x.*")


_MARGIN = "CASE l_partkey % 9 WHEN 0 THEN 'nose' WHEN 1 THEN 'SH' WHEN 2 THEN 'HD' WHEN 3 THEN l_linenumber || '-1/2' WHEN 4 THEN l_linenumber || '/4' WHEN 5 THEN CAST(l_linenumber AS VARCHAR) WHEN 6 THEN '-' || l_linenumber WHEN 7 THEN l_linenumber || '-3' END"


@query("SELECT l_orderkey, l_partkey, round(CASE l_partkey % 9 WHEN 0 THEN 0.05 WHEN 1 THEN 0.1 WHEN 2 THEN 0.2 WHEN 3 THEN l_linenumber + 0.5 WHEN 4 THEN l_linenumber / 4.0 WHEN 5 THEN l_linenumber ELSE 0 END::DOUBLE, 4) AS margin FROM lineitem")
def p9_parse_margin(spark, sf):
    n, k = F.col("l_linenumber").cast("string"), F.col("l_partkey") % 9
    x = F.when(k == 0, "nose").when(k == 1, "SH").when(k == 2, "HD").when(k == 3, F.concat(n, F.lit("-1/2"))).when(k == 4, F.concat(n, F.lit("/4"))).when(k == 5, n).when(k == 6, F.concat(F.lit("-"), n)).when(k == 7, F.concat(n, F.lit("-3")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.round(S.parse_margin(x), 4).alias("margin"))


def _running(spark, sf):
    n = F.col("l_linenumber")
    x = F.when(F.col("l_partkey") % 6 == 0, "---").when(F.col("l_partkey") % 6 == 1, n.cast("string")).otherwise(F.concat(n.cast("string"), F.lit("  "), (n + 3).cast("string"), F.lit(" x "), (F.col("l_suppkey") % 9).cast("string")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", S.parse_positions(x).alias("a"))


_RUNNING = "SELECT l_orderkey, l_partkey, CASE l_partkey % 6 WHEN 0 THEN [] WHEN 1 THEN [l_linenumber] ELSE [l_linenumber, l_linenumber + 3, CAST(l_suppkey % 9 AS INTEGER)] END AS a FROM lineitem"


@query(f"SELECT l_orderkey, l_partkey, CAST(len(a) AS INTEGER) AS n, CAST(coalesce(list_sum(a), 0) AS BIGINT) AS total FROM ({_RUNNING})")
def p10_parse_positions(spark, sf):
    return _running(spark, sf).select("l_orderkey", "l_partkey", F.size("a").alias("n"), F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"SELECT l_orderkey, l_partkey, round(CASE WHEN a[1] > 0 THEN 1 / sqrt(a[1]) END, 6) AS esi, CAST(CASE WHEN len(a) >= 2 THEN a[-2] - a[-1] ELSE 0 END AS DOUBLE) AS csi FROM ({_RUNNING})")
def p11_speeds(spark, sf):
    return _running(spark, sf).select("l_orderkey", "l_partkey", F.round(S.early_speed(F.col("a")), 6).alias("esi"), S.closing_speed(F.col("a")).alias("csi"))


@query("SELECT page_id, try_cast(nullif(regexp_extract(url, '([0-9]+)', 1), '') AS DOUBLE) AS n FROM pages")
def p12_first_digits(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.first_digits(F.col("url")).alias("n"))


@query("SELECT o_orderpriority AS p, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS c, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d, o_orderkey AS k FROM orders")
def p13_sanitise_keys(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    raw = o.select(k.alias("k"), F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")).alias("p"), F.when(k % 4 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("c"), F.when(k % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"))
    return S.sanitise_keys(raw, ["p"], ["c"], ["d"])


@query("SELECT p_partkey AS k, CAST(upper(p_type) LIKE '%STEEL%' AS INTEGER) AS turf FROM part")
def p14_is_turf(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), S.is_turf(F.regexp_replace(F.lower("p_type"), "steel", "turf")).alias("turf"))


_COURSE = "CASE p_partkey % 8 WHEN 0 THEN 'A' WHEN 1 THEN 'A+3' WHEN 2 THEN 'B' WHEN 3 THEN 'B+2' WHEN 4 THEN 'C' WHEN 5 THEN 'C+3' WHEN 6 THEN 'none' END"
_GOING = "CASE p_size % 6 WHEN 0 THEN 'fast' WHEN 1 THEN 'Good' WHEN 2 THEN 'YIELDING' WHEN 3 THEN 'soft' WHEN 4 THEN 'mud' END"
_MULT = f"SELECT p_partkey AS k, CASE {_COURSE} WHEN 'A' THEN 1.0 WHEN 'A+3' THEN 1.05 WHEN 'B' THEN 1.1 WHEN 'B+2' THEN 1.15 WHEN 'C' THEN 1.2 WHEN 'C+3' THEN 1.3 ELSE 1.0 END::DOUBLE AS cm, CASE upper({_GOING}) WHEN 'FAST' THEN 1.0 WHEN 'GOOD' THEN 0.9 WHEN 'YIELDING' THEN 0.7 WHEN 'SOFT' THEN 0.6 ELSE 0.9 END::DOUBLE AS gm, p_size, p_retailprice FROM part"


def _surfaces(spark, sf):
    pick = lambda c, names: F.get(F.array(*[F.lit(n) for n in names]), c.cast("int"))
    course = pick(F.col("p_partkey") % 8, ["A", "A+3", "B", "B+2", "C", "C+3", "none", None])
    going = pick(F.col("p_size") % 6, ["fast", "Good", "YIELDING", "soft", "mud", None])
    return table(spark, sf, "part").withColumns({"course": F.concat(F.lit('TURF - "'), course, F.lit('" x')), "going": F.concat(F.lit(" "), going)})


@query(f"SELECT k, cm, gm FROM ({_MULT})")
def p15_multipliers(spark, sf):
    bare = F.regexp_replace("course", r'^TURF - "|" x$', "")
    return _surfaces(spark, sf).select(F.col("p_partkey").alias("k"), S.course_multiplier(bare).alias("cm"), S.going_multiplier(F.col("going")).alias("gm"))


@query(f"SELECT k, round(p_size * cm, 4) AS esi_course, round(p_retailprice * gm, 4) AS csi_going FROM ({_MULT})")
def p16_interactions(spark, sf):
    df = _surfaces(spark, sf).withColumn("bare", F.regexp_replace("course", r'^TURF - "|" x$', ""))
    out = S.interact(df, "p_size", "p_retailprice", "bare", "going")
    return out.select(F.col("p_partkey").alias("k"), F.round("esi_course", 4).alias("esi_course"), F.round("csi_going", 4).alias("csi_going"))


@query("SELECT season, count(*) AS n FROM (SELECT CAST(year(o_orderdate - INTERVAL 8 MONTH) AS VARCHAR) || '/' || CAST(year(o_orderdate - INTERVAL 8 MONTH) + 1 AS VARCHAR) AS season FROM orders) GROUP BY season")
def p17_season_label(spark, sf):
    return table(spark, sf, "orders").groupBy(S.season_label(F.col("o_orderdate").cast("date")).alias("season")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT y || '/' || (y + 1) AS season, make_date(y, 9, 1) AS start, make_date(y + 1, 8, 31) AS \"end\", make_date(y - 5, 9, 1) AS train_start, make_date(y, 8, 31) AS train_end FROM (SELECT CAST(year(o_orderdate - INTERVAL 8 MONTH) AS INTEGER) AS y FROM orders)")
def p18_season_bounds(spark, sf):
    s = table(spark, sf, "orders").select(S.season_label(F.col("o_orderdate").cast("date")).alias("season")).distinct()
    s = s.withColumns({"b": S.season_bounds(F.col("season")), "t": S.train_bounds(F.col("season"))})
    return s.select("season", "b.start", "b.end", F.col("t.start").alias("train_start"), F.col("t.end").alias("train_end"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'Mile' WHEN floor(o_totalprice / 100) <= 1200 THEN 'Sprint' WHEN floor(o_totalprice / 100) <= 1650 THEN 'Mile' ELSE 'Stayer' END AS regime FROM orders")
def p19_distance_regime(spark, sf):
    x = F.when(F.col("o_orderkey") % 9 == 0, "abc").otherwise(F.concat(F.floor(F.col("o_totalprice") / 100).cast("string"), F.lit(" m")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), S.distance_regime(x).alias("regime"))


@query(with_entries("SELECT contest, participant, greatest(0, 20 - position) AS r20, greatest(0, 3 - position) AS r3 FROM E"))
def p20_relevance(spark, sf):
    return entries(spark, sf).select("contest", "participant", S.relevance(F.col("position")).alias("r20"), S.relevance(F.col("position"), 3).alias("r3"))


@query(with_entries("SELECT contest, participant, CAST(position = 1 AS INTEGER) AS is_win, CAST(position <= 3 AS INTEGER) AS is_place, CAST(position <= 2 AS INTEGER) AS is_pair_hit FROM E"))
def p21_targets(spark, sf):
    return S.targets(entries(spark, sf)).select("contest", "participant", "is_win", "is_place", "is_pair_hit")


@query(with_entries("SELECT contest, participant, round(1 / odds, 6) AS implied, round(discount * 5 - 1 / odds, 6) AS delta FROM E"))
def p22_implied(spark, sf):
    return entries(spark, sf).select("contest", "participant", F.round(S.implied_prob(F.col("odds")), 6).alias("implied"), F.round(S.alpha_delta(F.col("discount") * 5, F.col("odds")), 6).alias("delta"))


@query("SELECT CASE WHEN o_orderdate >= DATE '2000-01-01' THEN 'test' WHEN o_orderdate >= DATE '1999-01-01' THEN 'calibrate' ELSE 'train' END AS part, count(*) AS n FROM orders GROUP BY 1")
def p23_time_split(spark, sf):
    part = S.time_split(F.col("o_orderdate").cast("date"), ["1999-01-01", "2000-01-01"], ["train", "calibrate", "test"])
    return table(spark, sf, "orders").groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderkey % 6 <> 0 AND o_custkey % 10 <> 0")
def p24_require(spark, sf):
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderkey")).alias("k"), F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("c"))
    return S.require(o, ["k", "c"])


@query("SELECT k, a[1] AS a, a[2] AS b, a[3] AS c FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 < 2 AND len(list_distinct(a)) = 3 THEN list_sort(a) END AS a FROM (SELECT o_orderkey, [CAST(o_orderkey % 13 AS INTEGER), CAST(o_custkey % 11 AS INTEGER), CAST(o_custkey % 7 AS INTEGER)] AS a FROM orders))")
def p26_clean_combo(spark, sf):
    k = F.col("o_orderkey")
    text = F.concat_ws(",", (k % 13).cast("string"), (F.col("o_custkey") % 11).cast("string"), (F.col("o_custkey") % 7).cast("string"))
    x = F.when(k % 5 < 2, text).when(k % 5 == 2, F.concat(text, F.lit("/1"))).when(k % 5 == 3, F.lit("A,1,2")).otherwise("1,2")
    a = S.clean_combo(x)
    return table(spark, sf, "orders").select(k.alias("k"), F.get(a, F.lit(0)).alias("a"), F.get(a, F.lit(1)).alias("b"), F.get(a, F.lit(2)).alias("c"))


@query("""SELECT p_partkey AS k, 'RACE ' || (p_partkey % 12) || ' x' AS title, p_type AS going, p_brand AS course, CASE p_partkey % 3 WHEN 0 THEN CAST(1000 + p_size * 10 AS VARCHAR) WHEN 1 THEN CAST(1000 + p_size AS VARCHAR) ELSE '' END AS distance,
CASE WHEN p_partkey % 2 = 0 THEN 'Class ' || p_size ELSE 'Griffin' END AS klass, CAST(p_partkey AS VARCHAR) AS prize FROM part""")
def p27_header_fields(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    d = F.when(k % 3 == 0, F.concat(F.format_number(1000 + n * 10, 0), F.lit(" Metres"))).when(k % 3 == 1, F.concat((1000 + n).cast("string"), F.lit("m"))).otherwise("")
    text = F.concat(F.lit("RACE "), (k % 12).cast("string"), F.lit(" x\nGoing :  "), F.col("p_type"), F.lit(" \nCourse: "), F.col("p_brand"), F.lit("\n"), d, F.lit("\n"), F.when(k % 2 == 0, F.concat(F.lit("Class "), n.cast("string"))).otherwise("Griffin"), F.lit("\nHK$ "), k.cast("string"))
    return table(spark, sf, "part").select(k.alias("k"), S.header_fields(text).alias("x")).select("k", "x.*")


@query(r"""SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS h1, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang FROM pages""")
def p27_page_header(spark, sf):
    get = lambda p: F.trim(F.regexp_extract("html", p, 1))
    return table(spark, sf, "pages").select("page_id", get("<title>([^<]*)</title>").alias("title"), get("<h1>([^<]*)</h1>").alias("h1"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))


@query("SELECT pool, count(*) AS n FROM (SELECT CASE WHEN upper(p_type) LIKE '%STANDARD%' THEN 'STANDARD' WHEN upper(p_type) LIKE '%PROMO%' THEN 'PROMO' WHEN upper(p_type) LIKE '%STEEL%' THEN 'STEEL' WHEN upper(p_type) LIKE '%TIN%' THEN 'TIN' END AS pool FROM part) GROUP BY pool")
def p28_match_pool(spark, sf):
    return table(spark, sf, "part").groupBy(S.match_pool(F.col("p_type"), ["TIN", "STEEL", "PROMO", "STANDARD"]).alias("pool")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS amount, CAST(o_orderkey % 8 = 0 AS INTEGER) AS is_refund FROM orders")
def p29_money(spark, sf):
    x = F.when(F.col("o_orderkey") % 8 == 0, "Refund").otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), S.money(x).alias("m")).select("k", F.round("m.amount", 2).alias("amount"), "m.is_refund")


@query("SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0 AND len(string_split(text, ' ')) >= 3")
def p30_incident_rows(spark, sf):
    first = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("1"), F.col("turn").cast("string"))).otherwise("WV")
    c = table(spark, sf, "conversations").withColumn("cells", F.concat(F.array(first), F.split("text", " ")))
    return S.incident_rows(c).select("conv_id", "turn")


@query("SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def p31_drop_overseas(spark, sf):
    url = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/Overseas/x"))).otherwise(F.col("url"))
    return S.drop_overseas(table(spark, sf, "pages").select("page_id", url.alias("url"))).select("page_id")


@query("SELECT d, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS DATE) AS d) c LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS od, count(*) AS n FROM orders GROUP BY 1) ON od = d WHERE dayofweek(d) IN (0, 3, 6)")
def p32_calendar(spark, sf):
    have = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count("*").alias("n"))
    first, last = have.agg(F.min("d"), F.max("d")).first()
    return S.calendar(spark, str(first), str(last)).join(have, "d", "left").select("d", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("SELECT 'price' AS feature, sum(price) IS NOT NULL AS used FROM (SELECT max(l_extendedprice) AS price FROM lineitem) UNION ALL SELECT * FROM (VALUES ('weight', true), ('discount', true), ('distance', true), ('odds', true)) t(feature, used)")
def p33_numeric_features(spark, sf):
    e = entries(spark, sf)
    names = S.numeric_features(e, ("contest", "participant", "handler", "position", "payout"))
    return e.agg(*[F.max(c).alias(c) for c in names]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).isNotNull().alias("used")) for c in names])).alias("x")).select("x.*")


@query(with_entries("SELECT count(*) AS n, max(d) AS last FROM E WHERE d <= DATE '1999-08-31'"))
def p34_holdout_guard(spark, sf):
    return S.holdout_guard(entries(spark, sf), "1999-08-31").agg(F.count("*").alias("n"), F.max("d").alias("last"))
