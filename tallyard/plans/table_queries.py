"""Queries of sources, sinks, joins, aggregations, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyard.functions import scalars as S
from tallyard.operators import buckets
from tallyard.operators import relational as R
from tallyard.plans.analogue import entries, table, with_entries
from tallyard.registry import query
from tallyard.sources import storage as T

_ORDERS_TEXT = "SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderpriority AS p, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS s FROM orders"


def _csv(spark, sf, header_numbers: bool = True):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderpriority").alias("p"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("s"))
    path = T.workspace(spark, "csv")
    T.write_csv(o.toDF("0", "1", "2") if header_numbers else o, path)
    return path


@query(_ORDERS_TEXT)
def s1_read_positional_csv(spark, sf):
    return T.read_positional_csv(spark, _csv(spark, sf), ["k", "p", "s"]).drop("source")


@query(_ORDERS_TEXT.replace("THEN ''", "THEN NULL"))
def s2_read_headed_csv(spark, sf):
    return T.read_headed_csv(spark, _csv(spark, sf, False))


@query(f"SELECT k AS a, p AS b, s AS extra_col_0 FROM ({_ORDERS_TEXT})")
def s3_read_csv_wide(spark, sf):
    return T.read_csv_wide(spark, _csv(spark, sf), ["a", "b"], 3).drop("source")


@query("SELECT CAST(s_nationkey AS INTEGER) AS number, strftime(min(o), '%Y-%m-%d') AS date FROM (SELECT c_nationkey AS s_nationkey, CAST(o_orderdate AS DATE) AS o FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY 1")
def s4_file_key_map(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    named = o.select(F.concat(F.lit("file:/x/metadata"), F.col("c_nationkey").cast("string"), F.lit(".csv")).alias("source"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return T.file_key_map(named)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def s5_read_sql(spark, sf):
    return T.read_sql(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query(with_entries("SELECT contest, participant, position FROM E WHERE contest = (SELECT min(contest) FROM E)"))
def s6_entries_of(spark, sf):
    e = entries(spark, sf).select("contest", "participant", "position")
    first = table(spark, sf, "lineitem").agg(F.min("l_orderkey")).first()[0]
    return T.entries_of(e, first)


@query(with_entries("SELECT season, count(*) AS n, count(DISTINCT contest) AS contests FROM E GROUP BY season"))
def s7_write_table(spark, sf):
    path = T.workspace(spark, "table")
    T.write_table(entries(spark, sf), path, ["contest", "participant"], ["season"])
    return spark.read.parquet(path).groupBy(F.col("season").cast("string").alias("season")).agg(F.count("*").alias("n"), F.count_distinct("contest").alias("contests"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def s8_assert_unique(spark, sf):
    return T.assert_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(_ORDERS_TEXT.replace("THEN ''", "THEN NULL"))
def s9_write_csv(spark, sf):
    return spark.read.schema("k string, p string, s string").option("header", True).csv(_csv(spark, sf, False))


@query(with_entries("SELECT contest, participant, position FROM E WHERE d <= DATE '1999-08-31'"))
def s10_materialise_features(spark, sf):
    path = T.workspace(spark, "features")
    e = entries(spark, sf)
    T.materialise_features(e, path, "1999-08-31")
    return T.materialise_features(e, path, "1999-08-31").select("contest", "participant", "position")


@query("SELECT o_orderstatus AS reason, count(*) AS n FROM orders GROUP BY 1")
def s11_read_lines(spark, sf):
    path = T.workspace(spark, "failures")
    table(spark, sf, "orders").select(F.concat_ws("\t", F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("u"), "o_orderstatus")).write.text(path)
    return R.counts(T.read_lines(spark, path, ["d", "url", "reason"]), "reason")


@query("SELECT 'orders' AS \"table\", c AS \"column\" FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority')) t(c)")
def s13_list_columns(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("tallyard_orders")
    out = T.list_columns(spark).where(F.col("table") == "tallyard_orders")
    return out.select(F.lit("orders").alias("table"), "column")


_TABLES = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "pages": ["page_id", "url", "html"], "labels": ["doc_id", "quality", "toxic"], "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {k} AS position, count(*) AS n_rows, count({c}) AS n_values FROM {t}" for t, cs in _TABLES.items() for k, c in enumerate(cs, 1)))
def s13_catalogue(spark, sf):
    """Columns of six tables with their rows and values."""
    return T.catalogue({t: table(spark, sf, t) for t in _TABLES}).drop("type")


@query("WITH M AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1), K AS (SELECT d, n, row_number() OVER (ORDER BY d) AS number FROM M WHERE d < DATE '1999-01-01'), N AS (SELECT d, n, (SELECT max(number) FROM K) + row_number() OVER (ORDER BY d) AS number FROM M WHERE d >= DATE '1999-01-01' AND n >= 20) SELECT number, d, n FROM K UNION ALL SELECT number, d, n FROM N")
def s14_append_meetings(spark, sf):
    """Months as meetings: those of the first years are there, the others come later and are numbered on."""
    path = T.workspace(spark, "meetings")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("contest"), F.trunc("o_orderdate", "month").alias("d"))
    old = o.where("d < DATE '1999-01-01'")
    days = old.select("d").distinct()
    old.join(days.withColumn("number", F.row_number().over(Window.orderBy("d"))), "d").repartition("number").write.partitionBy("number").parquet(path)  # a row a month
    T.append_meetings(o.where("d >= DATE '1998-12-01'"), path, "d", min_contests=20)
    return spark.read.parquet(path).groupBy(F.col("number").cast("long").alias("number"), "d").agg(F.count("*").alias("n"))


@query(with_entries("SELECT season, count(*) AS n, round(sum(CASE WHEN season = '1995/1996' THEN price * 2 ELSE price END), 2) AS total FROM E GROUP BY season"))
def s14_replace_partition(spark, sf):
    path = T.workspace(spark, "seasons")
    e = entries(spark, sf).select("contest", "participant", "price", "season")
    e.write.partitionBy("season").parquet(path)
    T.replace_partition(e.where("season = '1995/1996'").withColumn("price", F.col("price") * 2), path, "season")
    few = e.where("season = '1996/1997'")
    T.replace_partition(few.where(F.col("contest") == few.agg(F.min("contest")).first()[0]), path, "season")  # one contest: refused
    return spark.read.parquet(path).groupBy(F.col("season").cast("string").alias("season")).agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


# ---- joins


@query(with_entries("SELECT E.contest, participant, p_size FROM E LEFT JOIN (SELECT * FROM part WHERE p_size % 2 = 0) ON p_partkey = participant"))
def j1_attach(spark, sf):
    p = table(spark, sf, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("participant"), "p_size")
    return R.attach(entries(spark, sf), p, ["participant"]).select("contest", "participant", "p_size")


@query("SELECT DISTINCT l_orderkey AS contest, l_partkey AS participant FROM lineitem WHERE l_quantity > 25")
def j2_join_odds(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("contest"), F.col("l_partkey").alias("participant"), "l_quantity")
    return R.join_odds(entries(spark, sf).select("contest", "participant"), x.where("l_quantity > 25").drop("l_quantity"), ["contest", "participant"])


@query(with_entries("SELECT E.contest, participant, pay FROM E JOIN (SELECT o_orderkey, o_totalprice AS pay FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = contest"))
def j3_join_payouts(spark, sf):
    p = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("contest"), F.col("o_totalprice").alias("pay"))
    return R.join_payouts(entries(spark, sf), p, ["contest"], "pay").select("contest", "participant", "pay")


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def j4_lookup(spark, sf):
    dim = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return R.lookup(table(spark, sf, "customer"), dim, "c_nationkey").select("c_custkey", "n_name")


@query("SELECT o_orderkey AS contest FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j5_orphans(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("contest"))
    return R.orphans(o, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("contest")), "contest")


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT')")
def j6_pending(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"), "o_orderpriority")
    return R.pending(o.select("d").distinct(), o.where("o_orderpriority = '1-URGENT'"), "d")


@query(with_entries("SELECT a.contest, a.participant AS participant_a, b.participant AS participant_b, a.position AS position_a, b.position AS position_b FROM E a JOIN E b ON a.contest = b.contest AND a.participant <> b.participant"))
def j7_pairs(spark, sf):
    return R.pairs(entries(spark, sf), ["participant", "position"]).select("contest", "participant_a", "participant_b", "position_a", "position_b")


@query(with_entries("SELECT a.contest, a.participant AS participant_1, b.participant AS participant_2, c.participant AS participant_3 FROM E a JOIN E b ON a.contest = b.contest AND b.position > a.position JOIN E c ON c.contest = a.contest AND c.position > b.position WHERE a.position <= 5 AND b.position <= 5 AND c.position <= 5"))
def j8_combos(spark, sf):
    return R.combos(entries(spark, sf).where("position <= 5"), 3, ["participant"], "position")


@query(with_entries("SELECT a.contest, a.participant AS participant_1, b.participant AS participant_2, c.participant AS participant_3 FROM E a JOIN E b ON a.contest = b.contest AND b.position > 1 JOIN E c ON c.contest = a.contest AND c.position > b.position WHERE a.position = 1 AND b.position <= 5 AND c.position <= 5"))
def j8_anchored_combos(spark, sf):
    e = entries(spark, sf).where("position <= 5").withColumn("anchor", (F.col("position") == 1).cast("int"))
    return R.combos(e, 3, ["participant"], "position", anchor="anchor")


@query(with_entries("SELECT a.contest, a.participant AS participant_1, b.participant AS participant_2 FROM E a JOIN E b ON a.contest = b.contest AND b.position <> a.position WHERE a.position <= 4 AND b.position <= 4"))
def j8_ordered_combos(spark, sf):
    return R.combos(entries(spark, sf).where("position <= 4"), 2, ["participant"], "position", ordered=True)


def folds(spark, lookback: int = 2, first: int = 1996, last: int = 2000):
    """season, train_start, train_end, test_start, test_end: test seasons, each trained on those before it."""
    y = F.col("id").cast("int")
    day = lambda y, m, n: F.make_date(y, F.lit(m), F.lit(n))
    return spark.range(first, last + 1).select(
        F.concat(y.cast("string"), F.lit("/"), (y + 1).cast("string")).alias("fold"), day(y - lookback, 9, 1).alias("train_start"), day(y, 8, 31).alias("train_end"), day(y, 9, 1).alias("test_start"), day(y + 1, 8, 31).alias("test_end")
    )


FOLDS = "FOLDS AS (SELECT CAST(y AS VARCHAR) || '/' || CAST(y + 1 AS VARCHAR) AS fold, make_date(y - 2, 9, 1) AS train_start, make_date(y, 8, 31) AS train_end, make_date(y, 9, 1) AS test_start, make_date(y + 1, 8, 31) AS test_end FROM range(1996, 2001) t(y))"


@query(with_entries("SELECT fold, CASE WHEN d <= train_end THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM E JOIN FOLDS ON d BETWEEN train_start AND test_end GROUP BY 1, 2", FOLDS))
def j9_assign_folds(spark, sf):
    return R.counts(R.assign_folds(entries(spark, sf), folds(spark)), "fold", "part")


_PAY = "PAY AS (SELECT contest, list_sort(list(participant)) AS combo, max(payout) AS dividend FROM E WHERE position <= 3 GROUP BY contest HAVING count(*) = 3)"


@query(with_entries("SELECT b.contest, CAST(p.combo IS NOT NULL AS INTEGER) AS won, round(coalesce(10.0 / 10 * dividend, 0), 4) AS returned FROM (SELECT contest, list_sort(list(participant)) AS combo FROM (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY odds, participant) AS rk FROM E) WHERE rk <= 3 GROUP BY contest HAVING count(*) = 3) b LEFT JOIN PAY p ON p.contest = b.contest AND p.combo = b.combo", _PAY))
def j10_settle_bets(spark, sf):
    e = entries(spark, sf)
    three = lambda df: df.groupBy("contest").agg(F.array_sort(F.collect_list("participant")).alias("combo"), F.max("payout").alias("dividend"), F.count("*").alias("n")).where("n = 3").drop("n")
    bets = three(R.top_n(e, ["contest"], [F.col("odds"), F.col("participant")], 3)).drop("dividend").withColumn("stake", F.lit(10.0))
    return R.settle_bets(bets, three(e.where("position <= 3"))).select("contest", "won", F.round("returned", 4).alias("returned"))


@query(with_entries("SELECT e.contest, e.participant, coalesce((SELECT max_by(h.w, h.d) FROM (SELECT participant, d, max(price) AS w FROM E GROUP BY 1, 2) h WHERE h.participant = e.participant AND h.d < e.d), 0) AS last_price FROM E e"))
def j11_as_of(spark, sf):
    e = entries(spark, sf)
    history = e.groupBy("participant", F.col("d").alias("valid_from")).agg(F.max("price").alias("last_price"))
    return R.as_of(e, history, "participant", "last_price", 0.0).select("contest", "participant", "last_price")


@query(with_entries("SELECT e.contest, e.participant, coalesce((SELECT max_by(h.w, h.d) FROM (SELECT handler, d, max(price) AS w FROM E GROUP BY 1, 2) h WHERE h.handler = e.handler AND h.d < e.d), 0) AS last_price FROM E e"))
def j11_as_of_buckets(spark, sf):
    """j11 for keys that hold a large share of all rows."""
    e = entries(spark, sf)
    history = e.groupBy("handler", F.col("d").alias("valid_from")).agg(F.max("price").alias("last_price"))
    return buckets.as_of(e, history, "handler", "last_price", 0.0).select("contest", "participant", "last_price")


# ---- aggregations


@query("SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def a1_dedupe(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return R.dedupe(x, ["l_orderkey", "l_linenumber"], [F.col("l_partkey")], "last")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def a2_counts(spark, sf):
    return R.counts(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query("SELECT count(DISTINCT (l_orderkey, l_partkey)) AS n FROM lineitem")
def a3_distinct_count(spark, sf):
    return R.distinct_count(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query("""WITH P AS (SELECT l_orderkey AS contest, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1), M AS (SELECT o_orderkey AS contest, CAST(o_orderdate AS DATE) AS d, coalesce(n, 0) AS n FROM orders LEFT JOIN P ON P.contest = o_orderkey)
SELECT contest, CAST(n > 0 AND sum(n) OVER (PARTITION BY d) > 0 AS INTEGER) AS is_bettable FROM M""")
def a4_bettable_flag(spark, sf):
    meta = table(spark, sf, "orders").select(F.col("o_orderkey").alias("contest"), F.col("o_orderdate").cast("date").alias("d"))
    pay = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("contest"))
    return R.bettable_flag(meta, pay).select("contest", "is_bettable")


@query("SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 3 = 0) AS missing_k, count(*) FILTER (o_custkey % 5 = 0) AS missing_c FROM orders")
def a5_null_audit(spark, sf):
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("k"), F.when(F.col("o_custkey") % 5 == 0, F.lit(float("nan"))).otherwise(1.0).alias("c"))
    return R.null_audit(o, ["k", "c"])


@query(with_entries("SELECT round(avg(distance), 2) AS mean, round(CAST(max(distance) AS DOUBLE), 2) AS high, round(CAST(min(distance) AS DOUBLE), 2) AS low, min(d) AS first, max(d) AS last FROM E"))
def a6_summary(spark, sf):
    return R.summary(entries(spark, sf).withColumn("distance", F.col("distance").cast("double")), "distance", "d")


@query(with_entries("SELECT participant, max(price) AS peak, max_by(handler, (price, handler)) AS handler FROM E GROUP BY participant ORDER BY peak DESC, participant LIMIT 5"))
def a7_top_peak(spark, sf):
    return R.top_peak(entries(spark, sf), "participant", "price", "handler", 5)


@query(with_entries("SELECT season, count(*) AS n, count(DISTINCT contest) AS contests FROM E GROUP BY season"))
def a8_season_counts(spark, sf):
    return R.season_counts(entries(spark, sf))


@query("""WITH X AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey % 10 AS no FROM orders), H AS (SELECT d, count(DISTINCT no) AS n, max(no) AS highest FROM X GROUP BY d),
C AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM X), (SELECT max(d) FROM X), INTERVAL 1 DAY)) AS DATE) AS d)
SELECT C.d, coalesce(n, 0) AS n, coalesce(highest, 0) AS highest, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n < highest THEN 'gaps' ELSE 'complete' END AS state FROM C LEFT JOIN H ON H.d = C.d WHERE dayofweek(C.d) IN (0, 3, 6)""")
def a21_completeness_audit(spark, sf):
    x = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"), (F.col("o_orderkey") % 10).alias("contest_no"))
    first, last = x.agg(F.min("d"), F.max("d")).first()
    return R.completeness_audit(S.calendar(spark, str(first), str(last)), x)


@query(with_entries("SELECT CAST(avg((discount * 10 - y) * (discount * 10 - y)) AS DECIMAL(18, 8))::DOUBLE AS brier, round(-avg(y * ln(least(greatest(discount * 10, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(discount * 10, 1e-15), 1 - 1e-15))), 6) AS log_loss FROM (SELECT discount, CAST(position = 1 AS INTEGER) AS y FROM E)"))
def a18_losses(spark, sf):
    e = S.targets(entries(spark, sf))
    p, y = F.col("discount") * 10, F.col("is_win")
    return e.agg(F.round(R.brier(p, y), 8).alias("brier"), F.round(R.log_loss(p, y), 6).alias("log_loss"))


# ---- order, top-k, sets


@query(with_entries("SELECT contest, participant, row_number() OVER (ORDER BY d, contest, position) AS n FROM E"))
def k1_chronological(spark, sf):
    from pyspark.sql import Window

    e = entries(spark, sf)
    # The only window over everything sees one row a day; contests are numbered within their days.
    sizes = e.groupBy("d", "contest").agg(F.count("*").alias("size"))
    w = Window.partitionBy("d").orderBy("contest").rowsBetween(Window.unboundedPreceding, -1)
    days = sizes.groupBy("d").agg(F.sum("size").alias("day_size"))
    days = days.select("d", F.coalesce(F.sum("day_size").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("day_before"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0))).join(days, "d")
    return e.join(sizes.select("contest", "before", "day_before"), "contest").select("contest", "participant", (F.col("day_before") + F.col("before") + F.col("position")).alias("n"))


@query(with_entries("SELECT contest, participant, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY discount DESC, participant) AS rn FROM E) WHERE rn <= 3"))
def k2_top_n(spark, sf):
    return R.top_n(entries(spark, sf), ["contest"], [F.desc("discount"), F.col("participant")], 3).select("contest", "participant", "rn")


@query(with_entries("SELECT contest, participant, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY odds, participant) AS rn FROM E) WHERE rn <= 2"))
def k3_bottom_n(spark, sf):
    return R.bottom_n(entries(spark, sf), ["contest"], "odds", 2).select("contest", "participant", "rn")


@query(with_entries("SELECT contest, max_by(participant, (discount * odds, -participant)) AS participant FROM E GROUP BY contest"))
def k4_arg_max(spark, sf):
    return R.arg_max(entries(spark, sf), ["contest"], [F.col("discount") * F.col("odds"), -F.col("participant")]).select("contest", "participant")


@query(with_entries("SELECT participant, round(sum(price), 2) AS total FROM E GROUP BY participant ORDER BY total DESC, participant LIMIT 25"))
def k5_global_top(spark, sf):
    return entries(spark, sf).groupBy("participant").agg(F.round(F.sum("price"), 2).alias("total")).orderBy(F.desc("total"), "participant").limit(25)


@query("SELECT o_orderkey AS k, o_custkey AS c, NULL AS p FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1")
def u1_union_ragged(spark, sf):
    o = table(spark, sf, "orders")
    return R.union_ragged([o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")), o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))])


_SETS = with_entries("SELECT contest, CAST(len(list_intersect(a, b)) AS INTEGER) AS n, list_sort(a) = list_sort(b) AS same, len(list_intersect(a, c)) = len(c) AS covered FROM (SELECT contest, list(participant) FILTER (position <= 3) AS a, list(participant) FILTER (rk <= 3) AS b, list(participant) FILTER (rk <= 2) AS c FROM (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY odds, participant) AS rk FROM E) GROUP BY contest)")


@query(_SETS)
def u2_u3_sets(spark, sf):
    from pyspark.sql import Window

    e = entries(spark, sf).withColumn("rk", F.row_number().over(Window.partitionBy("contest").orderBy("odds", "participant")))
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("participant"))))
    g = e.groupBy("contest").agg(pick(F.col("position") <= 3).alias("a"), pick(F.col("rk") <= 3).alias("b"), pick(F.col("rk") <= 2).alias("c"))
    return g.select("contest", R.overlap(F.col("a"), F.col("b")).alias("n"), (F.col("a") == F.col("b")).alias("same"), R.covers(F.col("a"), F.col("c")).alias("covered"))
