"""Queries of history and field windows, ratings, graph and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyard.operators import buckets as B
from tallyard.operators import history as H
from tallyard.operators import ratings as R
from tallyard.plans.analogue import FULL_ENTRIES, entries, full_entries, table, with_entries
from tallyard.registry import query
from tallyard.sources.storage import settle

_P = "PARTITION BY participant ORDER BY d, contest, participant"
_HD = "PARTITION BY handler ORDER BY d, contest, participant"


@query(with_entries(f"SELECT contest, participant, coalesce(weight - lag(weight) OVER ({_P}), 0) AS weight_delta, coalesce(distance - lag(distance) OVER ({_P}), 0) AS distance_delta FROM E"))
def w1_lag_deltas(spark, sf):
    return H.lag_deltas(entries(spark, sf)).select("contest", "participant", "weight_delta", "distance_delta")


@query(with_entries(f"SELECT contest, participant, CAST(coalesce(d - lag(d) OVER ({_P}), 30) AS INTEGER) AS days_since_last FROM E"))
def w2_days_since(spark, sf):
    return H.days_since(entries(spark, sf)).select("contest", "participant", "days_since_last")


@query(with_entries(f"SELECT contest, participant, CAST(coalesce(sum(CAST(position = 1 AS INTEGER)) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_wins FROM E"))
def w3_prior_wins(spark, sf):
    return H.prior_wins(entries(spark, sf)).select("contest", "participant", "prior_wins")


@query(with_entries(f"SELECT contest, participant, round(coalesce(avg(CAST(position = 1 AS DOUBLE)) OVER ({_HD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.08), 6) AS rate FROM E"))
def w4_prior_rate(spark, sf):
    return H.prior_rate(entries(spark, sf)).select("contest", "participant", F.round("handler_prior_rate", 6).alias("rate"))


@query(with_entries(f"SELECT contest, participant, round(avg(discount) OVER ({_P} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS form FROM E"))
def w5_rolling_form(spark, sf):
    return H.rolling_mean(entries(spark, sf), "participant", "discount", 5, "form").select("contest", "participant", F.round("form", 6).alias("form"))


_RATE = f"coalesce(avg(CAST(position = 1 AS DOUBLE)) OVER ({_HD} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0.083)"
_STRICT = f"RT AS (SELECT *, first_value(r0) OVER (PARTITION BY handler, d, contest ORDER BY participant) AS handler_rate FROM (SELECT *, {_RATE} AS r0 FROM E))"


@query(with_entries(f"SELECT contest, participant, round({_RATE}, 6) AS rate FROM E"))
def w6_handler_rate_by_row(spark, sf):
    return H.handler_rate(entries(spark, sf), strict=False).select("contest", "participant", F.round("handler_rate", 6).alias("rate"))


@query(with_entries("SELECT contest, participant, round(handler_rate, 6) AS rate FROM RT", _STRICT))
def w7_handler_rate_strict(spark, sf):
    return H.handler_rate(entries(spark, sf)).select("contest", "participant", F.round("handler_rate", 6).alias("rate"))


@query(with_entries("SELECT contest, participant, round(handler_rate, 6) AS rate FROM RT", _STRICT))
def w7_handler_rate_buckets(spark, sf):
    """w7 for handlers that hold a large share of all rows."""
    return B.handler_rate(entries(spark, sf)).select("contest", "participant", F.round("handler_rate", 6).alias("rate"))


_SO_FAR = f"({_HD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(with_entries(f"SELECT contest, participant, round(coalesce(avg(CAST(position = 1 AS DOUBLE)) OVER {_SO_FAR}, 0.08), 6) AS rate, count(*) OVER {_SO_FAR} AS n_before, CAST(coalesce(sum(CAST(position = 1 AS INTEGER)) OVER {_SO_FAR}, 0) AS BIGINT) AS prior_wins FROM E"))
def w4_prior_rate_buckets(spark, sf):
    """w3, w4 and w16 of handlers in the same way."""
    return B.prior_rate(entries(spark, sf)).select("contest", "participant", F.round("handler_prior_rate", 6).alias("rate"), "n_before", "prior_wins")


@query(with_entries("SELECT contest, participant, round(p, 4) AS pressure, round(price - p, 4) AS advantage FROM (SELECT *, sum(CASE WHEN rn <= 3 THEN price END) OVER (PARTITION BY contest) AS p FROM (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY price DESC, participant) AS rn FROM E))"))
def w8_pressure(spark, sf):
    return H.pressure(entries(spark, sf), "price").select("contest", "participant", F.round("pressure", 4).alias("pressure"), F.round("advantage", 4).alias("advantage"))


@query(with_entries("SELECT contest, participant, CAST(dense_rank() OVER w AS INTEGER) AS dense, CAST(rank() OVER w AS INTEGER) AS min, CAST(row_number() OVER (PARTITION BY contest ORDER BY discount DESC, participant) AS INTEGER) AS first FROM E WINDOW w AS (PARTITION BY contest ORDER BY discount DESC)"))
def w9_model_rank(spark, sf):
    e = entries(spark, sf)
    for m in ("first", "dense", "min"):  # the first one's sort serves all
        e = H.rank_in_contest(e, "discount", m, True, m)
    return e.select("contest", "participant", "dense", "min", "first")


@query(with_entries("SELECT contest, participant, CAST(rank() OVER (PARTITION BY contest ORDER BY odds) AS INTEGER) AS public_rank FROM E"))
def w10_public_rank(spark, sf):
    return H.public_rank(entries(spark, sf)).select("contest", "participant", "public_rank")


@query(with_entries("SELECT contest, participant, round(x / sum(x) OVER (PARTITION BY contest), 6) AS p FROM (SELECT *, exp(discount * 20 - max(discount * 20) OVER (PARTITION BY contest)) AS x FROM E)"))
def w11_softmax(spark, sf):
    return H.softmax(entries(spark, sf).withColumn("z", F.col("discount") * 20), "z", "p").select("contest", "participant", F.round("p", 6).alias("p"))


@query(with_entries("SELECT contest, participant, round(1 / odds / sum(1 / odds) OVER (PARTITION BY contest), 9) AS share FROM E"))
def w12_share(spark, sf):
    return H.share(entries(spark, sf), 1 / F.col("odds")).select("contest", "participant", F.round("share", 9).alias("share"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN coalesce(CASE WHEN turn % 3 <> 0 THEN turn END, -1) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS raw FROM conversations")
def w15_carry_down_raw(spark, sf):
    c = table(spark, sf, "conversations")
    value = F.when(F.col("turn") % 3 != 0, F.col("turn")).otherwise(-1)
    return H.carry_down(c, "conv_id", "turn", F.col("role") == "user", value, "raw").select("conv_id", "turn", "raw")


@query("SELECT conv_id, turn, nullif(last_value(CASE WHEN role = 'user' THEN CASE WHEN turn % 3 <> 0 THEN turn ELSE -1 END END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS pool FROM conversations")
def w15_carry_down(spark, sf):
    c = table(spark, sf, "conversations")
    return H.carry_down(c, "conv_id", "turn", F.col("role") == "user", F.when(F.col("turn") % 3 != 0, F.col("turn")), "pool").select("conv_id", "turn", "pool")


@query(with_entries(f"SELECT contest, participant, CAST(row_number() OVER ({_P}) - 1 AS INTEGER) AS n_before FROM E"))
def w16_counter(spark, sf):
    return H.counter(entries(spark, sf), "participant").select("contest", "participant", "n_before")


@query(with_entries("SELECT contest, participant, n AS field FROM (SELECT *, count(*) OVER (PARTITION BY contest) AS n FROM E) WHERE n >= 7"))
def p25_min_field(spark, sf):
    return H.min_field(entries(spark, sf), 7).select("contest", "participant", "field")


# ---- ratings: each period is spelt out in the SQL

YEARS = range(1995, 2002)
MONTHS = [100 * y + m for y in YEARS for m in range(1, 13)]


def _fold_sql(name: str, change: str, update: str, cols: str, out: str, periods=YEARS, period: str = "year(d)", position: str = "coalesce(position, 99)") -> tuple[str, str]:
    """cols: state columns after participant; change: sums by pa over pairs joined with both states; position: nulls take no part."""
    names, n = [c.split(" AS ")[1] for c in cols.split(", ")], name
    parts = [f"{n}E AS MATERIALIZED (SELECT {period} AS period, contest, participant, margin, {position} AS pos, count(*) OVER (PARTITION BY contest) AS n FROM FE WHERE {position} IS NOT NULL)"]
    parts.append(f"{n}P AS MATERIALIZED (SELECT a.period, a.n, a.participant AS pa, b.participant AS pb, a.pos AS posa, b.pos AS posb, a.margin AS ma, b.margin AS mb FROM {n}E a JOIN {n}E b ON a.contest = b.contest AND a.participant <> b.participant)")
    parts.append(f"{n}A AS MATERIALIZED (SELECT DISTINCT period, participant FROM {n}E)")
    parts.append(f"{n}S0 AS MATERIALIZED (SELECT participant, {cols} FROM (SELECT DISTINCT participant FROM {n}A))")
    for k, p in enumerate(periods):
        both = f"{n}P p JOIN {n}S{k} A ON A.participant = p.pa JOIN {n}S{k} B ON B.participant = p.pb WHERE p.period = {p}"
        parts.append(f"{n}D{k} AS MATERIALIZED (SELECT pa AS participant, {change} FROM {both} GROUP BY pa)")
        keep = ", ".join(f"CASE WHEN D.participant IS NULL THEN S.{c} ELSE {u} END AS {c}" for c, u in zip(names, update.split("; "), strict=True))
        parts.append(f"{n}S{k + 1} AS MATERIALIZED (SELECT S.participant, {keep} FROM {n}S{k} S LEFT JOIN {n}D{k} D ON D.participant = S.participant)")
    union = " UNION ALL ".join(f"SELECT {p}::BIGINT AS period, S.participant, {out} FROM {n}A A JOIN {n}S{k} S ON S.participant = A.participant JOIN {n}S{k + 1} N ON N.participant = A.participant WHERE A.period = {p}" for k, p in enumerate(periods))
    return f"{FULL_ENTRIES}, " + ", ".join(parts), union


_WON = "CASE WHEN posa < posb THEN 1.0::DOUBLE WHEN posa > posb THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END"
_EXP = "1 / (1 + pow(10.0::DOUBLE, (B.rating - A.rating) / 400))"
_ELO_OUT = "round(S.rating, 2) AS pre, round(N.rating, 2) AS post, round(N.rating - S.rating, 2) + 0.0::DOUBLE AS shift"
_ELO = (f"sum(20.0::DOUBLE * (1 + ln(abs(ma - mb) + 1)) * ({_WON} - {_EXP}) / (n - 1)) AS s", "S.rating + D.s", "1500.0::DOUBLE AS rating")
_R1 = _fold_sql("U", f"sum(32.0::DOUBLE * ({_WON} - {_EXP}) / (n - 1)) AS s", "S.rating + D.s", "1500.0::DOUBLE AS rating", _ELO_OUT, position="position")
_R2 = _fold_sql("M", *_ELO, _ELO_OUT, periods=MONTHS, period="(year(d) * 100 + month(d))")
_G = "(1 / sqrt(1 + 3 * pow(B.rd / 173.7178::DOUBLE, 2) / pow(pi(), 2)))"
_GE = f"(1 / (1 + exp(-{_G} * ((A.rating - 1500) / 173.7178::DOUBLE - (B.rating - 1500) / 173.7178::DOUBLE))))"
_NEW2 = "(1 / (1 / (pow(S.rd / 173.7178::DOUBLE, 2) + pow(S.vol, 2)) + 1 / (CASE WHEN D.v_inv > 0 THEN 1 / D.v_inv ELSE 1.0 END)))"
_GLICKO = (f"sum({_G} * {_G} * {_GE} * (1 - {_GE})) AS v_inv, sum({_G} * ({_WON} - {_GE})) AS delta", f"S.rating + 173.7178::DOUBLE * {_NEW2} * D.delta; sqrt({_NEW2}) * 173.7178::DOUBLE; S.vol", "1500.0::DOUBLE AS rating, 350.0::DOUBLE AS rd, 0.06::DOUBLE AS vol")
_R3 = _fold_sql("G", *_GLICKO, "round(S.rating, 2) AS pre, round(N.rating, 2) AS post, round(N.rd, 2) AS rd")


def _shown(h):
    return h.select(F.col("period").cast("long").alias("period"), "participant", F.round("rating", 2).alias("pre"), F.round("rating_after", 2).alias("post"), (F.round(F.col("rating_after") - F.col("rating"), 2) + 0.0).alias("shift"))


@query(with_entries(f"SELECT * FROM ({_R1[1]})", _R1[0]))
def r1_pairwise_elo(spark, sf):
    return _shown(R.pairwise_elo(full_entries(spark, sf), F.year("d")))


@query(with_entries(f"SELECT * FROM ({_R2[1]})", _R2[0]))
def r2_margin_elo(spark, sf):
    """By months."""
    return _shown(R.margin_elo(full_entries(spark, sf), F.year("d") * 100 + F.month("d")))


@query(with_entries(f"SELECT * FROM ({_R3[1]})", _R3[0]))
def r3_glicko(spark, sf):
    h = R.glicko(full_entries(spark, sf), F.year("d"))
    return h.select(F.col("period").cast("long").alias("period"), "participant", F.round("rating", 2).alias("pre"), F.round("rating_after", 2).alias("post"), F.round("rd_after", 2).alias("rd"))


_BOTH = "(1 + ln(abs(ma - mb) + 1))"
_LEVELED = f"""{FULL_ENTRIES},
ED AS MATERIALIZED (SELECT DISTINCT contest, before FROM (SELECT contest, lag(contest) OVER (PARTITION BY participant ORDER BY d, contest) AS before FROM FE) WHERE before IS NOT NULL),
PATHS AS (SELECT DISTINCT contest, 1 AS k FROM FE UNION ALL SELECT DISTINCT e.contest, k + 1 FROM PATHS JOIN ED e ON e.before = PATHS.contest),
LV AS MATERIALIZED (SELECT contest, max(k) AS level FROM PATHS GROUP BY contest),
EL AS MATERIALIZED (SELECT contest, participant, margin, coalesce(position, 99) AS pos, level, count(*) OVER (PARTITION BY contest) AS n FROM FE JOIN LV USING (contest)),
PR AS MATERIALIZED (SELECT a.level, a.n, a.participant AS pa, b.participant AS pb, a.pos AS posa, b.pos AS posb, a.margin AS ma, b.margin AS mb FROM EL a JOIN EL b ON a.contest = b.contest AND a.participant <> b.participant),
RS AS (SELECT 0 AS k, participant, 1500.0::DOUBLE AS elo, 1500.0::DOUBLE AS margin_elo, 1500.0::DOUBLE AS rating, 350.0::DOUBLE AS rd FROM (SELECT DISTINCT participant FROM EL)
  UNION ALL SELECT S.k + 1, S.participant, S.elo + coalesce(D.e, 0), S.margin_elo + coalesce(D.m, 0), CASE WHEN D.pa IS NULL THEN S.rating ELSE S.rating + 173.7178::DOUBLE * {_NEW2} * D.delta END, CASE WHEN D.pa IS NULL THEN S.rd ELSE sqrt({_NEW2}) * 173.7178::DOUBLE END
  FROM (SELECT *, 0.06::DOUBLE AS vol FROM RS) S LEFT JOIN (SELECT p.pa, sum(32.0::DOUBLE * ({_WON} - 1 / (1 + pow(10.0::DOUBLE, (B.elo - A.elo) / 400))) / (n - 1)) AS e,
      sum(20.0::DOUBLE * {_BOTH} * ({_WON} - 1 / (1 + pow(10.0::DOUBLE, (B.margin_elo - A.margin_elo) / 400))) / (n - 1)) AS m, sum({_G} * {_G} * {_GE} * (1 - {_GE})) AS v_inv, sum({_G} * ({_WON} - {_GE})) AS delta
    FROM PR p JOIN RS A ON A.participant = p.pa AND p.level = A.k + 1 JOIN RS B ON B.participant = p.pb GROUP BY p.pa) D ON D.pa = S.participant WHERE S.k < (SELECT max(level) FROM LV))"""
_SHOWN = ", ".join(f"round(A.{c}, 2) AS {c}_pre, round(B.{c}, 2) AS {c}_post" for c in ("elo", "margin_elo", "rating", "rd"))


@query(with_entries(f"SELECT contest, EL.participant, {_SHOWN} FROM EL JOIN RS A ON A.participant = EL.participant AND A.k = level - 1 JOIN RS B ON B.participant = EL.participant AND B.k = level", _LEVELED).replace("WITH ", "WITH RECURSIVE ", 1))
def r1_r2_r3_by_contest(spark, sf):
    """The three ratings before and after every contest, each contest seeing all earlier ones."""
    h = R.ratings_by_contest(full_entries(spark, sf)).withColumnsRenamed({"glicko": "rating", "glicko_after": "rating_after"})
    shown = [F.round(f"{c}{old}", 2).alias(f"{c}_{new}") for c in ("elo", "margin_elo", "rating", "rd") for old, new in (("", "pre"), ("_after", "post"))]
    return h.select("contest", "participant", *shown)


def _edges_sql(source: str, position: str) -> str:
    return f"""SNAP AS (SELECT DISTINCT CAST(date_trunc('year', d) AS DATE) AS as_of FROM {source}),
EDGES AS MATERIALIZED (SELECT as_of, a.participant AS src, b.participant AS dst, count(*) AS weight FROM {source} a JOIN {source} b ON a.contest = b.contest AND {position.format('a')} > {position.format('b')} JOIN SNAP ON a.d < as_of GROUP BY 1, 2, 3)"""


@query(with_entries("SELECT as_of, src, dst, CAST(weight AS BIGINT) AS weight FROM EDGES", _edges_sql("E", "{}.position")))
def r4_dominance_edges(spark, sf):
    e = entries(spark, sf)
    return R.dominance_edges(e, R.yearly_snapshots(e))


def _pagerank_sql(edges: str, rounds: int = 25) -> str:
    """RANKS: of each snapshot those of the first round after which it has settled."""
    parts = [edges, "NODES AS MATERIALIZED (SELECT as_of, node, count(*) OVER (PARTITION BY as_of) AS n FROM (SELECT as_of, src AS node FROM EDGES UNION SELECT as_of, dst FROM EDGES))",
             "FLOW AS MATERIALIZED (SELECT as_of, src, dst, weight / sum(weight) OVER (PARTITION BY as_of, src) AS part FROM EDGES)", "R0 AS (SELECT as_of, node, n, 1.0::DOUBLE / n AS rank, NULL::DOUBLE AS old FROM NODES)"]
    for k in range(1, rounds + 1):
        parts.append(f"G{k} AS MATERIALIZED (SELECT f.as_of, f.dst AS node, sum(part * rank) AS got FROM FLOW f JOIN R{k - 1} r ON r.as_of = f.as_of AND r.node = f.src GROUP BY 1, 2)")
        parts.append(f"T{k} AS MATERIALIZED (SELECT r.as_of, sum(rank) AS stuck FROM R{k - 1} r WHERE NOT EXISTS (SELECT 1 FROM FLOW f WHERE f.as_of = r.as_of AND f.src = r.node) GROUP BY 1)")
        parts.append(f"R{k} AS MATERIALIZED (SELECT N.as_of, N.node, N.n, 0.15::DOUBLE / N.n + 0.85::DOUBLE * (coalesce(got, 0) + coalesce(stuck, 0) / N.n) AS rank, N.rank AS old FROM R{k - 1} N LEFT JOIN G{k} G ON G.as_of = N.as_of AND G.node = N.node LEFT JOIN T{k} T ON T.as_of = N.as_of)")
    every = " UNION ALL ".join(f"SELECT {k} AS k, * FROM R{k}" for k in range(1, rounds + 1))
    parts.append(f"RALL AS MATERIALIZED ({every}), FIRST AS (SELECT as_of, min(k) AS k FROM (SELECT k, as_of FROM RALL GROUP BY k, as_of HAVING sum(abs(rank - old)) < max(n) * 1e-6) GROUP BY as_of)")
    parts.append("RANKS AS MATERIALIZED (SELECT r.as_of, r.node, r.rank FROM RALL r JOIN FIRST f ON f.as_of = r.as_of AND f.k = r.k)")
    return ", ".join(parts)


@query(with_entries("SELECT as_of, node, round(rank, 8) AS rank FROM RANKS", _pagerank_sql(_edges_sql("E", "{}.position"))))
def r5_pagerank(spark, sf):
    e = settle(entries(spark, sf).select("contest", "participant", "d", "position"), "entries")
    return R.snapshot_pagerank(e, R.yearly_snapshots(e)).select("as_of", "node", F.round("rank", 8).alias("rank"))


_HISTORY = f"""{_STRICT},
FT AS (SELECT *, coalesce(weight - lag(weight) OVER ({_P}), 0) AS weight_delta, coalesce(distance - lag(distance) OVER ({_P}), 0) AS distance_delta, CAST(coalesce(d - lag(d) OVER ({_P}), 30) AS INTEGER) AS days_since_last,
  CAST(coalesce(sum(CAST(position = 1 AS INTEGER)) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_wins, avg(discount) OVER ({_P} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS form FROM RT),
FP AS (SELECT *, coalesce(sum(CASE WHEN rn <= 3 THEN form END) OVER (PARTITION BY contest), 0) AS pressure FROM (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY round(form, 9) DESC NULLS LAST, participant) AS rn FROM FT))"""
_SHOW = ("weight_delta", "distance_delta", "days_since_last", "prior_wins")


@query(with_entries("SELECT contest, participant, weight_delta, distance_delta, days_since_last, prior_wins, round(form, 6) AS form, round(handler_rate, 6) AS handler_rate, round(pressure, 5) AS pressure FROM FP", _HISTORY))
def r6_history_features(spark, sf):
    f = R.history_features(entries(spark, sf))
    return f.select("contest", "participant", *_SHOW, F.round("form", 6).alias("form"), F.round("handler_rate", 6).alias("handler_rate"), F.round("pressure", 5).alias("pressure"))


# ---- the whole feature row

_YEARLY = _fold_sql("Y", *_ELO, "S.rating AS elo")
_DEVIATIONS = _fold_sql("Z", *_GLICKO, "S.rating AS glicko_mu, S.rd AS glicko_rd, S.vol AS glicko_vol")
_STATES = f"{_YEARLY[0]}, {_DEVIATIONS[0].removeprefix(FULL_ENTRIES + ', ')}, {_pagerank_sql(_edges_sql('FE', 'coalesce({}.position, 99)'))}, EL AS ({_YEARLY[1]}), GL AS ({_DEVIATIONS[1]})"


def _rate_sql(key: str) -> str:
    return f"coalesce(avg(coalesce(CAST(position = 1 AS DOUBLE), 0)) OVER (PARTITION BY {key} ORDER BY d, contest, participant ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0.083)"


_PACE = """XF AS (SELECT *, 1 / sqrt(early::DOUBLE) AS esi, (late - place)::DOUBLE AS csi FROM FE),
XP AS (SELECT *, avg(esi) OVER (PARTITION BY participant ORDER BY d, contest, participant ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS rolling_esi, avg(csi) OVER (PARTITION BY participant ORDER BY d, contest, participant ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS rolling_csi FROM XF),
XQ AS (SELECT *, coalesce(sum(CASE WHEN rn <= 3 THEN rolling_esi END) OVER (PARTITION BY contest), 0) AS esi_pressure FROM (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY round(rolling_esi, 9) DESC NULLS LAST, participant) AS rn FROM XP))"""
_ROW = f"""{_STATES}, {_PACE},
XR AS (SELECT *, first_value(h0) OVER (PARTITION BY handler, d, contest ORDER BY participant) AS handler_rate, first_value(s0) OVER (PARTITION BY second_handler, d, contest ORDER BY participant) AS second_handler_rate FROM (SELECT *, {_rate_sql('handler')} AS h0, {_rate_sql('second_handler')} AS s0 FROM XQ))"""
_ROW_SELECT = f"""SELECT x.contest, x.d, x.contest_no, x.participant, x.draw AS number, x.name, x.position, x.handler, x.second_handler, x.odds, x.distance, round(coalesce(elo, 1500), 2) AS elo, round(coalesce(glicko_mu, 1500), 2) AS glicko_mu, round(coalesce(glicko_rd, 350), 2) AS glicko_rd, coalesce(glicko_vol, 0.06) AS glicko_vol,
 round(coalesce(r.rank, 0.001), 8) AS centrality, round(rolling_esi, 6) AS rolling_esi, round(rolling_csi, 6) AS rolling_csi, round(esi_pressure, 5) AS esi_pressure, round(rolling_esi - esi_pressure, 5) AS pace_advantage, round(handler_rate, 6) AS handler_rate, round(second_handler_rate, 6) AS second_handler_rate, x.draw::DOUBLE AS draw,
 CAST(coalesce(x.d - lag(x.d) OVER w, 30) AS INTEGER) AS days_since_last, coalesce(x.weight - lag(x.weight) OVER w, 0) AS weight_delta, coalesce(x.distance - lag(x.distance) OVER w, 0) AS distance_delta, CAST(coalesce(sum(CAST(x.position = 1 AS INTEGER)) OVER (PARTITION BY x.participant ORDER BY x.d, x.contest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_wins, is_turf
FROM XR x LEFT JOIN EL e ON e.period = year(x.d) AND e.participant = x.participant LEFT JOIN GL g ON g.period = year(x.d) AND g.participant = x.participant LEFT JOIN RANKS r ON r.as_of = CAST(date_trunc('year', x.d) AS DATE) AND r.node = x.participant
WINDOW w AS (PARTITION BY x.participant ORDER BY x.d, x.contest)"""


def _stored(spark, sf):
    """The entries that ratings, centrality and windows read, with the columns that these need."""
    return settle(full_entries(spark, sf).drop("price", "discount", "season", "priority", "payout"), "entries")


def _year_start(h):
    return h.withColumn("period", F.make_date("period", F.lit(1), F.lit(1)))


@query(with_entries(_ROW_SELECT, _ROW))
def r6_snapshot_features(spark, sf):
    """The feature row of 28 columns, with states of the year before."""
    e = _stored(spark, sf)
    ranks = R.snapshot_pagerank(e, R.yearly_snapshots(e))
    out = R.snapshot_features(e, _year_start(R.ratings_by_period(e, F.year("d"))), None, ranks, F.trunc("d", "year"))
    digits = {"elo": 2, "glicko_mu": 2, "glicko_rd": 2, "centrality": 8, "rolling_esi": 6, "rolling_csi": 6, "esi_pressure": 5, "pace_advantage": 5, "handler_rate": 6, "second_handler_rate": 6}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


_FRESH = f"""{_LEVELED}, {_pagerank_sql(_edges_sql('FE', 'coalesce({}.position, 99)'))},
EQ AS (SELECT contest, EL.participant, A.margin_elo AS elo, A.rating AS glicko_mu, A.rd AS glicko_rd, 0.06::DOUBLE AS glicko_vol FROM EL JOIN RS A ON A.participant = EL.participant AND A.k = level - 1), {_ROW.removeprefix(_STATES + ', ')}"""
_FRESH_SELECT = _ROW_SELECT.replace("LEFT JOIN EL e ON e.period = year(x.d) AND e.participant = x.participant LEFT JOIN GL g ON g.period = year(x.d) AND g.participant = x.participant", "LEFT JOIN EQ e ON e.contest = x.contest AND e.participant = x.participant")
_DIGITS = {"elo": 2, "glicko_mu": 2, "glicko_rd": 2, "centrality": 8, "rolling_esi": 6, "rolling_csi": 6, "esi_pressure": 5, "pace_advantage": 5, "handler_rate": 6, "second_handler_rate": 6}


@query(with_entries(_FRESH_SELECT, _FRESH).replace("WITH ", "WITH RECURSIVE ", 1))
def r6_contest_features(spark, sf):
    """The feature row of 28 columns, with ratings before the contest itself."""
    e = _stored(spark, sf)
    ranks = R.snapshot_pagerank(e, R.yearly_snapshots(e))
    out = R.contest_features(e, R.ratings_by_contest(e, finals=False), ranks, F.trunc("d", "year"))
    return out.withColumns({c: F.round(c, n) for c, n in _DIGITS.items()})


_LEGACY = f"""{_STATES}, {_PACE}, XL AS (SELECT *, {_rate_sql('handler')} AS handler_rate, coalesce(avg(coalesce(CAST(position = 1 AS DOUBLE), 0)) OVER (PARTITION BY handler ORDER BY d, contest, participant ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.08) AS handler_prior_rate FROM XQ)"""
_LEGACY_SELECT = """SELECT x.contest, x.participant, round(rolling_esi, 6) AS rolling_esi, round(esi_pressure, 5) AS esi_pressure, round(handler_rate, 6) AS handler_rate, round(handler_prior_rate, 6) AS handler_prior_rate, round(coalesce(elo, 1500), 2) AS elo, round(coalesce(glicko_mu, 1500), 2) AS glicko, round(coalesce(glicko_rd, 350), 2) AS rd, round(coalesce(r.rank, 0.001), 8) AS centrality
FROM XL x LEFT JOIN EL e ON e.period = year(x.d) AND e.participant = x.participant LEFT JOIN GL g ON g.period = year(x.d) AND g.participant = x.participant LEFT JOIN RANKS r ON r.as_of = CAST(date_trunc('year', x.d) AS DATE) AND r.node = x.participant"""


@query(with_entries(_LEGACY_SELECT, _LEGACY))
def r7_legacy_chain(spark, sf):
    """Pace, rating, handlers, deviations, centrality; handlers' rates by rows, with the older baseline for all of the past."""
    e = _stored(spark, sf)
    ranks = R.snapshot_pagerank(e, R.yearly_snapshots(e))
    out = R.legacy_chain(e, _year_start(R.ratings_by_period(e, F.year("d"))), None, ranks, F.trunc("d", "year"))
    digits = {"rolling_esi": 6, "esi_pressure": 5, "handler_rate": 6, "handler_prior_rate": 6, "elo": 2, "glicko": 2, "rd": 2, "centrality": 8}
    return out.select("contest", "participant", *[F.round(c, n).alias(c) for c, n in digits.items()])
