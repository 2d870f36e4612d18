"""Micro-tables for the parsers and formulas."""

import math

import pytest
from pyspark.sql import functions as F

from tallyard.functions import pricing as P
from tallyard.functions import scalars as S


def one(spark, f, *values, kind="string"):
    names = [f"c{k}" for k in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {kind}" for n in names))
    return df.select(f(*[F.col(n) for n in names]).alias("x")).first()["x"]


CASES = [
    (S.dmy_to_iso, "15/04/2026", "2026-04-15"), (S.dmy_to_iso, "x", None), (S.to_int, "12.0", 12), (S.to_int, "---", None), (S.to_int, "1 DH", None), (S.to_int, "", None), (S.to_float, " 1.5 ", 1.5),
    (S.parse_margin, "N", 0.05), (S.parse_margin, "SH", 0.1), (S.parse_margin, "HD", 0.2), (S.parse_margin, "1-1/2", 1.5), (S.parse_margin, "3/4", 0.75), (S.parse_margin, "2", 2.0), (S.parse_margin, "-", 0.0), (S.parse_margin, "-3", 0.0), (S.parse_margin, "12-3", 0.0), (S.parse_margin, None, 0.0), (S.parse_margin, "1/0", 0.0),
    (S.parse_positions, "8 8 1", [8, 8, 1]), (S.parse_positions, "---", []), (S.parse_positions, "5", [5]), (S.clean_combo, "3,10,1", [1, 3, 10]), (S.clean_combo, "1/2", None), (S.clean_combo, "A,1,2", None), (S.clean_combo, "1,2", None), (S.clean_combo, "1,1,2", None),
    (S.distance_regime, "1000", "Sprint"), (S.distance_regime, "1650", "Mile"), (S.distance_regime, "1800", "Stayer"), (S.distance_regime, "abc", "Mile"),
    (lambda c: S.season_label(c.cast("date")), "2012-08-31", "2011/2012"), (lambda c: S.season_label(c.cast("date")), "2012-09-01", "2012/2013"),
    (lambda c: S.url_param(c, "RaceNo", "1"), "http://x/?a=1&raceno=7", "7"), (lambda c: S.url_param(c, "Venue"), "http://x/", "UNK"), (lambda c: S.match_pool(c, ["TRIO", "DOUBLE TRIO"]), "double trio (x)", "DOUBLE TRIO"), (S.first_digits, "1 DH", 1.0),
    (S.going_multiplier, " good to yielding", 0.8), (S.going_multiplier, "mud", 0.9), (S.course_multiplier, 'TURF - "C+3" Course', 1.3), (S.course_multiplier, "xyz", 1.0),
]


@pytest.mark.parametrize(("f", "given", "want"), CASES)
def test_scalar(spark, f, given, want):
    assert one(spark, f, given) == want


def test_structs(spark):
    assert tuple(one(spark, S.parse_name_code, "FLYING AMANI (K152)")) == ("FLYING AMANI", "K152")
    assert tuple(one(spark, S.parse_name_code, "abc def")) == ("abc def", "ABC D")
    assert tuple(one(spark, S.money, "1,234.50")) == (1234.5, 0) and tuple(one(spark, S.money, "REFUND")) == (None, 1)
    assert one(spark, lambda c: S.early_speed(S.parse_positions(c)), "8 8 1") == pytest.approx(1 / math.sqrt(8))
    assert one(spark, lambda c: S.closing_speed(S.parse_positions(c)), "8 8 1") == 7 and one(spark, lambda c: S.closing_speed(S.parse_positions(c)), "5") == 0
    assert one(spark, lambda c: S.early_speed(S.parse_positions(c)), "---") is None


def test_pricing(spark):
    n = lambda f, *v: one(spark, f, *v, kind="double")
    assert n(P.harville_pair, 0.5, 0.25) == pytest.approx(0.25 + 0.125 / 0.75)
    assert n(lambda p, o: P.kelly(p, o, 1.0), 0.5, 3.0) == pytest.approx(0.25) and n(lambda p, o: P.kelly(p, o, 1.0), 0.5, 1.0) == 0
    assert n(P.harville_ordered, 1.0, 0.5, 0.5) == 0 and n(lambda a, b, c: P.harville_trio(a, b, c, "cap"), 0.99, 0.5, 0.5) > 0
    assert n(lambda a: P.round_ticket(a), 25.0) == 20 and n(lambda a: P.round_ticket(a), 1.0) == 10
    p = [0.4, 0.3, 0.2, 0.1]
    total = sum(n(P.harville_trio, *(x for k, x in enumerate(p) if k != out)) for out in range(4))
    assert total == pytest.approx(1)
