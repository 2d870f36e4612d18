"""Scalar functions of cleaning and feature building: Columns in, Columns out, no Python on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# How much a rail position and a surface slow a contest down.
COURSE_MULTIPLIERS = {"A": 1.0, "A+3": 1.05, "B": 1.10, "B+2": 1.15, "C": 1.20, "C+3": 1.30}
GOING_MULTIPLIERS = {"GOOD TO FIRM": 1.0, "FAST": 1.0, "GOOD": 0.9, "GOOD TO YIELDING": 0.8, "YIELDING": 0.7, "SOFT": 0.6, "WET FAST": 0.8}
COURSE_DEFAULT, GOING_DEFAULT = 1.0, 0.9
# Written margins, in lengths.
MARGINS = {"N": 0.05, "NOSE": 0.05, "SH": 0.1, "SHD": 0.1, "SN": 0.1, "HD": 0.2, "DH": 0.0}


def dmy_to_iso(c: Column) -> Column:
    """'dd/mm/yyyy' as 'yyyy-MM-dd'; null if it is no date."""
    return F.date_format(F.try_to_timestamp(F.trim(c), F.lit("dd/MM/yyyy")), "yyyy-MM-dd")


def parse_name_code(c: Column, fallback: bool = True) -> Column:
    """struct(name, code) of 'NAME (CODE)'; without a code, the first five characters in upper case, or ''."""
    pattern = r"^(.*?)\s*\(([A-Z0-9]{3,5})\)\s*$"
    s = F.trim(c)
    there = s.rlike(pattern)
    return F.struct(
        F.when(there, F.regexp_extract(s, pattern, 1)).otherwise(s).alias("name"),
        F.when(there, F.regexp_extract(s, pattern, 2)).otherwise(F.upper(F.substring(s, 1, 5)) if fallback else F.lit("")).alias("code"),
    )


def url_param(c: Column, key: str, default: str = "UNK") -> Column:
    """A query parameter in upper case, its name in any case."""
    found = F.regexp_extract(c, rf"(?i)[?&]{key}=([^&#]*)", 1)
    return F.when(F.length(found) > 0, F.upper(found)).otherwise(F.lit(default))


def to_float(c: Column) -> Column:
    """A number, or null for '', '---' and whatever else is none."""
    s = F.trim(c)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def to_int(c: Column) -> Column:
    """As to_float, cut to its integer part."""
    return to_float(c).try_cast("int")


def first_digits(c: Column) -> Column:
    return F.regexp_extract(c, r"([0-9]+)", 1).try_cast("double")


def contest_no(c: Column) -> Column:
    return F.regexp_extract(F.upper(c), r"RACE\s+([0-9]+)", 1).try_cast("int")


def contest_key(d: Column, n: Column) -> Column:
    return F.concat(d.cast("string"), F.lit("_R"), n.cast("string"))


def legacy_ids(contest_name: Column, participant_name: Column) -> Column:
    """struct(contest_code, participant_code, distance): codes in parentheses, distance behind the last dash."""
    code = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"\(([^)]*)\)", 1), F.lit("")), F.lit("Unknown"))
    distance = F.when(contest_name.contains("-"), F.trim(F.substring_index(contest_name, "-", -1))).otherwise(F.lit("Unknown"))
    return F.struct(code(contest_name).alias("contest_code"), code(participant_name).alias("participant_code"), distance.alias("distance"))


def parse_margin(c: Column) -> Column:
    """A written margin in lengths: a word, 'a-b/c', 'b/c' or a number; anything else, negatives too, is 0."""
    s = F.upper(F.trim(c))
    mixed = r"^([0-9]+)-([0-9]+)/([0-9]+)$"
    plain = r"^([0-9]+)/([0-9]+)$"
    part = lambda p, k: F.regexp_extract(s, p, k).try_cast("double")
    words = reduce(lambda w, x: w.when(s == x[0], F.lit(x[1])), list(MARGINS.items())[1:], F.when(s == "N", F.lit(MARGINS["N"])))
    value = (
        words.when(s.rlike(mixed), part(mixed, 1) + F.try_divide(part(mixed, 2), part(mixed, 3)))
        .when(s.rlike(plain), F.try_divide(part(plain, 1), part(plain, 2)))
        .when(s.contains("-"), F.lit(0.0))
        .otherwise(to_float(s))
    )
    return F.coalesce(value, F.lit(0.0))


def parse_positions(c: Column) -> Column:
    """Whitespace-separated integers; anything else between them is dropped."""
    return F.transform(F.filter(F.split(F.trim(c), r"\s+"), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int"))


def early_speed(a: Column) -> Column:
    """1 over the root of the first position; null without one."""
    first = F.get(a, F.lit(0))
    return F.when(first > 0, 1 / F.sqrt(first.cast("double")))


def closing_speed(a: Column) -> Column:
    """Places gained from the last but one position to the last; 0 with fewer than two."""
    return F.when(F.size(a) >= 2, (F.element_at(a, -2) - F.element_at(a, -1)).cast("double")).otherwise(F.lit(0.0))


def sanitise_keys(df: DataFrame, text: list[str], numbers: list[str], dates: list[str]) -> DataFrame:
    """Key columns trimmed, numeric or dates; values that are neither become null."""
    cols = {c: F.trim(F.col(c).cast("string")) for c in text} | {c: to_float(F.col(c).cast("string")) for c in numbers}
    return df.withColumns(cols | {c: F.try_to_timestamp(F.trim(F.col(c).cast("string")), F.lit("yyyy-MM-dd")).cast("date") for c in dates})


def is_turf(c: Column) -> Column:
    return F.coalesce(F.upper(c).contains("TURF"), F.lit(False)).cast("int")


def _lookup(c: Column, values: dict[str, float], default: float) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def course_multiplier(c: Column) -> Column:
    return _lookup(F.regexp_extract(c, r"([A-C](?:\+3|\+2)?)", 1), COURSE_MULTIPLIERS, COURSE_DEFAULT)


def going_multiplier(c: Column) -> Column:
    return _lookup(F.upper(F.trim(c)), GOING_MULTIPLIERS, GOING_DEFAULT)


def interact(df: DataFrame, early: str = "esi", closing: str = "csi", course: str = "course", going: str = "going") -> DataFrame:
    """Early speed by course, closing speed by going."""
    return df.withColumns({"esi_course": F.col(early) * course_multiplier(F.col(course)), "csi_going": F.col(closing) * going_multiplier(F.col(going))})


def season_label(d: Column) -> Column:
    """Seasons run from September to August: 'YYYY/YYYY+1'."""
    y = F.year(F.add_months(d, -8))
    return F.concat(y.cast("string"), F.lit("/"), (y + 1).cast("string"))


def season_bounds(label: Column) -> Column:
    """struct(start, end): first and last day of a season."""
    y = F.substring(label, 1, 4).cast("int")
    return F.struct(F.make_date(y, F.lit(9), F.lit(1)).alias("start"), F.make_date(y + 1, F.lit(8), F.lit(31)).alias("end"))


def train_bounds(label: Column, lookback: int = 5) -> Column:
    """struct(start, end): the seasons before, as many as lookback."""
    y = F.substring(label, 1, 4).cast("int")
    return F.struct(F.make_date(y - lookback, F.lit(9), F.lit(1)).alias("start"), F.make_date(y, F.lit(8), F.lit(31)).alias("end"))


def distance_regime(c: Column) -> Column:
    """Sprint up to 1200, Mile up to 1650, else Stayer; Mile if there is no number."""
    n = F.regexp_replace(c.cast("string"), r"[^0-9]", "").try_cast("long")
    return F.when(n.isNull(), "Mile").when(n <= 1200, "Sprint").when(n <= 1650, "Mile").otherwise("Stayer")


def relevance(position: Column, top: int = 20) -> Column:
    return F.greatest(F.lit(0), F.lit(top) - position)


def targets(df: DataFrame, position: str = "position") -> DataFrame:
    p = F.col(position)
    return df.withColumns({"is_win": (p == 1).cast("int"), "is_place": (p <= 3).cast("int"), "is_pair_hit": (p <= 2).cast("int")})


def implied_prob(odds: Column) -> Column:
    return F.try_divide(F.lit(1.0), odds)


def alpha_delta(p: Column, odds: Column) -> Column:
    return p - implied_prob(odds)


def time_split(d: Column, cuts: list[str], names: list[str]) -> Column:
    """The name of the part a date falls in; each part begins at its cut."""
    out = F.lit(names[0])
    for cut, name in zip(cuts, names[1:], strict=True):
        out = F.when(d >= F.lit(cut).cast("date"), name).otherwise(out)
    return out


def require(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with all of cols; how many went is observed under 'require'."""
    lost = F.sum(F.when(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols]), 1).otherwise(0))
    return df.observe("require", F.count("*").alias("rows"), lost.alias("lost")).dropna(subset=cols)


def clean_combo(c: Column, k: int = 3) -> Column:
    """The sorted array of a combination of k different numbers; null for anything else."""
    a = F.array_sort(F.array_distinct(F.transform(F.split(c, ","), lambda x: x.try_cast("int"))))
    fine = c.rlike(r"^[0-9]+(,[0-9]+)*$")
    return F.when(fine & (F.size(a) == k), a)


def header_fields(c: Column) -> Column:
    """struct(title, going, course, distance, klass, prize) from a page's text; '' where a field is missing."""
    distance = reduce(
        lambda a, p: F.when(F.length(a) > 0, a).otherwise(F.regexp_extract(c, p, 1)),
        [r"([0-9]{3,4})\s*M(?:etres?)?\b", r"([0-9]{3,4})\s*m(?:etres?)?\b"],
        F.regexp_extract(c, r"([0-9]{1,2},?[0-9]{3})\s*M(?:etres?)?\b", 1),
    )
    return F.struct(
        F.trim(F.regexp_extract(c, r"(?i)(RACE\s+[0-9]+[^\n]*)", 1)).alias("title"),
        F.trim(F.regexp_extract(c, r"Going\s*:\s*([^\n]+)", 1)).alias("going"),
        F.trim(F.regexp_extract(c, r"Course\s*:\s*([^\n]+)", 1)).alias("course"),
        F.regexp_replace(distance, ",", "").alias("distance"),
        F.trim(F.regexp_extract(c, r"(?i)(Class\s+[0-9]+|Group\s+[0-9]+|Griffin|Restricted)", 1)).alias("klass"),
        F.regexp_replace(F.regexp_extract(c, r"HK\$?\s*([0-9,]+)", 1), ",", "").alias("prize"),
    )


def match_pool(c: Column, pools: list[str]) -> Column:
    """The first pool named in the text, longer names before those they contain; null if there is none."""
    s = F.upper(F.trim(c))
    return F.coalesce(*[F.when(s.contains(p), F.lit(p)) for p in sorted(pools, key=lambda p: (-len(p), p))])


def money(c: Column) -> Column:
    """struct(amount, is_refund) of '1,234.50' or 'REFUND'."""
    found = F.regexp_extract(c, r"([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?)", 1)
    refund = F.upper(c).contains("REFUND")
    return F.struct(F.when(~refund, F.regexp_replace(found, ",", "").try_cast("double")).alias("amount"), F.coalesce(refund, F.lit(False)).cast("int").alias("is_refund"))


def incident_rows(df: DataFrame, cells: str = "cells") -> DataFrame:
    """Rows with at least four cells of which the first begins with digits."""
    return df.where((F.size(cells) >= 4) & F.get(F.col(cells), F.lit(0)).rlike(r"^\s*[0-9]+"))


def drop_overseas(df: DataFrame, url: str = "url") -> DataFrame:
    return df.where(~F.coalesce(F.lower(F.col(url)).contains("/overseas/"), F.lit(False)))


def calendar(spark: SparkSession, first: str, last: str, weekdays: tuple[int, ...] = (4, 7, 1)) -> DataFrame:
    """Candidate days between two dates, newest first; weekdays count from Sunday, 1."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d"))
    return days.where(F.dayofweek("d").isin(*weekdays)).orderBy(F.desc("d"))


def numeric_features(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType | BooleanType) and f.name not in exclude]


def holdout_guard(df: DataFrame, horizon: str, d: str = "d") -> DataFrame:
    """Nothing later than the horizon; cut before anything is materialised."""
    return df.where(F.col(d) <= F.lit(horizon).cast("date"))
