"""Registered queries against their SQL on the smallest tables; the streams against batch SQL."""

import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = ["flagship_season_report", "strategy_v26", "strategy_v32", "strategy_v21", "r6_snapshot_features", "a20_diagnostic_report", "p27_header_fields", "s14_replace_partition", "j11_as_of", "a4_bettable_flag", "w7_handler_rate_strict", "r1_pairwise_elo", "l1_compounding_ledger", "strategy_v25", "t1_stream_history", "t2_stream_ratings", "m8_ndcg", "m1_boosted_splits", "m3_isotonic_cells", "m6_permutation", "r1_r2_r3_by_contest", "w13_equity_kelly", "w7_handler_rate_buckets", "s13_catalogue", "s14_append_meetings", "strategy_v6_1"]


def show(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    c = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == cols
    want = sorted(tuple(show(r[names.index(x)]) for x in cols) for r in c.fetchall())
    assert sorted(tuple(show(r[x]) for x in cols) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
