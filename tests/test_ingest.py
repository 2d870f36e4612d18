"""The whole ingest on a few small files."""

import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from tallyard.plans.ingest_queries import ingested
from tallyard.sources.ingest import ingest
from tallyard.sources.storage import shared_dir


def test_ingest(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    row = lambda race, pos, no, name, odds: f'RACE {race} (674),GOOD,"TURF - ""C"" Course",{pos},{no},{name},J,T,126,1127,4,---,8 8 1,0:57.87,{odds}'
    head = ",".join(map(str, range(15)))
    (raw / "races1.csv").write_text("\n".join([head, row(1, 1, 5, "SPICE BAG (L244)", 49), row(1, 2, "3.0", "abc def", "---"), row(1, "", 4, "GONE (K001)", 5), row(1, "1 DH", 6, "HEAT (K002)", 5), row(1, 1, 5, "SPICE BAG (L244)", 50), row("x", 1, 1, "NO KEY (K003)", 5)]) + "\n")
    (raw / "races2.csv").write_text(head + "\n" + row(7, 1, 1, "SPICE BAG (L244)", 2) + "\n")
    (raw / "races3.csv").write_text(head + "\n" + row(1, 1, 1, "NO DATE (K004)", 2) + "\n")
    meta = "date,contest_no,contest_name,going,course,distance,contest_class,prize,url"
    (raw / "metadata1.csv").write_text(f"{meta}\n15/04/2026,1,RACE 1,GOOD,TURF,1200,4,n/a,http://x?Racecourse=st&RaceNo=1\n15/04/2026,2,RACE 2,GOOD,TURF,1650,4,920000,http://x\n15/04/2026,,RACE,GOOD,TURF,1,4,1,u\n")
    (raw / "metadata2.csv").write_text(f"{meta}\n16/04/2026,7,RACE 7,GOOD,TURF,1800,4,1,http://x?racecourse=HV\n")
    pay = "date,contest_no,contest_name,pool,combo,dividend,is_refund"
    (raw / "dividends1.csv").write_text(f'{pay}\n15/04/2026,1,RACE 1,TRIO,"1,2,3",120.5,0\n15/04/2026,1,RACE 1,TRIO,"1,2,3",121.5,0\n16/04/2026,7,RACE 7,TRIO,"1,2,3",REFUND,0\nx,1,RACE 1,WIN,1,2,0\n')
    (raw / "dividends2.csv").write_text("")
    got = ingest(spark, f"{raw}/races*.csv", f"{raw}/dividends*.csv", f"{raw}/metadata*.csv", f"file://{tmp_path}/clean")
    day = dt.date(2026, 4, 15)
    results = sorted((r["contest_id"], r["participant"], r["name"], r["position"], r["number"], r["distance"], r["odds"], r["d"]) for r in got["results"].collect())
    assert results == [("2026-04-15_R1", "ABC D", "abc def", 2, 3, 1200, None, day), ("2026-04-15_R1", "L244", "SPICE BAG", 1, 5, 1200, 50.0, day), ("2026-04-16_R7", "L244", "SPICE BAG", 1, 1, 1800, 2.0, dt.date(2026, 4, 16))]
    assert sorted((r["contest_id"], r["combo"], r["dividend"], r["is_refund"]) for r in got["payouts"].collect()) == [("2026-04-15_R1", "1,2,3", 121.5, 0), ("2026-04-16_R7", "1,2,3", None, 1)]
    contests = sorted((r["contest_id"], r["distance"], r["prize"], r["venue"], r["is_bettable"]) for r in got["contests"].collect())
    assert contests == [("2026-04-15_R1", 1200, None, "ST", 1), ("2026-04-15_R2", 1650, 920000, "UNK", 0), ("2026-04-16_R7", 1800, 1, "HV", 0)]
    assert spark.read.parquet(f"{tmp_path}/clean/results").count() == 3


def test_raw_files_go_when_the_tables_are_stored(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderdate < '1995-02-01'")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{sf}/lineitem.parquet").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").write.parquet(f"{tmp_path}/lineitem.parquet")
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir()) if folder.exists() else set()
    tables = ingested(spark, str(tmp_path))
    assert {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before} == {"ingested"}
    assert all(t.count() for t in tables.values())
