import hashlib
from datetime import datetime

import duckdb
import pytest

from breezeframe.plans import ORACLE_SQL, QUERIES, evaluation

DATA = "/root/testdata/sf0.001"


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def hours(spark, rows):
    return spark.createDataFrame(rows, "series int, t timestamp_ntz")


def test_digest_takes_every_day(spark):
    rows = [(0, datetime(2024, m, 5, h)) for m in (1, 2) for h in (3, 1)] + [(1, datetime(2023, 7, 1, 9))]
    got = {r["series"]: (r["digest"], r["n"]) for r in evaluation.digest_of_days(hours(spark, rows)).collect()}
    days = [sha([f"2024-0{m}-05T0{h}:00" for h in (1, 3)]) for m in (1, 2)]
    assert got == {0: (sha(days), 4), 1: (sha([sha(["2023-07-01T09:00"])]), 1)}


def test_digest_refuses_repeats(spark):
    rows = [(0, datetime(2024, 1, 5, 1))] * 2
    with pytest.raises(Exception, match="repeated origin"):
        evaluation.digest_of_days(hours(spark, rows)).collect()


@pytest.mark.parametrize("name,key", [("origins_digest_all", "n"), ("join_left_weather_all", None)])
def test_no_hour_is_left_out(spark, name, key):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    want = con.sql("SELECT count(*) FROM (SELECT DISTINCT user_id % 4, date_trunc('hour', ts) FROM events)").fetchall()[0][0]
    out = QUERIES[name](spark, DATA)
    assert (sum(r[key] for r in out.collect()) if key else out.count()) == want
    assert name in ORACLE_SQL
