"""Snapshots, newest files, disagreements, judge answers, and the reference constants of gates, fingerprints, stations and partitions."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from breezeframe.functions import weather as we
from breezeframe.plans import evidence as ev
from breezeframe.plans import trials as tl
from breezeframe.sources import payloads as pl


def test_a_month_reads_its_folder_alone(spark, tmp_path):
    rows = spark.createDataFrame([(k, dt.datetime(2024, 1 + k % 3, 5)) for k in range(9)], "k int, at timestamp_ntz")
    folder = f"file://{tmp_path}/s"
    assert ev.load_snapshot(spark, folder, rows.schema, 2024, 1).count() == 0
    ev.write_snapshots(rows, "at", folder)
    one = ev.load_snapshot(spark, folder, rows.schema, 2024, 2)
    assert sorted(r["k"] for r in one.collect()) == [1, 4, 7] and one.columns == ["k", "at"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: []" in plan
    assert ev.load_snapshot(spark, folder, rows.schema, 2024, 9).count() == 0


def test_newest_file(spark, tmp_path):
    for k, name in enumerate(("a-1.parquet", "a-2.parquet", "b-1.parquet", "a-3.parquet")):
        spark.range(2).coalesce(1).write.parquet(f"file://{tmp_path}/w{k}")
        (part,) = [f for f in os.listdir(tmp_path / f"w{k}") if f.endswith(".parquet")]
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.rename(tmp_path / f"w{k}" / part, tmp_path / "in" / name)
        os.utime(tmp_path / "in" / name, (1000 + [5, 9, 50, 9][k],) * 2)
    newest = lambda p: [r["name"] for r in ev.newest_file(spark, f"file://{tmp_path}/in", p).collect()]
    assert newest("a-*") == ["a-3.parquet"] and newest("*") == ["b-1.parquet"]


def test_every_planted_disagreement_is_a_row(spark):
    derived = spark.createDataFrame([(1, 5.0, 1), (2, 5.0, 1), (3, 5.0, 1), (4, None, 1), (6, 1.0, 1), (6, 1.0, 1), (7, 1.0, None)], "k int, total double, n int")
    stored = spark.createDataFrame([(1, 5.004, 1), (2, 5.1, 2), (4, 5.0, 1), (5, 1.0, 1), (6, 1.0, 1), (7, 1.0, None)], "k int, total double, n int")
    got = {(r["k"], r["code"]) for r in ev.disagreements(derived, stored, "k", {"total": 0.005, "n": 0}).collect()}
    assert got == {(2, "wrong_total"), (2, "wrong_n"), (3, "missing_summary"), (4, "wrong_total"), (5, "missing_rows"), (6, "repeated")}
    assert ev.disagreements(stored, stored, "k", {"total": 0.0}).count() == 0


@pytest.mark.parametrize(
    "answer, want",
    [
        ('{"scores": [{"id": "x", "length": 2}]}', {"x": 2}),
        ('{"x": {"length": 1.9}, "y": {"length": -1}}', {"x": 1, "y": 0}),
        ('[{"anon_id": "x", "length": 99}, 5, {"length": 1}, {"id": "x", "length": "2"}]', {"x": None}),
        ('{"ID": 7, "length": true}', {"7": 1}),
        ('{"id": "", "ID": "z", "length": null}', {"z": None}),
        ('{"scores": 3, "id": "q", "length": 1}', {"q": 1}),
        ('{"id": "neg", "length": -0.5}', {"neg": 0}),
        ("not json", {}),
        ("[]", {}),
        (None, {}),
    ],
)
def test_judge_answers(spark, answer, want):
    rows = ev.judge_scores(spark.createDataFrame([(1, answer)], "key int, answer string")).collect()
    assert {r["id"]: r["length"] for r in rows} == want
    assert all(r["total"] == (r["length"] or 0) for r in rows)


def test_near_hours(spark):
    """Steps of 5, 2, 0.5 and 10, halves to even; the decision, the day and the code tell hours apart too."""
    df = spark.createDataFrame([("GO", 1, 0, 12.5, 25.0, 0.75, 25.0), ("GO", 1, 0, 10.1, 23.1, 1.2, 15.1), ("WAIT", 0, None, None, 25.1, 0.2, 95.0)], "d string, i int, c int, effective double, apparent_c double, precip_mm double, precip_prob double")
    got = [r[0] for r in df.select(tl.near_key(F.col("d"), F.col("i"), F.col("c"), {c: F.col(c) for c in tl.WIDTHS})).collect()]
    assert got == ["GO:1:0:2:12:2:2", "GO:1:0:2:12:2:2", "WAIT:0:na:na:13:0:10"]


def test_stations(spark):
    """A city as object or list, a station that tells no place, one with a particle reading only, one without any, one of another city."""
    lines = [
        '{"data": {"aqi": 55, "city": {"name": "near", "geo": [12.98, 77.60]}}}',
        '{"data": {"aqi": "-", "city": [{"name": "listed", "geo": [12.5, 77.6]}], "iaqi": {"pm25": 12.5}}}',
        '{"data": {"aqi": 60, "city": {"name": "no place"}}}',
        '{"data": {"aqi": "-", "city": {"name": "silent", "geo": [12.98, 77.60]}, "iaqi": {}}}',
        '{"data": {"aqi": 89, "city": {"name": "far", "geo": [28.499727, 77.267095]}}}',
        "[]",
    ]
    rows = pl.station_rows(spark.createDataFrame([(x,) for x in lines], "line string"))
    got = {r["name"]: r["km"] for r in pl.usable_stations(rows, we.haversine(F.lit(12.97), F.lit(77.59), F.col("lat"), F.col("lon"))).collect()}
    assert set(got) == {"near", "listed", "no place"} and got["no place"] is None and 40 < got["listed"] < 60
    half = spark.range(1).select(we.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()[0]
    assert abs(half - 20015.09) < 0.01


def period(spark, rows):
    return spark.createDataFrame([(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), y, r, c) for s, h, y, r, c in rows], "series int, t timestamp_ntz, label int, pred int, band_e int")


def test_gates(spark):
    """Alarms may rise by 0.01 to 0.05 at most; two new hits in an episode that the reference missed are a gain; a period without support loses nothing but proves nothing."""
    quiet = [(1, h, 0, 0, 0) for h in range(100, 200)]
    missed = [(1, h, 4, 0, 4 if h < 2 else 3) for h in range(4)]
    g = tl.gates(period(spark, quiet + missed))
    r = g.first()
    assert all(r[k] for k in g.columns if k.endswith(("_holds", "_hold"))) and r["recall_change"] == 1.0 and r["new_hits"] == 2
    v = tl.verdict(g).first()
    assert (v["guardrails"], v["recall_gain"], v["episode_gain"], v["passes"]) == (True, True, True, True)
    loud = [(1, h, 0, 0, 3 if h < 102 else 0) for h in range(100, 200)]
    r = tl.gates(period(spark, loud + missed)).first()
    assert not r["poor_alarms_hold"] and r["very_poor_alarms_hold"]
    r = tl.gates(period(spark, quiet)).first()
    assert r["recall_change"] is None and tl.verdict(tl.gates(period(spark, quiet))).first()["passes"] is False


def plain_partitions(rows, least_positive, least_negative, gap=6):
    """The chained search of one series as a loop over days."""
    hour, day = dt.timedelta(hours=1), dt.timedelta(days=1)
    floor = lambda t: dt.datetime(t.year, t.month, t.day)
    begin, end = floor(min(t for t, _ in rows)), floor(max(t for t, _ in rows)) + day

    def supported(a, z):
        own = [y for t, y in rows if a <= t and t + gap * hour < z]
        return sum(y >= 3 for y in own) >= least_positive and sum(y < 3 for y in own) >= least_negative

    out = []
    for phase in tl.PHASES:
        stop = begin and next((begin + k * day for k in range(1, 400) if begin + k * day < end and supported(begin, begin + k * day)), None)
        out.append((phase, begin, stop))
        begin = stop
    return [*out, ("threshold_selection", begin, end if begin and supported(begin, end) else None)]


@pytest.mark.parametrize("seed", range(3))
def test_partitions_against_a_loop(spark, seed):
    import random

    rng = random.Random(seed)
    days = rng.choice([3, 12, 30])
    rows = [(dt.datetime(2024, 2, 25) + dt.timedelta(hours=h), rng.choice([0, 0, 1, 3, 4])) for h in range(3, days * 24) if rng.random() < 0.7]
    df = spark.createDataFrame([(1, *r) for r in rows], "series int, t timestamp_ntz, label int")
    got = {r["phase"]: (r["begin"], r["stop"]) for r in tl.support_partitions_of(df, 15, 30).collect()}
    assert got == {p: (a, z) for p, a, z in plain_partitions(rows, 15, 30)}
