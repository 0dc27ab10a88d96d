from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from breezeframe.operators import metrics as me
from breezeframe.operators import series as se

START = datetime(2024, 10, 31)


def hours(spark, rows, columns):
    return spark.createDataFrame([(0, START + timedelta(hours=h), *rest) for h, *rest in rows], f"series int, t timestamp_ntz, {columns}")


def test_exact_time_frames_see_gaps(spark):
    df = hours(spark, [(0, 2.0), (3, 4.0), (5, 7.0), (6, 10.0), (7, 99.0)], "x double")
    at = lambda n: F.max("x").over(se.hours_frame(n, -n))
    row = df.select("t", "x", *[at(n).alias(f"l{n}") for n in (1, 3, 6)]).where(F.hour("t") == 6).first()
    assert (row["x"], row["l1"], row["l3"], row["l6"]) == (10.0, 7.0, 4.0, 2.0)


def test_episode_gap_of_six_hours_continues(spark):
    df = hours(spark, [(0, 3), (6, 4), (13, 5), (14, 1), (15, 3)], "band int")
    got = [r["episode"] for r in se.with_episodes(df, F.col("band") >= 3).orderBy("t").collect()]
    assert got == [1, 1, 2, 2]


def test_trailing_mean_needs_three_hours_and_skips_negatives(spark):
    rows = [(h, v, None, None, None, None) for h, v in enumerate([30.0, -1.0, None, 60.0, 90.0])]
    df = hours(spark, rows, "pm25 double, pm10 double, no2 double, o3 double, co double")
    out = se.with_trailing(se.with_index(df)).orderBy("t").collect()
    assert [r["trail"] for r in out[:4]] == [None] * 4 and out[4]["trail"] == pytest.approx(100.0) and out[4]["trailing_hours"] == 3
    assert all(r["effective"] is None or r["instant"] is None or r["effective"] >= r["instant"] for r in out)


def test_future_does_not_change_features(spark):
    base = [(h, float(h % 7)) for h in range(20)]
    early = lambda rows: [tuple(r) for r in se.with_lags(hours(spark, rows, "effective double")).where(F.hour("t") < 10).orderBy("t").collect()]
    assert early(base) == early([(h, v if h < 10 else 1e6) for h, v in base])


def test_split_is_chronological(spark):
    out = se.chronological_split(hours(spark, [(h, h) for h in range(11)], "k int"))
    assert out.where("part = 'train'").agg(F.max("k")).first()[0] < out.where("part = 'test'").agg(F.min("k")).first()[0]
    assert out.where("part = 'train'").count() == 8


def test_class_scores(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (9, 0)], "label int, pred int")
    got = {r["class"]: (r["precision"], r["recall"], r["support"]) for r in me.per_class(me.confusion(df)).collect()}
    assert got[0] == (1.0, 0.5, 2) and got[1] == (0.3333, 1.0, 1) and got[2] == (0.0, 0.0, 1) and got[5] == (0.0, 0.0, 0)


@pytest.mark.parametrize("a,b,p", [(0, 0, 1.0), (1, 1, 1.0), (10, 2, 0.038574), (5, 0, 0.0625)])
def test_mcnemar(a, b, p):
    assert me.mcnemar_exact(a, b) == pytest.approx(p, abs=1e-6)


def test_risk_without_positives(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (1, 3, 0.9)], "label int, pred int, prob double")
    r = me.risk(df, []).first()
    assert (r["recall"], r["false_alarm_rate"], r["precision"]) == (None, 0.5, 0.0)
