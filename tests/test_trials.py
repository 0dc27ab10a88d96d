import hashlib

import pytest
from pyspark.sql import functions as F

from breezeframe.plans import QUERIES, trials
from breezeframe.sources import payloads as pl

DATA = "/root/testdata/sf0.001"


def test_bootstrap_interval(spark):
    """The middle is the observed difference, and the interval that of its normal approximation."""
    got = QUERIES["paired_bootstrap"](spark, DATA).first()
    rows = trials.h.labelled(spark, DATA).selectExpr("int(label = band_e) - int(label = pred) AS x").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("n")).first()
    error = rows["s"] / rows["n"] ** 0.5
    assert got["replicates"] == 4000 and got["mean"] == pytest.approx(rows["m"], abs=4 * error / 4000**0.5 + 1e-12)
    assert got["low"] == pytest.approx(rows["m"] - 1.96 * error, abs=0.2 * error + 2 / rows["n"]) and got["high"] == pytest.approx(rows["m"] + 1.96 * error, abs=0.2 * error + 2 / rows["n"])


@pytest.mark.parametrize("a,b,p", [(0, 0, 1.0), (5, 0, 0.0625), (10, 2, 0.03857421875), (3, 3, 1.0), (2000, 2200, 0.00213)])
def test_exact_test(spark, a, b, p):
    got = spark.createDataFrame([(a, b)], "a long, b long").select(trials.mcnemar_p(F.col("a"), F.col("b"))).first()[0]
    assert got == pytest.approx(p, rel=0.02 if a > 100 else 1e-9)


def test_quantile_floor(spark):
    rows = spark.createDataFrame([(0, 200.5), (1, 200.51), (4, 10.0), (5, 301.0)], "pred int, q double")
    assert [r[0] for r in rows.select(trials.quantile_floor(F.col("pred"), F.col("q"))).collect()] == [0, 3, 4, 5]


def test_file_pins(spark):
    for r in QUERIES["file_pins"](spark, DATA).collect():
        raw = open(f"{DATA}/{r['name']}", "rb").read()
        assert (r["bytes"], r["digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())


def test_payloads_out_of_order_are_refused(spark):
    sent = spark.createDataFrame([(1, '{"utc_offset_seconds": 0, "hourly": {"time": ["2024-01-01T01:00", "2024-01-01T00:00"], "pm25": [1], "pm10": []}}'), (2, "not json")], "series int, payload string")
    assert {r["series"]: r["violations"] for r in pl.order_violations(sent).collect()}[1] == 1
    rows = pl.payload_rows(sent).collect()
    assert [(r["series"], r["pm25"], r["pm10"]) for r in rows] == [(1, 1.0, None), (1, None, None)]


def test_journal_lines_that_are_broken_go(spark):
    lines = spark.createDataFrame([('{"entry": 1, "outcome": "went", "mood": "x"}',), ("",), ("{broken",), ('{"entry": 2}',)], "line string")
    got = [(r["entry"], r["outcome"], r["extra"]) for r in pl.journal_entries(lines).collect()]
    assert got == [("1", "went", '{"mood":"x"}'), ("2", None, None)]


def test_published_numbers_cover_every_series(spark):
    """One number for each series of the labelled hours, and texts without a language among the lengths."""
    r = QUERIES["published_numbers"](spark, "/root/testdata/sf0.001").collect()
    assert [(x["place"], x["numbers"], x["agree"]) for x in r] == [("table", 4, 4)]


def test_published_lengths_keep_rows_without_a_language(spark, tmp_path):
    rows = [(1, "abcd", "en", 4), (2, "ab", None, 2), (3, "abc", None, 9), (4, "a", "x|y", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["lang"]: (x["derived"], x["agrees"]) for x in QUERIES["published_lengths"](spark, str(tmp_path)).collect()}
    assert got == {"en": (4.0, True), None: (2.5, False), "x|y": (1.0, True)}
