import math

import pytest
from pyspark.sql import functions as F

from breezeframe.functions import index as ix
from breezeframe.functions import policy as po
from breezeframe.functions import weather as we


def column(spark, values, f, kind="double"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[1] for r in df.select("k", f(F.col("x"))).orderBy("k").collect()]


@pytest.mark.parametrize("key,points", [("pm25", [(0, 0), (30, 50), (60, 100), (90, 200), (120, 300), (250, 400), (45, 75.5), (10_000, 500), (-5, 0)]), ("pm10", [(0, 0), (50, 50), (100, 100), (250, 200), (350, 300), (430, 400)]), ("co", [(2000.0, 100)])])
def test_sub_index(spark, key, points):
    got = column(spark, [float(x) for x, _ in points], lambda x: ix.sub_index(key, x))
    assert got == pytest.approx([y for _, y in points], abs=0.1)


def test_sub_index_odd_values(spark):
    assert column(spark, [None, math.inf, -math.inf], lambda x: ix.sub_index("pm25", x)) == [None, 0.0, 0.0]
    sweep = column(spark, [k / 2 for k in range(800)], lambda x: ix.sub_index("pm25", x))
    assert sweep == sorted(sweep)


def test_bands(spark):
    edges = [50, 51, 100, 101, 200, 201, 300, 301, 400, 401, 900, -5, None, math.nan, 50.5, 200.5]
    got = column(spark, [None if v is None else float(v) for v in edges], ix.ordinal)
    assert got == [0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 0, None, None, 0, 2]


def test_index_and_dominant(spark):
    df = spark.createDataFrame([(28.0, 45.0, 22.0), (90.0, 10.0, None), (30.0, 50.0, 40.0), (None, None, None)], "pm25 double, pm10 double, no2 double")
    subs = {k: ix.sub_index(k, F.col(k)) for k in ("pm25", "pm10", "no2")}
    worst = ix.index({k: F.col(k) for k in subs})
    rows = df.select(F.round(worst, 1), ix.dominant(subs, worst), ix.missing(subs)).collect()
    assert [tuple(r) for r in rows] == [(46.7, "pm25", ""), (200.0, "pm25", "no2"), (50.0, "pm25", ""), (None, None, "pm25,pm10,no2")]


def test_inverse(spark):
    assert column(spark, [50.0, 100.0, 50.5, 999.0, -3.0], ix.pm25_for_index) == pytest.approx([30.0, 60.0, 30.0, 378.7, 0.0], abs=0.15)


def test_policy_thresholds(spark):
    air = [0.0, 100.0, 199.0, 200.0, 299.0, 300.0, 401.0, None]
    n = F.lit(None).cast("double")
    product = lambda x: po.product_policy(x, F.lit(24.0), F.lit(0.0), F.lit(5.0), F.lit(False), F.lit(1))["rank"]
    assert column(spark, air, product) == [0, 0, 0, 1, 1, 2, 2, 2]
    assert column(spark, [50.0], lambda x: po.product_policy(x, n, n, n, F.lit(False), F.lit(1))["rank"]) == [0]
    assert column(spark, [50.0], lambda x: po.safe_policy(x, n, n, n, F.lit(False), F.lit(1))["reasons"]) == [["no_heat", "no_rain"]]
    night = lambda x: po.product_policy(x, F.lit(24.0), F.lit(0.0), F.lit(5.0), F.lit(False), F.lit(0))
    assert column(spark, [50.0], lambda x: night(x)["reasons"]) == [["night"]]


def test_policies_differ(spark):
    """An index of 300 is band poor: the product skips it, the model and the labels wait."""
    args = (F.lit(24.0), F.lit(0.0), F.lit(5.0))
    assert column(spark, [300.0], lambda x: po.product_policy(x, *args, F.lit(False), F.lit(1))["rank"]) == [2]
    assert column(spark, [3], lambda x: po.model_policy(x, *args, F.lit(1)), "int") == [1]
    assert column(spark, [3, None], lambda x: po.label_policy(x, *args), "int") == [1, 2]


def test_comfort_and_weather(spark):
    assert column(spark, [0.0, None, 300.0], lambda x: po.comfort(x, F.lit(24.0), F.lit(0.0))) == [100.0, 0.0, 45.0]
    assert column(spark, [0, 95, 7, None], we.label, "int") == ["clear", "thunderstorm", "code 7", "unknown"]
    assert column(spark, [0, 95, 7, None], we.category, "int") == ["clear", "thunderstorm", None, None]
    assert column(spark, [180.0, 0.0], lambda x: we.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), x)) == pytest.approx([20015, 0], abs=1)
