"""The full feature row of an hour, its order, and the check that a model gets what it was fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import weather as we
from . import series as se

# The orders of features that models are fitted on.
BASE = ("naqi", "pm25", "pm10", "temp_c", "apparent_c", "precip_mm", "precip_prob", "humidity", "wind_kmh", "uv_index", "is_day", "hour", "month")
LAGS = ("naqi_lag1", "naqi_lag3", "naqi_lag6", "naqi_diff1", "naqi_diff3", "naqi_diff6", "naqi_rate6", "pm25_lag1", "pm25_diff3", "pm10_diff3", "temp_diff3", "wind_lag1", "wind_diff1", "naqi_rolling3", "naqi_rolling6")
FULL = BASE + LAGS
COMPACT = ("naqi", "pm25", "pm10", "temp_c", "precip_mm", "humidity", "wind_kmh", "is_day", "month", "vpd", "stagnation", "pm_ratio", "naqi_gap", "hour_sin", "hour_cos", "month_sin", "month_cos")
ORDERS = (FULL, BASE, COMPACT)


def with_features(slots: DataFrame) -> DataFrame:
    """Adds the columns of FULL and COMPACT, `naqi_band_ordinal` (-1 if unknown) and `heat_flag`. All lags share one order of the series."""
    c = F.col
    hour, month = F.hour("t").cast("double"), F.month("t").cast("double")
    (hs, hc), (ms, mc) = we.cyclic(hour, 24), we.cyclic(month, 12)
    lag, less = se.lag, lambda name, n: F.col(name) - se.lag(name, n)
    return slots.withColumn("naqi", c("effective")).withColumns(
        {
            "is_day": F.coalesce(c("is_day").cast("double"), F.lit(0.0)), "hour": hour, "month": month,
            **{f"naqi_lag{n}": lag("naqi", n) for n in (1, 3, 6)}, **{f"naqi_diff{n}": less("naqi", n) for n in (1, 3, 6)},
            "naqi_rate6": less("naqi", 6) / 6.0, "pm25_lag1": lag("pm25", 1), "pm25_diff3": less("pm25", 3), "pm10_diff3": less("pm10", 3),
            "temp_diff3": less("temp_c", 3), "wind_lag1": lag("wind_kmh", 1), "wind_diff1": less("wind_kmh", 1),
            "naqi_rolling3": se.rolling("naqi", 3), "naqi_rolling6": se.rolling("naqi", 6),
            "vpd": we.vapour_deficit(c("temp_c"), c("humidity")), "stagnation": we.stagnation(c("humidity"), c("wind_kmh")),
            "pm_ratio": we.particle_ratio(c("pm25"), c("pm10")), "naqi_gap": F.coalesce(c("naqi") - c("instant"), F.lit(0.0)),
            "hour_sin": hs, "hour_cos": hc, "month_sin": ms, "month_cos": mc,
            "naqi_band_ordinal": F.coalesce(c("band_e").cast("double"), F.lit(-1.0)), "heat_flag": (F.coalesce(c("apparent_c"), F.lit(0.0)) >= 35).cast("double"),
        }
    )


def after_history(slots: DataFrame, history: DataFrame) -> DataFrame:
    """The features of `slots` with the hours of `history` before them, which are then left out."""
    both = history.withColumn("_new", F.lit(False)).unionByName(slots.withColumn("_new", F.lit(True)))
    return with_features(both).where("_new").drop("_new")


def known_order(order: tuple[str, ...] | None, width: int | None) -> tuple[str, ...]:
    """The feature order that a model declares, or the one of its width; ValueError if neither tells."""
    if order is not None:
        if not order or len(set(order)) < len(order) or not set(order) <= {*FULL, *COMPACT}:
            raise ValueError(f"not an order of known features without repeats: {order}")
        return tuple(order)
    for candidate in ORDERS:
        if len(candidate) == width:
            return candidate
    raise ValueError(f"no feature order is declared and none has width {width}")


def matrix(df: DataFrame, order: tuple[str, ...], width: int) -> DataFrame:
    """Adds `x`: the features in order as doubles; ValueError if a model of that width can't take them."""
    if len(order) != width:
        raise ValueError(f"the model takes {width} features, the rows have {len(order)}")
    return df.withColumn("x", F.array(*[F.col(c).cast("double") for c in order]))
