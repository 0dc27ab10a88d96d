"""Weather codes and derived weather features as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weather codes of each category, and the labels of codes.
CATEGORY_CODES = {
    "clear": (0, 1),
    "cloud": (2, 3),
    "fog": (45, 48),
    "drizzle": (51, 53, 55, 56, 57),
    "rain": (61, 63, 65, 66, 67),
    "snow": (71, 73, 75, 77, 85, 86),
    "showers": (80, 81, 82),
    "thunderstorm": (95, 96, 99),
}
LABELS = {0: "clear", 1: "mainly clear", 2: "partly cloudy", 3: "overcast", 45: "fog", 48: "freezing fog", 51: "light drizzle", 53: "drizzle", 55: "heavy drizzle", 56: "freezing drizzle", 57: "freezing drizzle", 61: "light rain", 63: "rain", 65: "heavy rain", 66: "freezing rain", 67: "freezing rain", 71: "light snow", 73: "snow", 75: "heavy snow", 77: "snow grains", 80: "light showers", 81: "showers", 82: "violent showers", 85: "snow showers", 86: "snow showers", 95: "thunderstorm", 96: "thunderstorm with hail", 99: "thunderstorm with hail"}


def category(code: Column) -> Column:
    out = F
    for name, codes in CATEGORY_CODES.items():
        out = out.when(code.isin(*codes), F.lit(name))
    return out


def label(code: Column) -> Column:
    out = F.when(code.isNull(), F.lit("unknown"))
    for k, name in LABELS.items():
        out = out.when(code == k, F.lit(name))
    return out.otherwise(F.concat(F.lit("code "), code.cast("string")))


def category_sql(code: str) -> str:
    return "CASE " + " ".join(f"WHEN {code} IN ({', '.join(map(str, codes))}) THEN '{n}'" for n, codes in CATEGORY_CODES.items()) + " END"


def label_sql(code: str) -> str:
    return f"CASE WHEN {code} IS NULL THEN 'unknown' " + " ".join(f"WHEN {code} = {k} THEN '{n}'" for k, n in LABELS.items()) + f" ELSE 'code ' || {code} END"


def vapour_deficit(temp: Column, humidity: Column) -> Column:
    """Vapour-pressure deficit in kPa by the Magnus formula."""
    es = 0.61078 * F.exp(17.27 * temp / (temp + 237.3))
    return es - es * (F.greatest(F.least(humidity, F.lit(100.0)), F.lit(0.01)) / 100.0)


def stagnation(humidity: Column, wind: Column) -> Column:
    return (humidity / 100.0) / F.greatest(wind, F.lit(1.0))


def particle_ratio(pm25: Column, pm10: Column) -> Column:
    ratio = pm25 / F.greatest(pm10, F.lit(1.0))
    return F.when(pm25.isNotNull() & pm10.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)))


def dew_depression(temp: Column, humidity: Column) -> Column:
    """Temperature less the dew point, by the Magnus formula."""
    alpha = 17.27 * temp / (temp + 237.3) + F.ln(F.greatest(F.least(humidity, F.lit(100.0)), F.lit(0.01)) / 100.0)
    return temp - 237.3 * alpha / (17.27 - alpha)


def dew_depression_by_humidity(temp: Column, humidity: Column) -> Column:
    """A fifth of a degree for each percent of humidity that is lacking, where the temperature is known."""
    return F.when(temp.isNotNull(), (100.0 - humidity) / 5.0)


def ventilation(temp: Column, wind: Column) -> Column:
    # greatest() passes nulls over.
    return F.when(temp.isNotNull(), F.greatest(temp, F.lit(5.0)) * wind)


def calm_stagnation(humidity: Column, wind: Column) -> Column:
    """As stagnation, but with one added to the wind."""
    return (humidity / 100.0) / (wind + 1.0)


def cyclic(x: Column, period: int) -> tuple[Column, Column]:
    angle = 2.0 * math.pi * x / float(period)
    return F.sin(angle), F.cos(angle)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_km: float = 6371.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # `least` passes over NULLs, but a place that isn't known is no distance away.
    return F.when(a.isNotNull(), 2 * radius_km * F.asin(F.least(F.lit(1.0), F.sqrt(a))))
