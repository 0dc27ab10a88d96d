"""Queries over the full feature row: whole, after a history, the extra features, and the evidence of a decision."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import weather as we
from ..operators import features as fe
from . import hourly as h
from .hourly import query, r6, rounded
from .sql import SLOTS_SQL, with_views

OUT = tuple(dict.fromkeys((*fe.FULL, *fe.COMPACT, "naqi_band_ordinal", "heat_flag")))


def _features_sql(source: str) -> str:
    """A view `feat` of all features over a view of slots."""
    w = "OVER (PARTITION BY series ORDER BY t)"
    less = lambda c, n: f"{c} - lag({c}, {n}) {w}"
    lags = [f"lag(effective, {n}) {w} AS naqi_lag{n}, {less('effective', n)} AS naqi_diff{n}" for n in (1, 3, 6)]
    lags += [f"({less('effective', 6)}) / 6.0 AS naqi_rate6, lag(pm25, 1) {w} AS pm25_lag1, {less('pm25', 3)} AS pm25_diff3, {less('pm10', 3)} AS pm10_diff3"]
    lags += [f"{less('temp_c', 3)} AS temp_diff3, lag(wind_kmh, 1) {w} AS wind_lag1, {less('wind_kmh', 1)} AS wind_diff1"]
    lags += [f"avg(effective) OVER (PARTITION BY series ORDER BY t ROWS {n - 1} PRECEDING) AS naqi_rolling{n}" for n in (3, 6)]
    return f"""feat AS (SELECT * EXCLUDE (is_day), effective AS naqi, coalesce(is_day, 0)::DOUBLE AS is_day, hour(t)::DOUBLE AS hour, month(t)::DOUBLE AS month, {', '.join(lags)},
  0.61078 * exp(17.27 * temp_c / (temp_c + 237.3)) * (1 - greatest(least(humidity, 100.0), 0.01) / 100.0) AS vpd, humidity / 100.0 / greatest(wind_kmh, 1.0) AS stagnation,
  CASE WHEN pm25 IS NOT NULL AND pm10 IS NOT NULL THEN least(greatest(pm25 / greatest(pm10, 1.0), 0.0), 1.0) END AS pm_ratio, coalesce(effective - instant, 0.0) AS naqi_gap,
  sin(2 * pi() * hour(t) / 24.0) AS hour_sin, cos(2 * pi() * hour(t) / 24.0) AS hour_cos, sin(2 * pi() * month(t) / 12.0) AS month_sin, cos(2 * pi() * month(t) / 12.0) AS month_cos,
  coalesce(band_e, -1)::DOUBLE AS naqi_band_ordinal, CASE WHEN apparent_c >= 35 THEN 1.0 ELSE 0.0 END::DOUBLE AS heat_flag FROM {source})"""


_OUT_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in OUT)
_RANKED = "nb AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t DESC) AS back FROM slots)"


@query(with_views(f"{SLOTS_SQL}, {_features_sql('slots')}", f"SELECT series, t, {_OUT_SQL} FROM feat"))
def feature_rows(spark, d):
    """Every hour's 28 features, the 17 compact ones, the band and the heat flag."""
    return fe.with_features(h.slots(spark, d)).select("series", "t", *map(r6, OUT))


@query(with_views(f"{SLOTS_SQL}, {_RANKED}, nh AS (SELECT * FROM nb WHERE back <= 30), {_features_sql('nh')}", f"SELECT series, t, {_OUT_SQL} FROM feat WHERE back <= 24"))
def features_after_history(spark, d):
    """The last 24 hours of each series, whose lags look into the six hours before them."""
    ranked = h.slots(spark, d).withColumn("back", F.row_number().over(W.partitionBy("series").orderBy(F.desc("t"))))
    return fe.after_history(ranked.where("back <= 24"), ranked.where("back > 24 AND back <= 30")).select("series", "t", *map(r6, OUT))


@query(
    with_views(
        f"{SLOTS_SQL}, al AS (SELECT *, 17.27 * temp_c / (temp_c + 237.3) + ln(greatest(least(humidity, 100.0), 0.01) / 100.0) AS alpha FROM slots)",
        """SELECT series, t, round(temp_c - 237.3 * alpha / (17.27 - alpha), 6) AS dew_depression, round(CASE WHEN temp_c IS NOT NULL THEN (100.0 - humidity) / 5.0 END, 6) AS dew_by_humidity,
  round(CASE WHEN temp_c IS NOT NULL THEN greatest(temp_c, 5.0) * wind_kmh END, 6) AS ventilation, round(humidity / 100.0 / (wind_kmh + 1.0), 6) AS calm_stagnation,
  round(sin(2 * pi() * ((hour(t) + 6) % 24) / 24.0), 6) AS target_sin, round(cos(2 * pi() * ((hour(t) + 6) % 24) / 24.0), 6) AS target_cos FROM al""",
    )
)
def extra_features(spark, d):
    """Dew depression in two forms, ventilation, stagnation with an added wind, and the phase of the hour that is forecast."""
    temp, humidity, wind = (F.col(c) for c in ("temp_c", "humidity", "wind_kmh"))
    sin, cos = we.cyclic((F.hour("t") + 6) % 24, 24)
    made = {"dew_depression": we.dew_depression(temp, humidity), "dew_by_humidity": we.dew_depression_by_humidity(temp, humidity), "ventilation": we.ventilation(temp, wind), "calm_stagnation": we.calm_stagnation(humidity, wind), "target_sin": sin, "target_cos": cos}
    return h.slots(spark, d).select("series", "t", *[rounded(v).alias(k) for k, v in made.items()])


@query(with_views(SLOTS_SQL, "SELECT series, t, round(effective, 6) AS naqi, band_e AS naqi_band, round(instant, 6) AS naqi_instant, round(trail, 6) AS naqi_trailing, trailing_hours AS naqi_trailing_hours, dominant AS dominant_pollutant, round(pm25, 6) AS pm25, round(pm10, 6) AS pm10, temp_c, apparent_c, precip_mm, precip_prob, humidity, wind_kmh, uv_index FROM slots"))
def decision_evidence(spark, d):
    """The fifteen numbers behind a decision, of which the first is the one that it was made on."""
    given = {"naqi": r6("effective"), "naqi_band": F.col("band_e"), "naqi_instant": r6("instant"), "naqi_trailing": r6("trail"), "naqi_trailing_hours": F.col("trailing_hours"), "dominant_pollutant": F.col("dominant"), "pm25": r6("pm25"), "pm10": r6("pm10")}
    weather = ("temp_c", "apparent_c", "precip_mm", "precip_prob", "humidity", "wind_kmh", "uv_index")
    signals = F.struct(*[v.alias(k) for k, v in given.items()], *weather)
    return h.slots(spark, d).select("series", "t", signals.alias("signals")).select("series", "t", "signals.*")
