"""The driver's tables seen as the engine's inputs, and the same views as SQL text.

Each view is a plain plan over one or two tables. `series` splits events into several
hourly series, so every window is partitioned by a series and never by nothing.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GASES = {"pm25": "click", "pm10": "view", "no2": "purchase", "o3": "error", "co": "signup"}
CODES = (0, 1, 2, 3, 45, 51, 61, 63, 71, 80, 95, 7)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set and all run on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="breezeframe-")
    return folder.rstrip("/")


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def air(spark: SparkSession, sf_dir: str, series: int | None = 4) -> DataFrame:
    """(series, t, pm25, pm10, no2, o3, co): the last reading of each hour; one series a user if `series` is None."""
    key = F.col("user_id") if series is None else F.col("user_id") % series
    scale = {"co": 20.0}
    last = lambda k, kind: F.max_by(F.when(F.col("event_type") == kind, F.col("value")), F.when(F.col("event_type") == kind, F.col("event_id"))) * scale.get(k, 1.0)
    e = table(spark, sf_dir, "events").select(key.cast("int").alias("series"), hour_of(F.col("ts")).alias("t"), "event_type", "value", "event_id")
    return e.groupBy("series", "t").agg(*[last(k, kind).alias(k) for k, kind in GASES.items()])


def weather(spark: SparkSession, sf_dir: str, series: int | None = 4) -> DataFrame:
    """(series, t, temp_c, apparent_c, precip_mm, precip_prob, humidity, wind_kmh, weather_code, is_day, uv_index); no hour 11."""
    key = F.col("user_id") if series is None else F.col("user_id") % series
    e = table(spark, sf_dir, "events").select(key.cast("int").alias("series"), hour_of(F.col("ts")).alias("t"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    g = e.where(F.hour("t") != 11).groupBy("series", "t").agg(F.sum("k").alias("s"), F.min("k").alias("m"), F.count("*").alias("n"))
    temp = (12 + F.col("s") % 28).cast("double")
    return g.select(
        "series",
        "t",
        temp.alias("temp_c"),
        (temp + F.col("n") % 7).alias("apparent_c"),
        ((F.col("s") % 40) / 10.0).alias("precip_mm"),
        (F.col("s") % 100).cast("double").alias("precip_prob"),
        (30 + F.col("m") % 70).cast("double").alias("humidity"),
        (F.col("n") % 25).cast("double").alias("wind_kmh"),
        F.get(F.array(*map(F.lit, CODES)), (F.col("s") % len(CODES)).cast("int")).alias("weather_code"),
        F.hour("t").between(6, 18).cast("int").alias("is_day"),
        F.when(F.hour("t").between(6, 18), (F.col("s") % 12).cast("double")).otherwise(0.0).alias("uv_index"),
    )


def parks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    shade = F.when(F.col("s_nationkey") % 3 == 0, F.lit("high")).when(F.col("s_nationkey") % 3 == 1, F.lit("medium")).otherwise(F.lit("low"))
    return s.select(F.col("s_suppkey").alias("park_id"), F.col("s_name").alias("name"), (12.80 + (F.col("s_suppkey") * 37 % 400) / 1000.0).alias("lat"), (77.40 + (F.col("s_suppkey") * 53 % 400) / 1000.0).alias("lon"), shade.alias("shade"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return rows.join(part, rows["l_partkey"] == part["p_partkey"]).select(F.col("l_partkey").alias("taxon"), F.col("p_name").alias("name"), (F.col("l_linenumber") - 1).alias("agreements"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    outcome = F.when(F.col("o_orderstatus") == "F", F.lit("went")).when(F.col("o_orderstatus") == "O", F.lit("shortened")).otherwise(F.lit("skipped"))
    return o.select(F.col("o_orderkey").alias("entry"), outcome.alias("outcome"), (F.col("o_orderkey") % 61).alias("minutes"), (F.col("o_custkey") % 4).alias("reached"), F.col("o_orderpriority").alias("species"))


def readings_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 20).cast("int").alias("station"), hour_of(F.col("ts")).alias("t"), F.col("event_type").alias("parameter"), "value")


# --- as SQL

_LAST = ", ".join(f"arg_max(value, event_id) FILTER (WHERE event_type = '{kind}'){' * 20.0' if k == 'co' else ''} AS {k}" for k, kind in GASES.items())
AIR_SQL = f"air AS (SELECT CAST(user_id % 4 AS INTEGER) AS series, date_trunc('hour', ts) AS t, {_LAST} FROM events GROUP BY 1, 2)"
WEATHER_SQL = f"""wx0 AS (
  SELECT CAST(user_id % 4 AS INTEGER) AS series, date_trunc('hour', ts) AS t, sum(k) AS s, min(k) AS m, count(*) AS n
  FROM (SELECT user_id, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE hour(ts) <> 11 GROUP BY 1, 2),
wx AS (
  SELECT series, t, (12 + s % 28)::DOUBLE AS temp_c, (12 + s % 28 + n % 7)::DOUBLE AS apparent_c, (s % 40)::DOUBLE / 10.0::DOUBLE AS precip_mm,
         (s % 100)::DOUBLE AS precip_prob, (30 + m % 70)::DOUBLE AS humidity, (n % 25)::DOUBLE AS wind_kmh,
         [{', '.join(map(str, CODES))}][CAST(s % {len(CODES)} AS INTEGER) + 1] AS weather_code,
         CASE WHEN hour(t) BETWEEN 6 AND 18 THEN 1 ELSE 0 END AS is_day, CASE WHEN hour(t) BETWEEN 6 AND 18 THEN (s % 12)::DOUBLE ELSE 0.0::DOUBLE END AS uv_index
  FROM wx0)"""
PARKS_SQL = """parks AS (
  SELECT s_suppkey AS park_id, s_name AS name, 12.80::DOUBLE + (s_suppkey * 37 % 400)::DOUBLE / 1000.0::DOUBLE AS lat, 77.40::DOUBLE + (s_suppkey * 53 % 400)::DOUBLE / 1000.0::DOUBLE AS lon,
         CASE s_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS shade
  FROM supplier)"""
OBSERVATIONS_SQL = "obs AS (SELECT l_partkey AS taxon, p_name AS name, l_linenumber - 1 AS agreements, l_orderkey * 8 + l_linenumber AS pos FROM lineitem JOIN part ON l_partkey = p_partkey)"
JOURNAL_SQL = """journal AS (
  SELECT o_orderkey AS entry, CASE o_orderstatus WHEN 'F' THEN 'went' WHEN 'O' THEN 'shortened' ELSE 'skipped' END AS outcome,
         o_orderkey % 61 AS minutes, o_custkey % 4 AS reached, o_orderpriority AS species
  FROM orders)"""
READINGS_SQL = "readings AS (SELECT CAST(user_id % 20 AS INTEGER) AS station, date_trunc('hour', ts) AS t, event_type AS parameter, value FROM events)"
