"""Queries that read feeds: payloads, journals, station feeds, tables in Markdown, built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import index as ix
from ..functions import weather as we
from ..operators import series as se
from ..sources import adapters as ad
from ..sources import payloads as pl
from . import hourly as h
from .hourly import query, rounded
from .sql import SLOTS_SQL, with_views


def payloads(spark, d, swapped: bool = False):
    """(series, day, payload): a day's hours as columnar JSON whose last pm10 is missing; on every fifth day the first two hours may be swapped."""
    day = F.to_date("t")
    hours = F.array_sort(F.collect_list(F.struct("t", "pm25", "pm10")))
    g = ad.air(spark, d).groupBy("series", day.alias("day")).agg(hours.alias("h"))
    if swapped:
        two = F.concat(F.array(F.get("h", 1), F.get("h", 0)), F.slice("h", 3, 24))
        g = g.withColumn("h", F.when((F.dayofmonth("day") % 5 == 0) & (F.size("h") > 1), two).otherwise(F.col("h")))
    hourly = F.struct(F.transform("h", lambda x: F.date_format(x["t"], "yyyy-MM-dd'T'HH:mm")).alias("time"), F.col("h.pm25").alias("pm25"), F.slice(F.col("h.pm10"), F.lit(1), F.size("h") - 1).alias("pm10"))
    return g.select("series", "day", F.to_json(F.struct(F.lit(19800).alias("utc_offset_seconds"), hourly.alias("hourly"))).alias("payload"))


_LAST_OF_DAY = "row_number() OVER (PARTITION BY series, CAST(t AS DATE) ORDER BY t DESC) = 1"


@query(with_views(ad.AIR_SQL, f"SELECT series, t, round(pm25, 6) AS pm25, round(CASE WHEN {_LAST_OF_DAY} THEN NULL ELSE pm10 END, 6) AS pm10 FROM air"))
def payload_rows(spark, d):
    rows = pl.payload_rows(payloads(spark, d))
    return rows.select("series", F.col("time").alias("t"), rounded(F.col("pm25")).alias("pm25"), rounded(F.col("pm10")).alias("pm10"))


_P = f"p AS (SELECT series, t, pm25, CASE WHEN {_LAST_OF_DAY} THEN NULL ELSE pm10 END AS pm10 FROM air)"
_PS = f"q AS (SELECT series, t, {ix.sub_index_sql('pm25', 'pm25')} AS s_pm25, {ix.sub_index_sql('pm10', 'pm10')} AS s_pm10 FROM p)"


@query(with_views(f"{ad.AIR_SQL}, {_P}, {_PS}", "SELECT series, t, round(s_pm25, 6) AS s_pm25, round(s_pm10, 6) AS s_pm10, round(greatest(s_pm25, s_pm10), 6) AS instant FROM q"))
def payload_index(spark, d):
    """Payload hours with their index; a payload out of order is refused as a whole."""
    checked = pl.order_violations(payloads(spark, d))
    sound = checked.withColumn("payload", F.when(F.col("violations") == 0, F.col("payload")).otherwise(F.raise_error(F.lit("hours out of order"))))
    rows = pl.payload_rows(sound).withColumnRenamed("time", "t").withColumns({k: F.lit(None).cast("double") for k in ("no2", "o3", "co")})
    return se.with_index(rows).select("series", "t", h.r6("s_pm25"), h.r6("s_pm10"), h.r6("instant"))


@query(with_views(ad.AIR_SQL, "SELECT series, CAST(t AS DATE) AS day, CASE WHEN day(t::DATE) % 5 = 0 AND count(*) > 1 THEN 1 ELSE 0 END::BIGINT AS violations FROM air GROUP BY series, CAST(t AS DATE), day(t::DATE)"))
def order_check(spark, d):
    """Hours that were sent out of order, by payload."""
    return pl.order_violations(payloads(spark, d, swapped=True)).select("series", "day", "violations")


@query(with_views(ad.AIR_SQL, "SELECT series, t, t - INTERVAL 19800 SECOND AS utc FROM air"))
def payload_utc(spark, d):
    """Local hours of a payload in universal time, by the offset that it tells."""
    rows = pl.payload_rows(payloads(spark, d))
    return rows.select("series", F.col("time").alias("t"), (F.col("time") - F.make_dt_interval(secs=F.col("offset").cast("decimal(18,6)"))).alias("utc"))


@query(with_views(ad.AIR_SQL, """SELECT series, t FROM (SELECT a.series, a.t, row_number() OVER (PARTITION BY a.series ORDER BY CASE WHEN t + INTERVAL 1 HOUR > now THEN 0 ELSE 1 END, t) AS k, count(CASE WHEN t + INTERVAL 1 HOUR > now THEN 1 END) OVER (PARTITION BY a.series) AS left_, t + INTERVAL 1 HOUR > now AS ahead
FROM air a JOIN (SELECT series, max(t) + CASE WHEN series % 2 = 0 THEN INTERVAL '-210 minutes' ELSE INTERVAL '6000 minutes' END AS now FROM air GROUP BY series) n USING (series)) WHERE k <= 4 AND (ahead OR left_ = 0)"""))
def slice_from_now(spark, d):
    """Four hours from the one that contains now; where all are past, the first four."""
    air = ad.air(spark, d).select("series", "t")
    now = air.groupBy("series").agg(F.max("t").alias("now")).withColumn("now", F.col("now") + F.make_dt_interval(mins=F.when(F.col("series") % 2 == 0, -210).otherwise(6000)))
    rows = air.join(now, "series").withColumn("ahead", F.col("t") + F.make_dt_interval(hours=F.lit(1)) > F.col("now"))
    one = W.partitionBy("series")
    rows = rows.withColumns({"k": F.row_number().over(one.orderBy(F.when(F.col("ahead"), 0).otherwise(1), "t")), "left": F.count_if("ahead").over(one)})
    return rows.where("k <= 4 AND (ahead OR left = 0)").select("series", "t")


@query(with_views(SLOTS_SQL, "SELECT series, t, coalesce(temp_c, 21.5) AS temp_c, CASE WHEN temp_c IS NULL THEN 'fixture' ELSE 'live' END AS source FROM slots"))
def fixture_fallback(spark, d):
    """Each hour's weather from the live feed, or else from the recorded one, with where it came from."""
    key = ["series", "t"]
    live = ad.weather(spark, d).select(*key, "temp_c", F.lit("live").alias("source"), F.lit(0).alias("rank"))
    hours = ad.air(spark, d).select(*key)
    recorded = hours.select(*key, F.lit(21.5).alias("temp_c"), F.lit("fixture").alias("source"), F.lit(1).alias("rank"))
    best = live.join(hours, key, "left_semi").unionByName(recorded).groupBy(*key).agg(F.min_by(F.struct("temp_c", "source"), "rank").alias("b"))
    return best.select(*key, "b.temp_c", "b.source")


@query("SELECT o_orderkey::VARCHAR AS entry, o_orderstatus AS outcome, (o_orderkey % 61)::VARCHAR AS minutes, CASE WHEN o_orderkey % 3 = 0 THEN '{\"mood\":\"' || o_orderpriority || '\"}' END AS extra FROM orders WHERE o_orderkey % 7 <> 0")
def journal_scan(spark, d):
    """Journal lines: every seventh is broken and goes, unknown keys are kept apart."""
    o = ad.table(spark, d, "orders")
    entry = F.to_json(F.struct(F.col("o_orderkey").alias("entry"), F.col("o_orderstatus").alias("outcome"), (F.col("o_orderkey") % 61).alias("minutes"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("mood")))
    lines = o.select(F.when(F.col("o_orderkey") % 7 == 0, F.substring(entry, 1, 12)).otherwise(entry).alias("line"))
    return pl.journal_entries(lines)


@query(with_views(ad.PARKS_SQL, """SELECT name, round(CASE WHEN geo THEN km END, 6) AS km, aqi, pm25 FROM (SELECT name, park_id % 7 <> 3 AS geo, CASE WHEN park_id % 5 = 0 THEN NULL ELSE park_id % 400 END AS aqi,
  CASE WHEN park_id % 2 = 0 THEN (park_id % 90)::DOUBLE + 0.5::DOUBLE END AS pm25,
  2 * 6371.0 * asin(sqrt(pow(sin(radians(lat * 3 - 26) / 2 - radians(12.97) / 2), 2) + cos(radians(12.97)) * cos(radians(lat * 3 - 26)) * pow(sin(radians(lon - 77.59) / 2), 2))) AS km FROM parks) WHERE (aqi IS NOT NULL OR pm25 IS NOT NULL) AND (NOT geo OR km <= 60)"""))
def station_feed(spark, d):
    """Stations of a feed whose city is an object or a list, with a usable reading and near enough; every seventh tells no place, some only a particle reading."""
    p = ad.parks(spark, d).withColumn("lat", F.col("lat") * 3 - 26)
    geo = F.when(F.col("park_id") % 7 != 3, F.array("lat", "lon"))
    city = F.struct("name", geo.alias("geo"))
    aqi = F.when(F.col("park_id") % 5 == 0, F.lit("-")).otherwise((F.col("park_id") % 400).cast("string"))
    own = F.struct(F.when(F.col("park_id") % 2 == 0, F.col("park_id") % 90 + 0.5).alias("pm25"))
    said = lambda c: F.to_json(F.struct(F.struct(aqi.alias("aqi"), c.alias("city"), own.alias("iaqi")).alias("data")))
    rows = pl.station_rows(p.select(F.when(F.col("park_id") % 2 == 0, said(city)).otherwise(said(F.array(city))).alias("line")))
    near = pl.usable_stations(rows, we.haversine(F.lit(12.97), F.lit(77.59), F.col("lat"), F.col("lon")))
    return near.select("name", rounded(F.col("km")).alias("km"), "aqi", "pm25")


@query("""SELECT n_nationkey::BIGINT AS row, place, cell, number FROM (SELECT n_nationkey, 0 AS place, n_name AS cell, NULL::DOUBLE AS number FROM nation
UNION ALL SELECT n_nationkey, 1, '**' || n_regionkey || ',000**', n_regionkey * 1000.0::DOUBLE FROM nation UNION ALL SELECT n_nationkey, 2, n_nationkey || '.5%', n_nationkey + 0.5::DOUBLE FROM nation)""")
def markdown_cells(spark, d):
    """Cells of a table in Markdown with their numbers."""
    n = ad.table(spark, d, "nation")
    line = F.concat(F.lit("| "), "n_name", F.lit(" | **"), "n_regionkey", F.lit(",000** | "), "n_nationkey", F.lit(".5% |"))
    rule = spark.createDataFrame([(-1, "|---|:--:|---|"), (-2, "no table")], "row long, line string")
    return pl.table_cells(n.select(F.col("n_nationkey").cast("long").alias("row"), line.alias("line")).unionByName(rule))


@query("SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS level, TRY_CAST(o_orderpriority AS DOUBLE) AS whole FROM orders")
def value_casts(spark, d):
    """Values that may be numbers, text or nothing."""
    o = ad.table(spark, d, "orders")
    return o.select("o_orderkey", F.substring("o_orderpriority", 1, 1).try_cast("long").alias("level"), F.col("o_orderpriority").try_cast("double").alias("whole"))


@query("SELECT o_orderkey, greatest(5, least(180, o_orderkey % 300))::BIGINT AS minutes, (greatest(5, least(180, o_orderkey % 300)) * 60)::BIGINT AS seconds, (greatest(5, least(180, o_orderkey % 300)) // 60) || ' h ' || lpad((greatest(5, least(180, o_orderkey % 300)) % 60)::VARCHAR, 2, '0') || ' min' AS label FROM orders")
def walk_timer(spark, d):
    """Minutes of a walk within their bounds, as seconds of a timer and as a label."""
    minutes = F.greatest(F.lit(5), F.least(F.lit(180), F.col("o_orderkey") % 300))
    label = F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit(" min"))
    return ad.table(spark, d, "orders").select("o_orderkey", minutes.cast("long").alias("minutes"), (minutes * 60).cast("long").alias("seconds"), label.alias("label"))


@query()
def file_pins(spark, d):
    """Digests of the small input files; their paths are not the other engine's to know."""
    return pl.file_pins(spark, [f"{d}/{t}.parquet" for t in ("region", "nation")])
