"""Reading what feeds send: columnar JSON, journals in lines, station feeds, tables in Markdown.

Every reader is a plan over a column of text; text that can't be read gives no row, and
nothing is read on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = "struct<utc_offset_seconds: int, hourly: struct<time: array<string>, pm25: array<double>, pm10: array<double>>>"
#: Columns that a journal entry has of its own; others are kept as `extra`.
JOURNAL_COLUMNS = ("entry", "outcome", "minutes")
CITY = "struct<name: string, geo: array<double>>"


def payload_rows(payloads: DataFrame) -> DataFrame:
    """(series, payload) -> (series, pos, time, pm25, pm10): arrays of unequal length are padded with NULL."""
    h = F.from_json("payload", PAYLOAD)
    zipped = F.arrays_zip(*[h["hourly"][c].alias(c) for c in ("time", "pm25", "pm10")])
    rows = payloads.select("series", h["utc_offset_seconds"].alias("offset"), F.posexplode(zipped).alias("pos", "z"))
    return rows.select("series", "offset", "pos", F.to_timestamp_ntz("z.time", F.lit("yyyy-MM-dd'T'HH:mm")).alias("time"), "z.pm25", "z.pm10")


def order_violations(payloads: DataFrame) -> DataFrame:
    """(series, payload) -> with `violations`: places whose time isn't after the one before, in the order that was sent."""
    times = F.from_json("payload", PAYLOAD)["hourly"]["time"]
    pairs = F.zip_with(F.slice(times, F.lit(1), F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, F.lit(2), F.greatest(F.size(times) - 1, F.lit(0))), lambda a, b: F.when(a >= b, 1))
    return payloads.withColumn("violations", F.size(F.array_compact(pairs)).cast("long"))


def journal_entries(lines: DataFrame) -> DataFrame:
    """(line) -> the journal's columns and `extra`, other keys as JSON; blank and broken lines go."""
    m = F.from_json("line", "map<string, string>")
    rows = lines.where(F.trim("line") != "").withColumn("_m", m).where("_m IS NOT NULL")
    extra = F.map_filter("_m", lambda k, v: ~k.isin(*JOURNAL_COLUMNS))
    return rows.select(*[F.try_element_at("_m", F.lit(c)).alias(c) for c in JOURNAL_COLUMNS], F.when(F.size(extra) > 0, F.to_json(extra)).alias("extra"))


#: Fixed value: a station further away is one of another city.
MAX_STATION_KM = 60.0


def station_rows(feed: DataFrame) -> DataFrame:
    """(line) -> (name, lat, lon, aqi, pm25, pm10): the city is an object or a list of them; readings that are no number are NULL, an index that is no whole number too."""
    data = F.from_json("line", "struct<data: struct<aqi: string, city: string, iaqi: string>>")["data"]
    as_list = F.get(F.from_json(data["city"], f"array<{CITY}>"), 0)
    pick = F.when(data["city"].startswith("["), as_list).otherwise(F.from_json(data["city"], CITY))
    own = F.from_json(data["iaqi"], "struct<pm25: string, pm10: string>")
    place = lambda k: F.when(F.size(pick["geo"]) == 2, F.get(pick["geo"], k))
    return feed.select(pick["name"].alias("name"), place(0).alias("lat"), place(1).alias("lon"), data["aqi"].try_cast("long").alias("aqi"), *[own[k].try_cast("double").alias(k) for k in ("pm25", "pm10")])


def usable_stations(stations: DataFrame, km: Column, most_km: float = MAX_STATION_KM) -> DataFrame:
    """Stations with any reading that are near enough, or whose place isn't known."""
    rows = stations.withColumn("km", km)
    return rows.where("aqi IS NOT NULL OR pm25 IS NOT NULL OR pm10 IS NOT NULL").where(F.col("km").isNull() | (F.col("km") <= most_km))


def table_cells(lines: DataFrame) -> DataFrame:
    """(line) -> (row, place, cell, number) of the lines of a Markdown table, its rule left out."""
    inner = F.regexp_replace(F.trim("line"), r"^\||\|$", "")
    rows = lines.where(F.trim("line").startswith("|") & ~F.trim("line").rlike(r"^\|[\s:|-]+\|$"))
    cells = rows.select("row", F.posexplode(F.split(inner, r"\|")).alias("place", "cell")).withColumn("cell", F.trim("cell"))
    return cells.withColumn("number", numeric(F.col("cell")))


def numeric(cell: Column) -> Column:
    """The number of a cell: marks of emphasis, thousands and percent are taken off; NULL where none is left."""
    return F.regexp_replace(cell, r"[*`,%]", "").try_cast("double")


def file_pins(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(name, bytes, digest) of small files, each read whole."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))
