"""Stream queries: run to the end of what is there, with the windows still open then. Their batch forms have SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import adapters as ad
from ..streaming import hourly as st
from ..streaming import trailing as tr
from ..streaming.log import AppendLog, write_into
from . import hourly as h
from .hourly import query, r6, rounded
from .sql import TRAILING_SQL, with_views


@query()
def stream_hourly(spark, d):
    out = st.drained(spark, d, st.hourly_windows, st.in_open_hours)
    return out.select(F.col("w.start").alias("start"), "event_type", "n", rounded(F.col("total"), 4).alias("total"))


@query()
def stream_sessions(spark, d):
    out = st.drained(spark, d, st.sessions, st.of_open_sessions)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def batch_hourly(spark, d):
    g = st.hourly_windows(ad.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", rounded(F.col("total"), 4).alias("total"))


@query(
    """WITH a AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
s AS (SELECT *, sum(CASE WHEN b IS NULL OR ts - b > INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k"""
)
def batch_sessions(spark, d):
    g = st.sessions(ad.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


# --- readings that arrive hour by hour, those of hour 5 three hours late

#: Parts that the readings arrive in; the stream is stopped and restarted in between.
PARTS = 4
_NUMBER = "CAST(floor(epoch(t) / 3600) AS BIGINT)"
_ARRIVAL_SQL = f"arr AS (SELECT *, 2 * {_NUMBER} + CASE WHEN hour(t) = 5 THEN 7 ELSE 0 END AS arrival FROM air0), judged AS (SELECT *, coalesce(t <= max(t) OVER (PARTITION BY series ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS refused FROM arr)"
ACCEPTED_SQL = TRAILING_SQL.replace(ad.AIR_SQL, f"{ad.AIR_SQL.replace('air AS', 'air0 AS', 1)}, {_ARRIVAL_SQL}, air AS (SELECT * FROM judged WHERE NOT refused)")


def arriving(spark, d):
    """READINGS of the air hours."""
    late = F.when(F.hour("t") == 5, 7).otherwise(0)
    return ad.air(spark, d).withColumn("arrival", (2 * h.se.hour_number(F.col("t")) + late).cast("long"))


def streamed_trailing(spark, d):
    """(accepted, refused): logs of a stream over the readings, restarted from its checkpoint after each part."""
    folder = f"{ad.shared_folder(spark)}/{spark.sparkContext.applicationId}/trailing-{uuid.uuid4().hex}"
    rows = arriving(spark, d)
    first, last = rows.agg(F.min("arrival"), F.max("arrival")).first()
    part = F.floor((F.col("arrival") - (first or 0)) * PARTS / ((last or 0) - (first or 0) + 1)).cast("int")
    accepted, refused = (AppendLog(f"{folder}/{name}", tr.ROWS, "parquet") for name in ("accepted", "refused"))
    for k in range(PARTS):
        rows.where(part == k).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(tr.READINGS).parquet(f"{folder}/in")
        write_into(tr.trailing_rows(stream), {accepted: ~F.col("refused"), refused: F.col("refused")}, f"{folder}/checkpoint").awaitTermination()
    return accepted.read(spark), refused.read(spark)


@query(with_views(ACCEPTED_SQL, "SELECT series, t, round(instant, 6) AS instant, round(trail, 6) AS trail, trailing_hours::BIGINT AS trailing_hours, round(effective, 6) AS effective, band_e FROM tr"))
def stream_trailing(spark, d):
    """The trailing index by state over a stream: equal to the batch operator over the rows that came in time."""
    accepted, _ = streamed_trailing(spark, d)
    return tr.trailing_index(accepted).select("series", "t", r6("instant"), r6("trail"), F.col("trailing_hours").cast("long").alias("trailing_hours"), r6("effective"), "band_e")


@query(f"WITH {ad.AIR_SQL.replace('air AS', 'air0 AS', 1)}, {_ARRIVAL_SQL} SELECT series, t, arrival FROM judged WHERE refused")
def stream_refused(spark, d):
    """The rows that came after a later hour of their series."""
    return streamed_trailing(spark, d)[1].select("series", "t", "arrival")


@query(with_views(ad.JOURNAL_SQL, "SELECT entry::BIGINT AS entry, outcome, minutes::BIGINT AS minutes, reached::BIGINT AS reached, species FROM journal"))
def journal_log(spark, d):
    """The journal written to an append-only log in batches by entry, one of them delivered twice."""
    log = AppendLog(f"{ad.shared_folder(spark)}/{spark.sparkContext.applicationId}/journal-{uuid.uuid4().hex}", "entry long, outcome string, minutes long, reached long, species string")
    rows = ad.journal(spark, d)
    for batch in (0, 1, 1, 2):
        log.append(rows.where(F.pmod("entry", F.lit(3)) == batch), batch)
    return log.read(spark).drop("batch")
