"""Queries over repaired briefings and the short writer's notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contract as co
from ..functions import index as ix
from ..functions import policy as po
from ..functions import repairs as re_
from ..sources import adapters as ad
from . import hourly as h
from .briefings import _EVEN, templates
from .hourly import POLICY_SQL, query, rounded
from .sql import with_views


def drafts(spark, d):
    """(series, t, facts, kind, text): every template as a draft, as it is and spoiled in the ways that the chain repairs; names of all places follow each other in one kind."""
    text, f = F.col("text"), F.col("facts")
    first_two = F.regexp_extract(text, r"^[^.]*\.[^.]*\.", 0)
    kinds = {
        "plain": text,
        "outing": F.concat(text, F.lit(" Then go for a walk.")),
        "wrong_number": F.concat(text, F.lit(" The NAQI is 499.")),
        "cheerful": F.lit("A lovely hour for the garden. You will be fine."),
        "promise": F.concat(F.lit("Maybe skip it, or wait. It is guaranteed. "), first_two),
        "foreign": F.concat(F.lit("Wait for "), F.array_join(f.allowed_park_names, " Park or "), F.lit(". Mind the snow today. Dust is about.")),
        "long": F.concat(F.lit("Wait a bit. "), F.repeat(F.lit("and so on, "), 60)),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("text")) for k, v in kinds.items()]))
    return templates(spark, d).select("series", "t", "facts", each.alias("_e")).select("series", "t", "facts", "_e.*")


@query()
def briefing_repairs(spark, d):
    """Each draft after the chain, what was done, and the codes that it has then."""
    done = re_.with_repairs(drafts(spark, d), F.hour("t") % 3).drop("codes", "text")
    after = co.with_defects(done, "repaired")
    return after.select("series", "t", "kind", "repaired", F.array_join("repairs", ",").alias("repairs"), F.array_join(co.unsafe(F.col("codes")), ",").alias("safety"))


_N = {k: _EVEN.format(c, 0) for k, c in {"n": "effective", "t": "temp_c", "a": "apparent_c", "p": "precip_prob"}.items()}
_INT = {k: f"CAST(CAST({v} AS BIGINT) AS VARCHAR)" for k, v in _N.items()}
_NOTES = f"""SELECT series, t, CASE WHEN rank = 2 THEN '{re_.STAY[0]}' || coalesce(reasons[1], '{re_.NO_REASON}') || '.' || coalesce('{re_.STAY[1]}' || {_INT['n']} || ' (' || {ix.band_sql('band_e')} || ').', '') || '{re_.STAY[2]}'
  ELSE CASE WHEN rank = 1 THEN '{re_.WALK["wait"]}' ELSE '{re_.WALK["go"]}' END || strftime(t, '%H:%M') || '-' || strftime(t + INTERVAL 1 HOUR, '%H') || ':00.'
  || coalesce(CASE WHEN {_N['n']} >= 200 THEN '{re_.WALK["poor"][0]}' || {_INT['n']} || ', ' || {ix.band_sql('band_e')} || '{re_.WALK["poor"][1]}' WHEN {_N['n']} >= 100 THEN '{re_.WALK["moderate"]}' || {_INT['n']} || ').' ELSE '{re_.WALK["good"][0]}' || {ix.band_sql('band_e')} || '{re_.WALK["good"][1]}' || {_INT['n']} || ').' END, '')
  || coalesce(CASE WHEN abs({_N['a']} - {_N['t']}) >= 1.5 THEN '{re_.WALK["feels"][0]}' || {_INT['t']} || '{re_.WALK["feels"][1]}' || {_INT['a']} || 'C.' ELSE '{re_.WALK["around"]}' || {_INT['t']} || 'C.' END, '')
  || coalesce(CASE WHEN {_N['p']} >= 30 THEN ' ' || {_INT['p']} || '{re_.WALK["rain"]}' END, '') || ' Head to ' || r_name || '. Once you are out: {re_.WALK["cue"]}{re_.WALK["end"]}' END AS note
FROM pol JOIN region ON r_regionkey = series"""


@query(with_views(POLICY_SQL, _NOTES))
def briefing_notes(spark, d):
    """The short writer's note of each hour; its numbers are rounded half to even before they are compared."""
    # Five regions by definition.
    region = F.broadcast(ad.table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("series"), F.col("r_name").alias("place")))
    even = lambda c: F.bround(rounded(F.col(c)), 0)
    window = F.concat(F.date_format("t", "HH:mm"), F.lit("-"), F.date_format(F.col("t") + F.make_dt_interval(hours=F.lit(1)), "HH"), F.lit(":00"))
    note = re_.walk_note(po.decision_name(F.col("rank")), window, F.col("place"), even("effective"), ix.band(F.col("band_e")), even("temp_c"), even("apparent_c"), even("precip_prob"), F.get("reasons", 0))
    return h.decided(spark, d).join(region, "series").select("series", "t", note.alias("note"))
