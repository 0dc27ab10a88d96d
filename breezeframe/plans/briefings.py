"""Queries over briefings: the facts of an hour, prose that states them, and the defects of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contract as co
from ..functions import index as ix
from ..functions import policy as po
from ..sources import adapters as ad
from . import hourly as h
from .hourly import POLICY_SQL, query, rounded
from .sql import with_views

#: A series' place is the region of its number; the five of them are the places that a text may confuse.
_EVEN = "round_even(floor({0} * 1000000.0::DOUBLE + 0.501::DOUBLE) / 1000000.0::DOUBLE, {1})"
_IMPACT = "CASE band_e " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(ix.BAND_TEXT)) + " END"
FACTS_SQL = f"""{POLICY_SQL},
facts AS (SELECT series, t, ['GO', 'WAIT', 'SKIP'][CASE WHEN apparent_c IS NULL OR precip_mm IS NULL THEN 2 ELSE rank END + 1] AS decision, r_name AS park, {_EVEN.format('effective', 0)} AS naqi, {ix.band_sql('band_e')} AS band,
  {_EVEN.format('apparent_c', 0)} AS apparent_c, {_EVEN.format('precip_mm', 1)} AS precip_mm, {_EVEN.format('precip_prob', 0)} AS precip_prob, coalesce(is_day, 0) = 1 AS is_day, strftime(t, '%H:%M') AS time,
  effective IS NOT NULL AS air_available, apparent_c IS NOT NULL AND precip_mm IS NOT NULL AS weather_available, weather_code, {_IMPACT} AS health_impact
  FROM pol JOIN region ON r_regionkey = series)"""


def with_facts(spark, d):
    """(series, t, facts): an hour's facts; incomplete weather is a skip, numbers are rounded half to even."""
    even = lambda c, n: F.bround(rounded(F.col(c)), n)
    known = F.col("apparent_c").isNotNull() & F.col("precip_mm").isNotNull()
    # Five regions by definition.
    region = ad.table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("series"), F.col("r_name").alias("park"))
    names = F.broadcast(region.agg(F.array_sort(F.collect_list("park")).alias("names")))
    rows = h.decided(spark, d).join(F.broadcast(region), "series").join(names, F.lit(True))
    given = {
        "decision": po.decision_name(F.when(known, F.col("rank")).otherwise(2)), "park": F.col("park"), "naqi": even("effective", 0), "band": ix.band(F.col("band_e")),
        "apparent_c": even("apparent_c", 0), "precip_mm": even("precip_mm", 1), "precip_prob": even("precip_prob", 0), "is_day": F.coalesce(F.col("is_day"), F.lit(0)) == 1,
        "time": F.date_format("t", "HH:mm"), "air_available": F.col("effective").isNotNull(), "weather_available": known, "weather_code": F.col("weather_code"),
        "walk_allowed": F.lit(None).cast("boolean"), "scheduled_time": F.lit(None).cast("string"), "health_impact": F.get(F.array(*map(F.lit, ix.BAND_TEXT)), F.col("band_e")), "allowed_park_names": F.col("names"),
    }
    return rows.select("series", "t", F.struct(*[v.alias(k) for k, v in given.items()]).alias("facts"))


def templates(spark, d):
    return with_facts(spark, d).withColumn("text", co.template(F.col("facts"), F.hour("t") % 3))


@query(with_views(FACTS_SQL, "SELECT * FROM facts"))
def briefing_facts(spark, d):
    return with_facts(spark, d).select("series", "t", "facts.*").drop("walk_allowed", "scheduled_time", "allowed_park_names")


def _template_sql() -> str:
    general = lambda c: f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
    pick = lambda choices: "[" + ", ".join(f"'{c}'" for c in choices) + "][hour(t) % 3 + 1]"
    opening = "CASE decision " + " ".join(f"WHEN '{k}' THEN {pick(v)}" for k, v in co.OPENINGS.items()) + " END"
    return f"""SELECT series, t, concat_ws(' ', {opening},
  CASE WHEN naqi IS NOT NULL THEN 'Indian NAQI is ' || {general('naqi')} || ', in the ' || band || ' band.' ELSE 'The air-quality reading is unavailable, so we cannot assess the air.' END,
  'It feels like ' || {general('apparent_c')} || ' C.', 'Expected rain is ' || {general('precip_mm')} || ' mm this hour.', 'The chance of rain is ' || {general('precip_prob')} || '%.',
  CASE WHEN weather_code IN (95, 96, 99) THEN 'A thunderstorm is forecast.' END, CASE WHEN NOT weather_available THEN 'Weather information is incomplete; do not assume conditions are clear.' END,
  CASE WHEN NOT is_day THEN 'It is night; park gates may be closed.' END, CASE WHEN decision = 'GO' THEN 'Consider ' || park || '.' END,
  CASE WHEN decision = 'GO' THEN {pick(co.CLOSINGS)} ELSE 'A later forecast must be checked before making another plan.' END,
  CASE WHEN decision <> 'GO' AND band IN ('moderate', 'poor', 'severe', 'hazardous') THEN health_impact END) AS text FROM facts"""


@query(with_views(FACTS_SQL, _template_sql()))
def briefing_templates(spark, d):
    return templates(spark, d).select("series", "t", "text")


@query()
def briefing_messages(spark, d):
    """The facts as the canonical JSON of a prompt."""
    return with_facts(spark, d).select("series", "t", co.message(F.col("facts")).alias("message"))


def judged(spark, d):
    """(series, t, kind, codes): every template, as it is and spoiled in four ways, with its defects."""
    text = F.col("text")
    kinds = {
        "plain": text,
        "certified": F.concat(text, F.lit(" The air is clean.")),
        "invented": F.concat(text, F.lit(" Take a 20 minute walk.")),
        "flipped": F.regexp_replace(text, "^(WAIT|SKIP)", "GO"),
        "cut": F.regexp_extract(text, r"^[^.]*\.[^.]*\.", 0),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("text")) for k, v in kinds.items()]))
    return co.with_defects(templates(spark, d).select("series", "t", "facts", each.alias("_e")).select("series", "t", "facts", "_e.*"))


@query()
def briefing_defects(spark, d):
    codes = F.col("codes")
    return judged(spark, d).select("series", "t", "kind", F.array_join(codes, ",").alias("codes"), F.array_join(co.unsafe(codes), ",").alias("safety"), (F.size(codes) == 0).alias("accepted"))


@query()
def briefing_summary(spark, d):
    """Per kind of text and code: texts, those accepted, those with safety errors, those with the code, and the share that falls back."""
    one = judged(spark, d).select("kind", "codes", (F.size("codes") == 0).alias("ok"), (F.size(co.unsafe(F.col("codes"))) > 0).alias("unsafe"))
    whole = one.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("ok").alias("accepted"), F.count_if("unsafe").alias("unsafe"), rounded(F.avg((~F.col("ok")).cast("double"))).alias("fallback_rate"))
    per = one.select("kind", F.explode("codes").alias("code")).groupBy("kind", "code").agg(F.count("*").alias("with_code"))
    return whole.join(per, "kind", "left")
