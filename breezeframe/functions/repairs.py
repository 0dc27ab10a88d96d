"""Repairs of briefings in a fixed order, and the short note that replaces a cheerful text on a bad day.

Facts are the struct of `contract.FACTS`. A NULL text stays NULL with no repairs; without a
chosen place no names are replaced; texts are searched sentence by sentence, so in linear time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import contract as co
from . import text as tx

# Limits, phrases and sentences of the rules.
LIMIT = 120
HEDGES = ("medical", "cure", "guaranteed safe", "guaranteed", "you will be fine", "completely safe", "safe to do anything", "doctor's advice")
FOREIGN = ("fall colors", "fall colours", "fall foliage", "New England", "autumn leaves", "snow", "frost", "blizzard", "icicle", "ski")
AIR_MARKS = ("naqi", "aqi", "air is", "air quality", "unhealthy", "moderate", "poor", "hazardous", "dust", "pollut", "asthma", "smoke", "clean enough")
SKIP_MARKS = ("stay in", "don't go", "do not go", "skip", "wait", "indoors", "not going")
OUTING = r"(?i)\b(?:go walking|go for a walk|venture outside|head outside)\b"
GRAVE = ("unsafe_invitation", "premature_pocket_mode", "wrong_naqi", "wrong_apparent_c", "wrong_precip_mm", "wrong_precip_prob", "heat_contradiction", "rain_contradiction")
NO_REASON = "conditions are poor"
STAY = ("Stay in today. ", " Air is NAQI ", " No walk worth the trouble -- try again tomorrow or check the evening window. Not a doctor, just someone reading the numbers honestly.")
READING = (" Air right now is Indian NAQI ", " -- informational, not medical advice.")
WALK = {
    "wait": "Hold off until ",
    "go": "Go at ",
    "poor": (" Air is poor (NAQI ", "), so keep it easy and stay on quieter paths."),
    "moderate": " Air is in the moderate band (Indian NAQI ",
    "good": (" Air is in the ", " band (Indian NAQI "),
    "feels": (" It is ", "C but feels like "),
    "around": " Around ",
    "rain": "% chance of rain, so take a light layer.",
    "cue": "Find one thing in the park you have never noticed before.",
    "end": " Pocket the phone and let it be boring for twenty minutes.",
}


def whole(x: Column) -> Column:
    return F.bround(x, 0).cast("long").cast("string")


def any_of(text: Column, marks: Iterable[str]) -> Column:
    """Whether a text holds one of some lower-case marks, in any case."""
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(low, m))


def without_sentences(text: Column, phrases: Iterable[str], ended: bool) -> Column:
    """What lies between full stops goes if it holds one of the phrases as whole words; with `ended` only if a full stop ends it."""
    says = r"(?i)\b(?:" + "|".join(phrases) + r")\b"
    goes = lambda s: s.rlike(says) & (s.endswith(".") if ended else F.lit(True))
    return F.array_join(F.filter(F.split(text, r"(?<=\.)"), lambda s: ~goes(s)), "")


def even_spaces(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s{2,}", " "), r"^\s+|\s+$", "")


def shortened(text: Column) -> Column:
    """At most LIMIT words, by whole sentences where there are any; marks before the dots of a hard cut go."""
    cut = tx.trim_words(text, LIMIT)
    return F.when(F.size(tx.words(text)) > LIMIT, F.regexp_replace(cut, r"[,;:-]+\.\.\.$", "...")).otherwise(cut)


def own_places(text: Column, chosen: Column, places: Column) -> Column:
    """Names of other places become the chosen one's, the longest first; names within the chosen name stay."""
    others = F.filter(F.coalesce(places, F.array().cast("array<string>")), lambda p: (p != "") & ~F.contains(F.lower(chosen), F.lower(p)))
    by_length = F.transform(F.array_sort(F.transform(others, lambda p: F.struct((-F.length(p)).alias("k"), p.alias("p")))), lambda s: s["p"])
    literal = lambda p: F.regexp_replace(p, r"([^\w\s])", "\\\\$1")
    name = F.regexp_replace(chosen, r"([\\$])", "\\\\$1")
    put = lambda s, p: F.regexp_replace(s, F.concat(F.lit(r"\b"), literal(p), F.lit(r"\b(\s+(?:Park|Lake|Gardens?))?")), name)
    return F.when(chosen.isNull(), text).otherwise(F.aggregate(by_length, text, put))


def grounded(text: Column, chosen: Column, places: Column) -> Column:
    """Only the chosen place is named, and no weather of another climate."""
    return F.when(chosen.isNull(), text).otherwise(even_spaces(without_sentences(own_places(text, chosen, places), FOREIGN, False)))


def stay_note(reason: Column, naqi: Column, band: Column) -> Column:
    air = F.when(naqi.isNotNull(), F.concat(F.lit(STAY[1]), whole(naqi), F.lit(" ("), F.coalesce(band, F.lit("")), F.lit(").")))
    return F.concat(F.lit(STAY[0]), F.coalesce(reason, F.lit(NO_REASON)), F.lit("."), F.coalesce(air, F.lit("")), F.lit(STAY[2]))


def walk_note(decision: Column, window: Column, place: Column, naqi: Column, band: Column, temp: Column, apparent: Column, rain: Column, reason: Column) -> Column:
    """The short writer: when to go, the air, the warmth, the rain and where to; on a bad day why to stay."""
    says = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    lead = F.when(decision == "WAIT", F.lit(WALK["wait"])).otherwise(F.lit(WALK["go"]))
    air = F.when(naqi >= 200, says(WALK["poor"][0], whole(naqi), ", ", band, WALK["poor"][1])).when(naqi >= 100, says(WALK["moderate"], whole(naqi), ").")).otherwise(says(WALK["good"][0], band, WALK["good"][1], whole(naqi), ")."))
    warm = F.when(F.abs(apparent - temp) >= 1.5, says(WALK["feels"][0], whole(temp), WALK["feels"][1], whole(apparent), "C.")).otherwise(says(WALK["around"], whole(temp), "C."))
    wet = F.when(rain >= 30, says(" ", whole(rain), WALK["rain"]))
    maybe = lambda c: F.coalesce(c, F.lit(""))
    walk = says(lead, F.coalesce(window, F.lit("shortly")), ".", maybe(air), maybe(warm), maybe(wet), " Head to ", F.coalesce(place, F.lit("your nearest park")), ". Once you are out: ", WALK["cue"], WALK["end"])
    return F.when(decision == "SKIP", stay_note(reason, naqi, band)).otherwise(walk)


def with_repairs(df: DataFrame, variant: Column, text: str = "text", facts: str = "facts") -> DataFrame:
    """Adds `codes`, the defects of a text as it came, `repaired`, and `repairs`, the names of what was done, in order.

    1. `fallback`: where no walk is allowed, a text invites to one although the decision is not to go, or
       it has a grave defect, the contract's own prose (of this variant) replaces it, and 2 to 4 are left out.
    2. `skip_tone`: a text that does not sound like staying in becomes the note that does.
    3. `hedging`: sentences with promises go. Before 4, as the words added there would go with them.
    4. `reading`: a text that says nothing on the air gets the reading, if there is one.
    5. `places`: names of other places and foreign weather go, whoever wrote the text.
    """
    f = F.col(facts)
    rows = co.with_defects(df, text, facts)
    not_go = F.coalesce(f.decision != "GO", F.lit(True))
    falls = ~F.coalesce(f.walk_allowed, F.lit(True)) | (not_go & F.col(text).rlike(OUTING)) | F.arrays_overlap("codes", F.array(*map(F.lit, GRAVE)))
    rows = rows.withColumn("_falls", F.coalesce(falls, F.lit(False))).withColumn("_short", shortened(F.col(text)))
    cheers = (f.decision == "SKIP") & ~any_of(F.col("_short"), SKIP_MARKS)
    rows = rows.withColumn("_cheers", F.coalesce(cheers, F.lit(False)))
    rows = rows.withColumn("_toned", F.when(F.col("_cheers"), stay_note(F.lit(None).cast("string"), f.naqi, f.band)).otherwise(F.col("_short")))
    rows = rows.withColumn("_sober", even_spaces(without_sentences(F.col("_toned"), HEDGES, True)))
    silent = ~any_of(F.col("_sober"), AIR_MARKS) & f.naqi.isNotNull()
    rows = rows.withColumn("_silent", F.coalesce(silent, F.lit(False)))
    reading = F.concat("_sober", F.lit(READING[0]), whole(f.naqi), F.lit(", "), F.lower(F.coalesce(f.band, F.lit(""))), F.lit(READING[1]))
    rows = rows.withColumn("_told", shortened(F.when(F.col("_silent"), F.trim(reading)).otherwise(F.col("_sober"))))
    rows = rows.withColumn("_told", F.when(F.col("_falls"), co.template(f, variant)).otherwise(F.col("_told")))
    rows = rows.withColumn("repaired", F.when(F.col(text).isNotNull(), grounded(F.col("_told"), f.park, f.allowed_park_names)))
    names = {"fallback": F.col("_falls"), "skip_tone": F.col("_cheers") & ~F.col("_falls"), "hedging": (F.col("_sober") != F.col("_toned")) & ~F.col("_falls"), "reading": F.col("_silent") & ~F.col("_falls"), "places": F.col("repaired") != F.col("_told")}
    done = F.array_compact(F.array(*[F.when(on & F.col(text).isNotNull(), F.lit(k)) for k, on in names.items()]))
    return rows.withColumn("repairs", done).drop("_falls", "_short", "_cheers", "_toned", "_sober", "_silent", "_told")
