"""The grounding contract of a briefing: which named defects a text has, given the facts that it may use.

Facts are a struct column with the fields of FACTS. Absent facts are NULL; an absent
`weather_available` or `is_day` counts as true, an absent `air_available` as false.
Digits of a text are compared with the facts as numbers, to six significant digits.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .index import BANDS

FACTS = (
    "decision string, park string, naqi double, band string, apparent_c double, precip_mm double, precip_prob double, is_day boolean, time string, "
    "air_available boolean, weather_available boolean, weather_code int, walk_allowed boolean, scheduled_time string, health_impact string, allowed_park_names array<string>"
)

# Fixed values of the contract: bounds, names, patterns and codes.
LEAST_WORDS, MOST_WORDS = 35, 80
TOLERANCE = 0.051
THUNDER = (95, 96, 99)
MEASURES = {
    "naqi": r"\b(?:indian\s+)?(?:naqi|aqi)\s*(?:is|at|of|[:=])?\s*(\d+(?:\.\d+)?)",
    "apparent_c": r"(?:feels? like|feeling like|apparent temperature(?: is)?)\s*(\d+(?:\.\d+)?)",
    "precip_mm": r"(\d+(?:\.\d+)?)\s*mm\b",
    "precip_prob": r"(\d+(?:\.\d+)?)\s*%",
}
FORMAT = r"[{}\[\]#*]|(?:^|\n)\s*[-•]\s|\n\s*\n"
NEGATED = r"\b(?:do not|don't|never|cannot|can't|not|avoid|skip|postpone)\s+(?:\w+\s+){0,2}(?:go|walk|head|start|use|enter|take|enjoy|visit)\b[^.!?]*"
INVITATION = (
    r"\b(?:go (?:outside|out|now|to|walking)|head (?:out|outside|to)|take (?:a|the) walk|enjoy (?:a|the|your) walk|start (?:walking|pocket mode)|"
    r"(?:use|enter|switch to) pocket mode|walk (?:now|outside)|you (?:can|should|may) (?:go|walk)|conditions permit (?:a )?(?:gentle )?walk|"
    r"a (?:gentle )?walk is (?:an option|fine|safe)|(?:fine|safe|perfect|ideal) (?:for|to take) (?:a )?walk|go (?:for (?:a |the )?walk|ahead and walk)|"
    r"take (?:a |the )?(?:short |gentle )?stroll|visit (?:the )?park)\b"
)
STAY_IN = r"\b(?:stay (?:in|indoors)|skip (?:the|your) (?:outdoor )?walk|do not head out)\b"
PUT_OFF = r"hold off|postpone|wait before|wait for|recheck|check again"
MEDICAL = r"guaranteed|completely safe|perfectly safe|you will be fine|\b(?:cure|treat|prevent)\w*\s+(?:asthma|disease|illness)|\b(?:take|use)\s+(?:an?\s+)?(?:inhaler|medication|medicine)"
LEAK = r"ignore (?:all|previous|the)|system prompt|developer message|as an ai|instruction override"
CLEAN_AIR = r"(?:air|aqi|naqi).{0,20}(?:clean|harmless|safe)|(?:clean|harmless|safe).{0,20}(?:air|aqi|naqi)"
NO_AIR = r"air.{0,35}(?:unavailable|missing|unknown|cannot)|(?:no|missing|unavailable).{0,20}air"
NO_WEATHER = r"weather.{0,40}(?:incomplete|unavailable|missing|unknown)|(?:missing|unavailable|incomplete).{0,20}weather"
COOL = r"\b(?:cool|mild|comfortable|pleasant)\b"
DRY = r"\b(?:dry|no rain|rain.free)\b"
NIGHT = r"night|gates.{0,25}(?:shut|closed)"
PROMISE = r"\b(?:tomorrow|later|evening|morning).{0,30}(?:will be|is going to|will have).{0,20}(?:better|safe|clean|cool|clear)|\b(?:opens?|closes?) at\b"
COSMETIC = ("length", "format", "missing_park", "missing_indian_scale", "missing_air_band")
OPENINGS = {
    "GO": ("GO. A gentle walk is an option now.", "GO. Conditions permit a gentle walk.", "GO. You can consider a gentle walk now."),
    "WAIT": ("WAIT. Hold off on the walk and recheck conditions.", "WAIT. Wait before heading out; check again later.", "WAIT. Postpone the walk for now and recheck."),
    "SKIP": ("SKIP. Stay indoors and skip the outdoor walk.", "SKIP. Skip the walk now and stay indoors.", "SKIP. Stay in; do not head out for a walk."),
}
CLOSINGS = ("Put the phone away with Pocket Mode and notice your surroundings.", "Start Pocket Mode and give your attention to the walk.", "Pocket Mode can keep the screen out of your walk.")


def general(x: Column) -> Column:
    """A number without trailing zeros."""
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))


def template(f: Column, variant: Column) -> Column:
    """Prose that states the facts: one of three openings, a sentence for each fact, and how to go on."""
    go = f.decision == "GO"
    pick = lambda choices: F.get(F.array(*map(F.lit, choices)), variant)
    says = lambda c, before, after: F.when(c.isNotNull(), F.concat(F.lit(before), general(c), F.lit(after)))
    opening = F.coalesce(*[F.when(f.decision == d, pick(choices)) for d, choices in OPENINGS.items()])
    known = F.coalesce(f.air_available, F.lit(False)) & f.naqi.isNotNull()
    recheck = ~go & f.scheduled_time.isNotNull() & (f.scheduled_time != "") & ~F.coalesce(f.walk_allowed, F.lit(True))
    return F.concat_ws(
        " ",
        opening,
        F.when(known, F.concat(F.lit("Indian NAQI is "), general(f.naqi), F.lit(", in the "), f.band, F.lit(" band."))).otherwise(F.lit("The air-quality reading is unavailable, so we cannot assess the air.")),
        says(f.apparent_c, "It feels like ", " C."),
        says(f.precip_mm, "Expected rain is ", " mm this hour."),
        says(f.precip_prob, "The chance of rain is ", "%."),
        F.when(f.weather_code.isin(*THUNDER), F.lit("A thunderstorm is forecast.")),
        F.when(~F.coalesce(f.weather_available, F.lit(True)), F.lit("Weather information is incomplete; do not assume conditions are clear.")),
        F.when(~F.coalesce(f.is_day, F.lit(True)), F.lit("It is night; park gates may be closed.")),
        F.when(go, F.coalesce(F.concat(F.lit("Consider "), f.park, F.lit(".")), F.lit("Choose a nearby park."))),
        F.when(go, pick(CLOSINGS)).otherwise(F.lit("A later forecast must be checked before making another plan.")),
        F.when(recheck, F.concat(F.lit("The next hour to recheck is "), f.scheduled_time, F.lit(". Refresh conditions before walking."))),
        F.when(~go & F.lower(f.band).isin(*BANDS[2:]) & (f.health_impact != ""), f.health_impact),
    )


def _values(low: Column, measure: str) -> Column:
    return F.transform(F.regexp_extract_all(low, F.lit(MEASURES[measure]), F.lit(1)), lambda x: x.cast("double"))


def _grounded(x: Column, permitted: Column) -> Column:
    return F.exists(permitted, lambda p: F.abs(x - p) <= F.abs(p) * 5e-7)


def _checks(f: Column) -> dict[str, Column]:
    """{code: whether the text has that defect} in the order of the contract, over the columns that `with_defects` adds; NULL is no defect."""
    clean, low, affirmative = (F.col(c) for c in ("_clean", "_low", "_affirmative"))
    n = F.size(tx.words(clean))
    go, air = f.decision == "GO", F.coalesce(f.air_available, F.lit(False))
    values = {k: _values(low, k) for k in MEASURES}
    off = lambda k: F.exists(values[k], lambda v: F.coalesce(F.abs(v - f[k]) > TOLERANCE, F.lit(True)))
    hot, wet = f.apparent_c >= 35, f.precip_mm >= 2.5
    park = F.lower(F.coalesce(f.park, F.lit("")))
    clock = lambda c: F.transform(F.split(c, ":"), lambda x: x.cast("double"))
    none = F.array().cast("array<double>")
    recheck = F.when(~F.coalesce(f.walk_allowed, F.lit(True)) & (f.scheduled_time != ""), clock(f.scheduled_time))
    permitted = F.concat(F.array_compact(F.array(*[f[k] for k in MEASURES])), F.coalesce(F.when(f.time != "", clock(f.time)), none), F.coalesce(recheck, none))
    other_band = reduce(or_, [F.coalesce(f.band != b, F.lit(True)) & low.rlike(rf"(?:in the |is ){b}\b") for b in BANDS])
    return {
        "length": ~n.between(LEAST_WORDS, MOST_WORDS),
        "decision": F.coalesce(F.regexp_extract(clean, r"^(GO|WAIT|SKIP)\b", 1) != f.decision, F.lit(True)),
        "format": clean.rlike(FORMAT),
        "unsafe_invitation": ((~go | ~F.coalesce(f.walk_allowed, F.lit(True))) & affirmative.rlike(INVITATION)) | (~go & F.exists(F.coalesce(f.allowed_park_names, F.array().cast("array<string>")), lambda p: F.regexp_like(affirmative, F.concat(F.lit(r"\bvisit\s+\Q"), F.lower(F.get(F.split(p, " "), 0)), F.lit(r"\E"))))),
        "premature_pocket_mode": ~go & affirmative.contains("pocket mode"),
        "contradictory_decision": ~go & clean.rlike(r"\bGO\b"),
        "skip_direction": (f.decision == "SKIP") & ~low.rlike(STAY_IN),
        "wait_direction": (f.decision == "WAIT") & ~low.rlike(PUT_OFF),
        "medical_claim": low.rlike(MEDICAL),
        "instruction_leak": low.rlike(LEAK),
        "air_safety_claim": low.rlike(CLEAN_AIR),
        "wrong_naqi": off("naqi"),
        "missing_naqi": air & (F.size(values["naqi"]) == 0),
        "wrong_apparent_c": off("apparent_c"),
        "wrong_precip_mm": off("precip_mm"),
        "wrong_precip_prob": off("precip_prob"),
        "missing_indian_scale": air & ~low.contains("indian naqi"),
        "missing_air_band": air & (f.band != "") & ~F.regexp_like(low, F.concat(F.lit(r"\b\Q"), f.band, F.lit(r"\E\b"))),
        "wrong_air_band": air & other_band,
        "missing_air_uncertainty": ~air & ~low.rlike(NO_AIR),
        "missing_weather_uncertainty": ~F.coalesce(f.weather_available, F.lit(True)) & ~low.rlike(NO_WEATHER),
        "missing_heat_reason": hot & (F.size(values["apparent_c"]) == 0),
        "heat_contradiction": hot & affirmative.rlike(COOL),
        "missing_rain_reason": wet & (F.size(values["precip_mm"]) == 0),
        "rain_contradiction": wet & affirmative.rlike(DRY),
        "missing_thunderstorm": f.weather_code.isin(*THUNDER) & ~low.contains("thunderstorm"),
        "missing_night_reason": ~F.coalesce(f.is_day, F.lit(True)) & ~low.rlike(NIGHT),
        "wrong_park": F.exists(f.allowed_park_names, lambda p: (F.lower(p) != park) & F.contains(low, F.lower(p))),
        "missing_park": reduce(and_, [go, park != "", ~F.contains(low, park)]),
        "invented_forecast": low.rlike(PROMISE),
        "ungrounded_number": F.exists(tx.numbers(clean), lambda x: ~_grounded(x.cast("double"), permitted)),
    }


def with_defects(df: DataFrame, text: str = "text", facts: str = "facts") -> DataFrame:
    """Adds `codes`: the codes of the defects of a text in the order of the contract, NULL for a NULL text.

    Clauses that negate an invitation are left out before invitations are sought. The
    forms of the text that the checks share are columns of their own, so each is made once.
    """
    df = df.withColumn("_clean", F.regexp_replace(text, r"^\s+|\s+$", ""))
    df = df.withColumn("_low", F.replace(F.lower("_clean"), F.lit("’"), F.lit("'"))).withColumn("_affirmative", F.regexp_replace("_low", NEGATED, ""))
    codes = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in _checks(F.col(facts)).items()]))
    return df.withColumn("codes", F.when(F.col(text).isNotNull(), codes)).drop("_clean", "_low", "_affirmative")


def message(f: Column) -> Column:
    """The facts as canonical JSON: names in order, nulls kept, without the list of known places, which no prompt may hold."""
    names = sorted(part.split()[0] for part in FACTS.split(", ") if not part.startswith("allowed_park_names"))
    whole = ("naqi", "apparent_c", "precip_prob")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    value = lambda n: finite(f[n]).cast("long") if n in whole else finite(f[n]) if n == "precip_mm" else f[n]
    return F.concat(F.lit("Trusted facts:\n"), F.to_json(F.struct(*[value(n).alias(n) for n in names]), {"ignoreNullFields": "false"}))


def unsafe(codes: Column) -> Column:
    """The codes but for those of form."""
    return F.array_except(codes, F.array(*map(F.lit, COSMETIC)))
