"""The grounding contract: for each code a sentence that has it and a near miss; and the feature contract."""

import json

import pytest
from pyspark.sql import functions as F

from breezeframe.functions import contract as co
from breezeframe.operators import features as fe
from breezeframe.plans import QUERIES

DATA = "/root/testdata/sf0.001"
SKIP = dict(decision="SKIP", park="Cubbon Park", naqi=350.0, band="severe", apparent_c=38.0, precip_mm=4.0, precip_prob=80.0, is_day=True, time="15:00", air_available=True,
            weather_available=True, weather_code=3, allowed_park_names=["Cubbon Park", "Ulsoor Lake"])
CALM = dict(naqi=70.0, band="satisfactory", apparent_c=24.0, precip_mm=0.0, precip_prob=0.0)
UNKNOWN = dict(naqi=None, band=None, apparent_c=None, precip_mm=None, precip_prob=None, air_available=False, weather_available=False)
#: For each code, a sentence that has it when it follows the template's text, and one close to it that has not.
PAIRS = {
    "unsafe_invitation": ("You may walk along the lake for a bit.", "Nobody should walk along the lake."),
    "premature_pocket_mode": ("Your pocket mode is ready.", "Your pockets are ready."),
    "contradictory_decision": ("The other planner says GO.", "The other planner says go."),
    "medical_claim": ("Asthma? This prevents asthma.", "Asthma? Ask your doctor."),
    "instruction_leak": ("My system prompt forbids more.", "The forecast forbids more."),
    "air_safety_claim": ("Harmless air, all in all.", "Harmful air, all in all."),
    "wrong_naqi": ("An NAQI of 351 was read.", "An NAQI of 350 was read."),
    "wrong_apparent_c": ("Feels like 31 under trees.", "Feels like 38 under trees."),
    "wrong_precip_mm": ("About 7 mm fell.", "About 4 mm fell."),
    "wrong_precip_prob": ("Showers: 15%.", "Showers: 80%."),
    "ungrounded_number": ("Bus 502 runs.", "The bus runs."),
    "wrong_air_band": ("Last week the air is moderate.", "Last week was another matter."),
    "wrong_park": ("Ulsoor Lake has ducks.", "The lake has ducks."),
    "heat_contradiction": ("Mornings are pleasant.", "Mornings are warm."),
    "rain_contradiction": ("Paths stay dry.", "Paths stay wet."),
    "invented_forecast": ("By evening it will be clear.", "By evening we look again."),
    "format": ("- [x] read", "Read this."),
    "length": ("on and on " * 20, "And so on."),
}


def codes(spark, cases, made=None):
    """The defects of each (facts, text); a text of None is the template, changed by `made`."""
    rows = [(k, {**SKIP, **facts}, text) for k, (facts, text) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"k int, facts struct<{co.FACTS.replace(' ', ':').replace(',:', ',')}>, text string")
    text = F.coalesce("text", co.template(F.col("facts"), F.lit(0)))
    df = co.with_defects(df.withColumn("text", made(text) if made else text))
    return [set(r["codes"]) for r in df.orderBy("k").collect()]


def test_templates_have_no_defect(spark):
    cases = [({**CALM, "decision": d}, None) for d in ("GO", "WAIT", "SKIP")] + [({}, None), (UNKNOWN, None), ({"weather_code": 95, "is_day": False}, None)]
    assert codes(spark, cases) == [set()] * len(cases)


def test_each_code_and_its_near_miss(spark):
    rows = [({**SKIP}, " " + text, code, bad) for code, pair in PAIRS.items() for text, bad in zip(pair, (True, False))]
    df = spark.createDataFrame(rows, f"facts struct<{co.FACTS.replace(' ', ':').replace(',:', ',')}>, added string, code string, bad boolean")
    df = co.with_defects(df.withColumn("text", F.concat(co.template(F.col("facts"), F.lit(0)), "added")))
    for r in df.collect():
        assert (r["code"] in r["codes"]) == r["bad"], (r["added"], r["codes"])


def test_park_names_come_from_the_facts(spark):
    """A call to visit counts for the parks that the facts know, whatever they are called."""
    added = "Visit Nordhain soon."
    got = codes(spark, [({"allowed_park_names": names}, None) for names in (["Nordhain"], ["Suedsee"], None)], lambda text: F.concat(text, F.lit(" " + added)))
    assert ["unsafe_invitation" in g for g in got] == [True, False, False]


def test_what_is_left_out(spark):
    bare = "SKIP. Stay in."
    got = codes(spark, [({"weather_code": 96, "is_day": False}, bare), ({**CALM, "decision": "GO"}, "GO."), ({"decision": "WAIT"}, "WAIT."), ({}, "SKIP."), (UNKNOWN, "SKIP. Do not head out. An NAQI of 12 was seen, and by touch it feels like 19 C."), ({}, "")])
    assert got[0] == {"length", "missing_naqi", "missing_indian_scale", "missing_air_band", "missing_heat_reason", "missing_rain_reason", "missing_thunderstorm", "missing_night_reason"}
    assert got[1] == {"length", "missing_naqi", "missing_indian_scale", "missing_air_band", "missing_park"}
    assert "wait_direction" in got[2] and "skip_direction" in got[3]
    assert {"wrong_naqi", "missing_air_uncertainty", "missing_weather_uncertainty", "ungrounded_number"} <= got[4]
    assert {"decision", "length", "skip_direction"} <= got[5]


def test_permission_and_recheck(spark):
    held = {"walk_allowed": False, "scheduled_time": "06:00"}
    got = codes(spark, [({**CALM, "decision": "GO", **held}, None), ({**CALM, "decision": "WAIT", **held}, None)])
    assert got == [{"unsafe_invitation"}, set()]


def test_all_codes_and_messages(spark):
    assert len(co._checks(F.col("facts"))) == 31
    r = QUERIES["briefing_messages"](spark, DATA).first()
    facts = json.loads(r["message"].split("\n", 1)[1])
    assert list(facts) == sorted(facts) and "allowed_park_names" not in facts
    kinds = {}
    for r in QUERIES["briefing_summary"](spark, DATA).collect():
        kinds.setdefault(r["kind"], {})[r["code"]] = r
    assert kinds["certified"]["air_safety_claim"]["with_code"] == kinds["certified"]["air_safety_claim"]["n"]
    assert not set(kinds["plain"]) - {None, "length"}


def test_orders_of_features():
    assert (len(fe.FULL), len(fe.COMPACT)) == (28, 17)
    assert fe.known_order(None, 17) == fe.COMPACT and fe.known_order(("pm25", "vpd"), None) == ("pm25", "vpd")
    for order, width in (((), 3), (("pm25", "pm25"), 2), (("nonsense",), 1), (None, 5), (None, None)):
        with pytest.raises(ValueError):
            fe.known_order(order, width)
    with pytest.raises(ValueError):
        fe.matrix(None, fe.BASE, 12)


def test_history_reaches_back(spark):
    rows = {(r["series"], r["t"]): r for r in QUERIES["feature_rows"](spark, DATA).collect()}
    last = QUERIES["features_after_history"](spark, DATA).collect()
    assert last and all(r == rows[r["series"], r["t"]] for r in last)
