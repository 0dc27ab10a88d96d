"""The chain of repairs against a plain loop over all drafts, and its rules on sentences of our own."""

import re

import pytest
from pyspark.sql import functions as F

from breezeframe.functions import contract as co
from breezeframe.functions import repairs as rp
from breezeframe.plans import repairs as plans

DATA = "/root/testdata/sf0.001"


def cut(text):
    words = text.split()
    if len(words) <= rp.LIMIT:
        return " ".join(words)
    head = " ".join(words[: rp.LIMIT])
    last = max(map(head.rfind, ".!?"))
    return head[: last + 1] if last >= 0 else head.rstrip(",;:-") + "..."


def sentences_without(text, phrases, ended):
    kept = [s for s in re.findall(r"[^.]*\.|[^.]+$", text) if not (re.search(r"\b(?:" + "|".join(phrases) + r")\b", s, re.I) and (s.endswith(".") or not ended))]
    return re.sub(r"\s{2,}", " ", "".join(kept)).strip()


def twin(text, f, codes, prose):
    """(repaired, repairs) by plain Python."""
    done = []
    if f["walk_allowed"] is False or f["decision"] != "GO" and re.search(rp.OUTING, text) or set(codes) & set(rp.GRAVE):
        text, done = prose, ["fallback"]
    else:
        text = cut(text)
        if f["decision"] == "SKIP" and not any(m in text.lower() for m in rp.SKIP_MARKS):
            air = "" if f["naqi"] is None else f"{rp.STAY[1]}{f['naqi']:.0f} ({f['band']})."
            text = f"{rp.STAY[0]}{rp.NO_REASON}.{air}{rp.STAY[2]}"
            done.append("skip_tone")
        sober = sentences_without(text, rp.HEDGES, True)
        done += ["hedging"] * (sober != text)
        text = sober
        if f["naqi"] is not None and not any(m in text.lower() for m in rp.AIR_MARKS):
            text = f"{text}{rp.READING[0]}{f['naqi']:.0f}, {f['band'].lower()}{rp.READING[1]}".strip()
            done.append("reading")
        text = cut(text)
    said = text
    if f["park"] is not None:
        for p in sorted(f["allowed_park_names"] or [], key=lambda p: (-len(p), p)):
            if p and p.lower() not in f["park"].lower():
                text = re.sub(rf"\b{re.escape(p)}\b(\s+(?:Park|Lake|Gardens?))?", lambda _: f["park"], text)
        text = sentences_without(text, rp.FOREIGN, False)
    return text, done + ["places"] * (text != said)


def test_chain_is_the_loop(spark):
    rows = rp.with_repairs(plans.drafts(spark, DATA), F.hour("t") % 3).withColumn("prose", co.template(F.col("facts"), F.hour("t") % 3)).collect()
    seen = set()
    for r in rows:
        assert (r["repaired"], r["repairs"]) == twin(r["text"], r["facts"], r["codes"], r["prose"]), (r["kind"], r["text"])
        seen |= set(r["repairs"])
    assert seen == {"fallback", "skip_tone", "hedging", "reading", "places"}
    counts = plans.briefing_repairs(spark, DATA).count()
    assert counts == len(rows) > 0


def facts(spark, rows):
    return spark.createDataFrame([(k, t, f) for k, (t, f) in enumerate(rows)], f"k int, text string, facts struct<{', '.join(p.replace(' ', ': ', 1) for p in co.FACTS.split(', '))}>")


FINE = dict(decision="GO", park="Lal Bagh Garden", naqi=70.0, band="satisfactory", apparent_c=24.0, precip_mm=0.0, precip_prob=0.0, is_day=True, time="09:00", air_available=True, weather_available=True, weather_code=0, allowed_park_names=["Lal Bagh Garden", "Lal Bagh", "Rose", "Rose (Old) Hill"])


@pytest.mark.parametrize(
    ("text", "changes", "want", "done"),
    [
        ("Clean enough at Rose (Old) Hill Park and Rose Lake.", {}, "Clean enough at Lal Bagh Garden and Lal Bagh Garden.", ["places"]),
        ("Lal Bagh has clean enough air.", {}, "Lal Bagh has clean enough air.", []),
        ("Roses smell of dust. Expect Frost there", {}, "Roses smell of dust.", ["places"]),
        ("Dust. Frost. Ski!", {"park": None}, "Dust. Frost. Ski!", []),
        ("Birds sing. This is a cure.", {}, "Birds sing. Air right now is Indian NAQI 70, satisfactory -- informational, not medical advice.", ["hedging", "reading"]),
        ("Birds sing, a cure", {"naqi": None}, "Birds sing, a cure", []),
        ("Have fun.", {"decision": "SKIP", "naqi": None}, f"{rp.STAY[0]}{rp.NO_REASON}.{rp.STAY[2]}", ["skip_tone"]),
        ("", {"naqi": None}, "", []),
        (None, {}, None, []),
        ("Names cost $5 \\ at Rose.", {"park": "A$1\\B", "naqi": None}, "Names cost $5 \\ at A$1\\B.", ["places"]),
    ],
)
def test_rules(spark, text, changes, want, done):
    r = rp.with_repairs(facts(spark, [(text, FINE | changes)]), F.lit(0)).first()
    assert (r["repaired"], r["repairs"]) == (want, done)


def test_grave_texts_fall_back(spark):
    cases = [("It is a fine day for all, and the NAQI is 12.", {}), ("Dust, so head outside.", {"decision": "WAIT"}), ("Dust. All fine.", {"walk_allowed": False})]
    rows = rp.with_repairs(facts(spark, [(t, FINE | c) for t, c in cases]), F.lit(1)).withColumn("prose", co.template(F.col("facts"), F.lit(1))).collect()
    assert all(r["repairs"][0] == "fallback" and r["repaired"] == r["prose"] for r in rows)
    assert rp.with_repairs(facts(spark, []), F.lit(0)).count() == 0
