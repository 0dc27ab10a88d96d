"""Air-quality index as generated column expressions: no UDF, no join, all inside code generation.

Missing is NULL everywhere in the engine: readings that are NaN become NULL at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper concentrations of the first five segments of each pollutant's
# published breakpoint table, in its own unit, and the index at the segments' ends.
BREAKPOINTS = {
    "pm25": (30, 60, 90, 120, 250),
    "pm10": (50, 100, 250, 350, 430),
    "no2": (40, 80, 180, 280, 400),
    "o3": (50, 100, 168, 208, 748),
    "co": (1.0, 2.0, 10, 17, 34),
    "so2": (40, 80, 380, 800, 1600),
    "nh3": (200, 400, 800, 1200, 1800),
    "pb": (0.5, 1.0, 2.0, 3.0, 3.5),
}
SEGMENTS = ((0, 50), (51, 100), (101, 200), (201, 300), (301, 400), (401, 500))
#: Divisor from the feed's unit to the table's.
UNIT_DIVISOR = {"co": 1000.0}
AVERAGING_HOURS = {k: 8 if k in ("o3", "co") else 24 for k in BREAKPOINTS}
TIE_ORDER = ("pm25", "pm10", "o3", "no2", "so2", "co", "nh3", "pb")
BANDS = ("good", "satisfactory", "moderate", "poor", "severe", "hazardous")
BAND_TEXT = (
    "Minimal effect.",
    "Minor breathing discomfort to sensitive people.",
    "Breathing discomfort for people with lung, asthma or heart conditions.",
    "Breathing discomfort to most people on prolonged exposure.",
    "Respiratory illness on prolonged exposure.",
    "Affects healthy people and seriously affects those with existing disease.",
)


def usable(x: Column) -> Column:
    """NULL for NaN."""
    return F.when(~F.isnan(x), x)


def sub_index(key: str, x: Column) -> Column:
    """Piecewise-linear index of one pollutant; infinite readings give 0, negative ones count as 0.

    The segment's number picks its constants from arrays, which keeps the generated code small.
    """
    c = F.greatest(x / UNIT_DIVISOR.get(key, 1.0), F.lit(0.0))
    edges = (0.0, *map(float, BREAKPOINTS[key]))
    segment = sum((F.when(c > e, 1).otherwise(0) for e in edges[2:]), F.when(c > edges[1], 1).otherwise(0))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), segment)
    rise = [float(b - a) for a, b in SEGMENTS[:5]]
    span = [hi - lo for lo, hi in zip(edges, edges[1:])]
    # Above the last edge the slope of the segment before goes on, up to 500.
    value = pick([float(a) for a, _ in SEGMENTS]) + pick([*rise, rise[4]]) * (c - pick(list(edges))) / pick([*span, span[4]])
    return F.when(x.isNotNull(), F.when(F.abs(x) == float("inf"), F.lit(0.0)).otherwise(F.least(F.lit(500.0), value)))


def index(readings: dict[str, Column]) -> Column:
    """The worst available sub-index."""
    return F.greatest(*[sub_index(k, x) for k, x in readings.items()], F.lit(None).cast("double"))


def dominant(subs: dict[str, Column], worst: Column) -> Column:
    """The pollutant with the worst sub-index; ties within 1e-9 go by TIE_ORDER."""
    return F.coalesce(*[F.when(F.abs(subs[k] - worst) < 1e-9, F.lit(k)) for k in TIE_ORDER if k in subs])


def missing(subs: dict[str, Column]) -> Column:
    """Comma-joined names of pollutants without a reading."""
    return F.concat_ws(",", *[F.when(x.isNull(), F.lit(k)) for k, x in subs.items()])


def ordinal(x: Column) -> Column:
    """Band number 0..5 of an index, rounded half to even; above 500 is 5, below 0 is 0."""
    r = F.bround(usable(x), 0)
    out = F.when(r <= 50, 0)
    for k, (_, hi) in enumerate(SEGMENTS[1:], 1):
        out = out.when(r <= hi, k)
    return out.when(r > 500, 5)


def band(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, BANDS)), number)


def conservative(instant: Column, trailing: Column) -> Column:
    """The higher of the hour's index and the trailing one, of those there are."""
    return F.greatest(usable(instant), usable(trailing))


def pm25_for_index(x: Column) -> Column:
    """A fine-particle reading that gives the index; 30 where the index lies between two segments."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(499.0), x.cast("double")))
    edges = (0.0, *map(float, BREAKPOINTS["pm25"]))
    out = None
    for k, (a, b) in enumerate(SEGMENTS):
        width = (edges[k + 1] - edges[k]) / (b - a) if k < 5 else (edges[5] - edges[4]) / (SEGMENTS[4][1] - SEGMENTS[4][0])
        value = F.bround(edges[k] + (t - a) * width, 1)
        out = (F if out is None else out).when((t >= a) & (t <= b), value)
    return out.otherwise(F.lit(30.0))


def breakpoint_table(spark: SparkSession) -> DataFrame:
    rows = []
    for key, edges in BREAKPOINTS.items():
        full = (0.0, *map(float, edges), None)
        rows += [(key, k, full[k], full[k + 1], float(a), float(b)) for k, (a, b) in enumerate(SEGMENTS)]
    return spark.createDataFrame(rows, "pollutant string, segment int, conc_low double, conc_high double, index_low double, index_high double")


def band_table(spark: SparkSession) -> DataFrame:
    rows = [(k, b, a, z, t) for k, (b, (a, z), t) in enumerate(zip(BANDS, SEGMENTS, BAND_TEXT))]
    return spark.createDataFrame(rows, "ordinal int, band string, index_low int, index_high int, health string")


# --- the same expressions as SQL text, for queries that are checked against another engine


def sub_index_sql(key: str, x: str) -> str:
    c = f"greatest(({x}) / {UNIT_DIVISOR.get(key, 1.0)!r}::DOUBLE, 0.0::DOUBLE)"
    edges = (0.0, *map(float, BREAKPOINTS[key]))
    cases = [f"WHEN ({x}) IS NULL THEN NULL WHEN abs({x}) = 'inf'::DOUBLE THEN 0.0::DOUBLE"]
    for k in range(5):
        a, b = SEGMENTS[k]
        cases.append(f"WHEN {c} <= {edges[k + 1]!r} THEN {a} + {b - a} * ({c} - {edges[k]!r}::DOUBLE) / {edges[k + 1] - edges[k]!r}::DOUBLE")
    slope = (SEGMENTS[4][1] - SEGMENTS[4][0]) / (edges[5] - edges[4])
    return f"CASE {' '.join(cases)} ELSE least(500.0::DOUBLE, {SEGMENTS[5][0]} + ({c} - {edges[5]!r}::DOUBLE) * {slope!r}::DOUBLE) END"


def ordinal_sql(x: str) -> str:
    cases = " ".join(f"WHEN round_even({x}, 0) <= {hi} THEN {k}" for k, (_, hi) in enumerate(SEGMENTS))
    return f"CASE WHEN ({x}) IS NULL THEN NULL {cases} ELSE 5 END"


def band_sql(number: str) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {k} THEN '{b}'" for k, b in enumerate(BANDS)) + " END"
