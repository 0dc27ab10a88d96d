"""Go, wait or skip: the product's policy, its safe form, the model's and the evaluation's, and comfort.

The policies differ in their treatment of night, thunder and missing weather; none stands for another.
Decisions are ranks: 0 go, 1 wait, 2 skip.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the policies.
AIR_SKIP, AIR_WAIT = 300.0, 200.0
HEAT_SKIP, HEAT_WAIT = 35.0, 30.0
RAIN_SKIP_MM, RAIN_MIN_MM = 2.5, 0.5
PROB_SKIP, PROB_WAIT = 70.0, 40.0
DECISIONS = ("GO", "WAIT", "SKIP")


def decision_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, DECISIONS)), rank)


def skip_reasons(effective: Column, apparent: Column, mm: Column, prob: Column, thunder: Column) -> Column:
    """Names of the reasons to skip, in the order in which they are told."""
    return F.array_compact(
        F.array(
            F.when(effective.isNull(), F.lit("no_air")),
            F.when(effective >= AIR_SKIP, F.lit("air")),
            F.when(apparent >= HEAT_SKIP, F.lit("heat")),
            F.when(mm >= RAIN_SKIP_MM, F.lit("rain")),
            F.when((prob >= PROB_SKIP) & (mm >= RAIN_MIN_MM), F.lit("rain_chance")),
            F.when(thunder, F.lit("thunder")),
        )
    )


def wait_reasons(effective: Column, apparent: Column, prob: Column) -> Column:
    return F.array_compact(F.array(F.when(effective >= AIR_WAIT, F.lit("air")), F.when(apparent >= HEAT_WAIT, F.lit("heat")), F.when(prob >= PROB_WAIT, F.lit("rain_chance"))))


def product_policy(effective: Column, apparent: Column, mm: Column, prob: Column, thunder: Column, is_day: Column) -> Column:
    """(rank, reasons): skip reasons first, then wait reasons, then night."""
    skips, waits = skip_reasons(effective, apparent, mm, prob, thunder), wait_reasons(effective, apparent, prob)
    night = F.coalesce(is_day, F.lit(0)) == 0
    with_night = lambda reasons: F.when(night, F.array_append(reasons, F.lit("night"))).otherwise(reasons)
    rank = F.when(F.size(skips) > 0, 2).when((F.size(waits) > 0) | night, 1).otherwise(0)
    return F.struct(rank.alias("rank"), F.when(F.size(skips) > 0, with_night(skips)).otherwise(with_night(waits)).alias("reasons"))


def safe_policy(effective: Column, apparent: Column, mm: Column, prob: Column, thunder: Column, is_day: Column) -> Column:
    """The product's policy, but unknown heat or rain is never a go."""
    base = product_policy(effective, apparent, mm, prob, thunder, is_day)
    unknown = F.array_compact(F.array(F.when(apparent.isNull(), F.lit("no_heat")), F.when(mm.isNull(), F.lit("no_rain"))))
    held = (base["rank"] < 2) & (F.size(unknown) > 0)
    return F.struct(F.when(held, 2).otherwise(base["rank"]).alias("rank"), F.when(held, unknown).otherwise(base["reasons"]).alias("reasons"))


def model_policy(band: Column, apparent: Column, mm: Column, prob: Column, is_day: Column) -> Column:
    a, m, p = F.coalesce(apparent, F.lit(30.0)), F.coalesce(mm, F.lit(0.0)), F.coalesce(prob, F.lit(0.0))
    return (
        F.when((band >= 4) | (m >= RAIN_SKIP_MM) | (p >= PROB_SKIP) | (a >= HEAT_SKIP), 2)
        .when((band == 3) | (a >= HEAT_WAIT) | (p >= PROB_WAIT) | (F.coalesce(is_day, F.lit(0)) == 0), 1)
        .otherwise(0)
    )


def label_policy(band: Column, apparent: Column, mm: Column, prob: Column) -> Column:
    a, m, p = F.coalesce(apparent, F.lit(30.0)), F.coalesce(mm, F.lit(0.0)), F.coalesce(prob, F.lit(0.0))
    return F.when(band.isNull() | (band >= 4) | (m >= RAIN_SKIP_MM) | (p >= PROB_SKIP) | (a >= HEAT_SKIP), 2).when((band >= 3) | (a >= HEAT_WAIT) | (p >= PROB_WAIT), 1).otherwise(0)


def label_policy_sql(band: str, apparent: str, mm: str, prob: str) -> str:
    a, m, p = f"coalesce({apparent}, 30.0)", f"coalesce({mm}, 0.0)", f"coalesce({prob}, 0.0)"
    return f"CASE WHEN {band} IS NULL OR {band} >= 4 OR {m} >= 2.5 OR {p} >= 70 OR {a} >= 35 THEN 2 WHEN {band} >= 3 OR {a} >= 30 OR {p} >= 40 THEN 1 ELSE 0 END"


def skip_cause(band: Column, apparent: Column, mm: Column, prob: Column) -> Column:
    """air+heat+rain, those that hold; `unknown` if none."""
    cause = F.concat_ws("+", F.when(band >= 4, F.lit("air")), F.when(apparent >= HEAT_SKIP, F.lit("heat")), F.when((F.coalesce(mm, F.lit(0.0)) >= RAIN_SKIP_MM) | (F.coalesce(prob, F.lit(0.0)) >= PROB_SKIP), F.lit("rain")))
    return F.when(cause == "", F.lit("unknown")).otherwise(cause)


def comfort(effective: Column, apparent: Column, mm: Column) -> Column:
    """0 to 100, one decimal: air 55 %, heat 30 %, rain 15 %. The hair added makes ties the same whatever the order of sums."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    air = clip(100.0 - effective / AIR_SKIP * 100.0)
    heat = F.coalesce(clip(100.0 - F.greatest(F.lit(0.0), apparent - 24.0) * 6.0), F.lit(80.0))
    heat = F.when(apparent.isNull(), F.lit(80.0)).otherwise(heat)
    rain = F.when(mm.isNull(), F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), 100.0 - mm * 25.0))
    return F.when(effective.isNull(), F.lit(0.0)).otherwise(F.bround(0.55 * air + 0.3 * heat + 0.15 * rain + 1e-9, 1))


def stricter(a: Column, b: Column) -> Column:
    return F.greatest(a, b)
