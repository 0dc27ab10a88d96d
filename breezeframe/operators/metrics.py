"""Evaluation metrics as grouped aggregates: each is one pass with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def confusion(df: DataFrame, truth: str = "label", pred: str = "pred", classes: int = 6) -> DataFrame:
    """(truth, pred, n); numbers out of range are ignored."""
    inside = F.col(truth).between(0, classes - 1) & F.col(pred).between(0, classes - 1)
    return df.where(inside).groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def per_class(cells: DataFrame, classes: int = 6) -> DataFrame:
    """(class, precision, recall, f1, support), four decimals; 0 where a denominator is 0."""
    sides = F.array(F.struct(F.col("truth").alias("class"), F.lit(0).alias("p"), F.col("n").alias("s"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("pred").alias("class"), F.col("n").alias("p"), F.lit(0).alias("s"), F.lit(0).alias("tp")))
    all_classes = F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))
    zero = cells.sparkSession.range(1).select(all_classes.alias("class"), F.lit(0).alias("p"), F.lit(0).alias("s"), F.lit(0).alias("tp"))
    g = cells.select(F.explode(sides).alias("x")).select("x.*").unionByName(zero).groupBy("class").agg(F.sum("p").alias("p"), F.sum("s").alias("support"), F.sum("tp").alias("tp"))
    precision, recall = F.coalesce(share(F.col("tp"), F.col("p")), F.lit(0.0)), F.coalesce(share(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return g.select("class", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"), F.col("support").cast("long").alias("support"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share, four decimals; (0, 0) for no trials."""
    p = k / n
    centre, denominator = p + z * z / (2 * n), 1 + z * z / n
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    empty = lambda x: F.when(n == 0, F.lit(0.0)).otherwise(F.round(x, 4))
    return empty((centre - margin) / denominator), empty((centre + margin) / denominator)


def risk(df: DataFrame, by: list[str], label: str = "label", pred: str = "pred", prob: str = "prob", floor: int = 3) -> DataFrame:
    """Metrics of poor-or-worse risk for each group."""
    t, a = F.col(label) >= floor, F.col(pred) >= floor
    g = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(t).alias("positives"), F.count_if(a).alias("alarms"), F.count_if(t & a).alias("tp"),
        F.avg(F.pow(F.col(prob) - t.cast("double"), 2)).alias("brier"),
    )
    return g.select(
        *by, "n", "positives", (F.col("positives") - F.col("tp")).alias("misses"), share(F.col("tp"), F.col("positives")).alias("recall"),
        (F.col("alarms") - F.col("tp")).alias("false_alarms"), share(F.col("alarms") - F.col("tp"), F.col("n") - F.col("positives")).alias("false_alarm_rate"),
        share(F.col("tp"), F.col("alarms")).alias("precision"), "brier",
    )


def reliability(df: DataFrame, label: str = "label", prob: str = "prob", floor: int = 3) -> DataFrame:
    """(bin, n, probability, observed) of ten bins; 1 belongs to the last."""
    return df.groupBy(F.least(F.floor(F.col(prob) * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("probability"), F.avg((F.col(label) >= floor).cast("double")).alias("observed"))


def numeric_errors(error: Column, alpha: float) -> list[Column]:
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.greatest(alpha * error, (alpha - 1) * error)).alias("pinball"),
        F.avg((error <= 0).cast("double")).alias("coverage"),
    ]


def mcnemar_exact(a: int, b: int) -> float:
    """Two-sided exact p-value of discordant counts a and b."""
    from math import comb

    n, k = a + b, min(a, b)
    return 1.0 if n == 0 else round(min(1.0, 2.0 * sum(comb(n, i) for i in range(k + 1)) / 2**n), 6)
