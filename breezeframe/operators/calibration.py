"""Risk of poor air: a grid of weighted fits, calibrated probabilities, and a threshold under a bound on false alarms.

Each step sees rows of its own, in order of time: fits on `train`, the weight on `development`, Platt scaling on
`calibration`, the threshold on `selection`. A positive is a label of POOR or more; a forecast is raised to POOR where the
probability reaches the threshold. All thresholds are tried in one pass; a table of one row a threshold comes to the driver.

Ties: of equal weights by recall and false alarms the smaller wins, of equal thresholds by recall and accuracy the higher.
Without a positive or a negative row no threshold is eligible, and the choice is None.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .models import prepared

# Fixed values of the rule.
POOR, MAX_FALSE_ALARMS, MAX_ACCURACY_LOSS, CLAMP = 3, 0.10, 0.03, 1e-6
WEIGHTS = (1.0, 2.0, 4.0, 8.0)
THRESHOLDS = tuple(k / 20 for k in range(1, 20))
#: Where each phase ends, as a share of a series' rows.
PHASES = {"train": 0.6, "development": 0.75, "calibration": 0.85, "selection": 1.0}
BINS = 10


def with_phase(df: DataFrame) -> DataFrame:
    """Adds `phase`, by the place of a row among those of its series in order of time."""
    place = F.percent_rank().over(W.partitionBy("series").orderBy("t"))
    return df.withColumn("phase", F.coalesce(*[F.when(place < end, F.lit(name)) for name, end in PHASES.items()], F.lit("selection")))


def positive(label: Column) -> Column:
    return (label >= POOR).cast("double")


def with_risk(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with `prob`, and without the model's own columns."""
    return model.transform(rows).withColumn("prob", F.get(vector_to_array("probability"), 1)).select(*rows.columns, "prob")


@dataclass(frozen=True)
class Choice:
    threshold: float
    recall: float
    false_alarms: float
    accuracy: float


def trials(rows: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(label, pred, prob) -> (threshold, pos, neg, recall, false_alarms, accuracy)."""
    tried = rows.select("label", "pred", "prob", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    raised = F.when(F.col("prob") >= F.col("threshold"), F.greatest(F.col("pred"), F.lit(POOR))).otherwise(F.col("pred"))
    yes, said = F.col("label") >= POOR, raised >= POOR
    g = tried.groupBy("threshold").agg(F.count_if(yes).alias("pos"), F.count_if(~yes).alias("neg"), F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.avg((F.col("label") == raised).cast("double")).alias("accuracy"))
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return g.select("threshold", "pos", "neg", share("tp", "pos").alias("recall"), share("fp", "neg").alias("false_alarms"), "accuracy")


def choose(rows: DataFrame, baseline: float = 0.0, max_false_alarms: float = MAX_FALSE_ALARMS, max_loss: float = MAX_ACCURACY_LOSS, thresholds: tuple[float, ...] = THRESHOLDS) -> Choice | None:
    """The eligible threshold of the highest recall, then accuracy, then of its own value."""
    own = trials(rows, thresholds).where((F.col("pos") > 0) & (F.col("neg") > 0) & (F.col("false_alarms") <= max_false_alarms) & (F.col("accuracy") >= baseline - max_loss))
    best = own.agg(F.max(F.struct("recall", "accuracy", "threshold", "false_alarms")).alias("b")).first()["b"]
    return best and Choice(best["threshold"], best["recall"], best["false_alarms"], best["accuracy"])


def fit_risk(train: DataFrame, weight: float) -> PipelineModel:
    """Logistic regression of POOR or more, positives weighing `weight`."""
    own = train.withColumn("_y", positive(F.col("label"))).withColumn("_w", F.when(F.col("_y") == 1, F.lit(float(weight))).otherwise(1.0))
    return Pipeline(stages=[*prepared(), LogisticRegression(labelCol="_y", weightCol="_w", maxIter=60, regParam=1e-3)]).fit(own)


def weighted_grid(train: DataFrame, development: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> tuple[PipelineModel, float, dict[float, Choice | None]]:
    """The model of the best weight on `development`, its weight, and the choice under each weight. ValueError if none keeps the bound on false alarms."""
    models = {w: fit_risk(train, w) for w in weights}
    # Only the risk counts here: nothing is forecast but what the probability raises.
    found = {w: choose(with_risk(m, development.withColumn("pred", F.lit(0.0))), max_loss=1.0) for w, m in models.items()}
    fit = [w for w in weights if found[w]]
    if not fit:
        raise ValueError("no weight meets the bound on false alarms")
    best = max(fit, key=lambda w: (found[w].recall, -found[w].false_alarms, -w))
    return models[best], best, found


def clamped_logit(p: Column) -> Column:
    q = F.greatest(F.lit(CLAMP), F.least(F.lit(1 - CLAMP), p))
    return F.ln(q / (1 - q))


def platt(scored: DataFrame) -> PipelineModel:
    """Logistic regression on the clamped logit of `prob`: a penalty of half the squared slope against the summed loss."""
    n = max(scored.count(), 1)
    own = scored.select(positive(F.col("label")).alias("_y"), clamped_logit(F.col("prob")).alias("_logit"))
    return Pipeline(stages=[VectorAssembler(inputCols=["_logit"], outputCol="_l"), LogisticRegression(featuresCol="_l", labelCol="_y", regParam=1 / n, standardization=False, maxIter=200, tol=1e-10)]).fit(own)


def calibrated(model: PipelineModel, scored: DataFrame) -> DataFrame:
    """scored with `prob` calibrated."""
    made = model.transform(scored.withColumn("_logit", clamped_logit(F.col("prob"))))
    return made.withColumn("prob", F.get(vector_to_array("probability"), 1)).select(*scored.columns)


def calibration_error(scored: DataFrame, bins: int = BINS) -> DataFrame:
    """One row (n, ece): the mean distance of probability and share of positives over `bins` equal bins, by their rows."""
    at = F.least(F.floor(F.col("prob") * bins), F.lit(bins - 1))
    g = scored.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("prob") - F.avg(positive(F.col("label")))).alias("gap"))
    return g.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
