"""Forecast models on Spark ML: imputation, scaling, fits, blends and the baselines."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INPUTS = ("effective", "instant", "temp_c", "apparent_c", "precip_mm", "precip_prob", "humidity", "wind_kmh", "lag1", "lag3", "lag6", "rolling3", "rolling6")
CLASSES = 6
# Fixed values of the consensus: weights of its three models, and the moderate class's threshold.
CONSENSUS, MODERATE = (0.50, 0.35, 0.15), 0.31
#: Rows of a task in fits that pass over them again and again.
ROWS_A_TASK = 20_000


def packed(df: DataFrame) -> DataFrame:
    """df, cached in partitions of about ROWS_A_TASK rows.

    Windows over a few series leave most shuffle partitions empty, and each pass of a fit starts a task for each.
    """
    kept = df.persist()
    wanted = max(1, -(-kept.count() // ROWS_A_TASK))
    if wanted >= kept.rdd.getNumPartitions():
        return kept
    out = kept.repartition(wanted).persist()
    out.count()
    kept.unpersist()
    return out


def prepared(inputs: tuple[str, ...] = INPUTS) -> list:
    """Median imputation, assembly and scaling; NULL and NaN are both missing here."""
    filled = [f"{c}_f" for c in inputs]
    return [Imputer(strategy="median", inputCols=list(inputs), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]


def as_doubles(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in INPUTS} | {"label": F.col("label").cast("double")})


def logistic():
    return Pipeline(stages=[*prepared(), LogisticRegression(family="multinomial", maxIter=60, regParam=1e-3)])


def with_class_weights(train: DataFrame) -> DataFrame:
    """Adds `weight`: rows over classes times the rows of the class, so that each class weighs the same. There are CLASSES of them at most."""
    counts = train.groupBy("label").agg(F.count("*").alias("_n"))
    whole = counts.agg((F.sum("_n") / F.count("*")).alias("_mean"))
    weights = counts.join(F.broadcast(whole), F.lit(True)).select("label", (F.col("_mean") / F.col("_n")).alias("weight"))
    return train.join(F.broadcast(weights), "label")


def forest(trees: int = 60, depth: int = 8, least: int = 1):
    """Trees over rows with a `weight`."""
    return Pipeline(stages=[*prepared(), RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=least, weightCol="weight", seed=7)])


def boosted(rounds: int = 8):
    """Boosting is binary in Spark ML, so classes are told apart one against the rest."""
    return Pipeline(stages=[*prepared(), OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=3, seed=7))])


def ridge(target: str, alpha: float, n: int):
    """Ridge whose penalty is alpha over the sum of weights, as Spark's loss is a mean."""
    return Pipeline(stages=[*prepared(), LinearRegression(labelCol=target, solver="normal", elasticNetParam=0.0, regParam=alpha / max(n, 1))])


def probabilities(scored: DataFrame, name: str) -> DataFrame:
    """The probability vector as an array of six, classes that the model never saw at 0."""
    p = vector_to_array("probability")
    return scored.withColumn(name, F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.coalesce(F.get(p, k), F.lit(0.0))))


def blend(parts: list[tuple[str, float]]) -> Column:
    """A weighted sum of probability arrays."""
    first, w = parts[0]
    out = F.transform(first, lambda x: x * w)
    for name, weight in parts[1:]:
        out = F.zip_with(out, F.transform(name, lambda x: x * weight), lambda a, b: a + b)  # noqa: B023
    return out


def most_likely(p: Column) -> Column:
    """The class of the highest probability, the first of equal ones."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def moderate_rule(p: Column, threshold: float) -> Column:
    """The most likely class, but class 2 where a lower one wins and class 2 has the threshold's chance."""
    top = F.array_position(p, F.array_max(p)) - 1
    return F.when((top < 2) & (F.get(p, F.lit(2)) >= threshold), F.lit(2)).otherwise(top).cast("int")
